"""Small programs with known results."""

import os

import pytest
from pyspark.sql import functions as F

from shardflow import sources
from shardflow.dataset import Dataset
from shardflow.shapes import Shape, key_of


def test_map_of_a_slice_keeps_order(spark):
    assert Dataset.slice(spark, [1, 2, 3]).map("value").collect() == [1, 2, 3]


def test_pairs_and_back(spark):
    pairs = Dataset.slice(spark, [1, 2, 3]).map_pairs("value", "value")
    assert pairs.shape is Shape.PAIR
    assert pairs.map("key + value").collect() == [2, 4, 6]
    assert pairs.map_with(lambda k, v: k + v, "value bigint").collect() == [2, 4, 6]


def test_group_by_key(spark):
    g = Dataset.slice(spark, [1, 1, 2, 2, 3, 3]).map_pairs("value", "2 * value").group_by_key()
    assert g.shape is Shape.GROUPED
    assert sorted(g.map("concat(array(key), values)").collect()) == [[1, 2, 2], [2, 4, 4], [3, 6, 6]]


def test_cogroup(spark):
    a = Dataset.slice(spark, [1, 1, 2]).map_pairs("value", "2 * value")
    b = Dataset.slice(spark, [1, 2, 2]).map_pairs("value", "5 * value")
    got = a.cogroup(b)
    assert got.shape is Shape.COGROUPED
    assert sorted(got.collect()) == [(1, [2, 2], [5]), (2, [4], [10, 10])]


def test_source_of_one_shard(spark):
    ds = Dataset.source(spark, lambda shard, shards: iter([("a",), ("b",), ("c",)]), "value string")
    assert ds.shards == 1 and ds.collect() == ["a", "b", "c"]


def test_source_deals_round_robin(spark):
    ds = Dataset.source(spark, lambda i, n: ((k,) for k in range(i, 10, n)), "value int", 3)
    parts = ds.df.groupBy(F.spark_partition_id().alias("p")).agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
    assert sorted(r["v"] for r in parts) == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]


def test_key_inference(spark):
    assert key_of(spark.createDataFrame([(1, "x")], "a int, b string")) == "a"
    assert key_of(spark.createDataFrame([(1,)], "value int")) == "value"
    assert key_of(spark.createDataFrame([(1, 2)], "other int, key int")) == "key"


def test_nested_values(spark):
    kind = "value map<string, struct<x:boolean,y:float,z:struct<a:int,b:string>>>"
    item = {"one": (True, 0.5, (7, "t"))}
    assert Dataset.slice(spark, [(item,)], kind).collect() == [{"one": (True, 0.5, (7, "t"))}]


def test_self_join_of_a_channel(spark):
    """0 to 4, each twice: (t, 2t) joined with (t, 3t) has four pairs for each key."""
    ch = Dataset.channel(spark, [x for t in range(5) for x in (t, t)])
    got = ch.map_pairs("value", "2 * value").join(ch.map_pairs("value", "3 * value")).output_as("X", "Y", "Z")
    assert got.df.columns == ["X", "Y", "Z"]
    assert sorted(got.collect()) == sorted((t, 2 * t, 3 * t) for t in range(5) for _ in range(4))


def test_unrolled_loop(spark):
    ds = Dataset.channel(spark, range(5)).map_pairs("value", "2 * value")
    for _ in range(7):
        ds = ds.map_pairs("key + 1", "value + 1")
    assert sorted(ds.collect()) == [(t + 7, 2 * t + 7) for t in range(5)]


def test_word_count_program(spark, tmp_path):
    path = tmp_path / "passwd"
    path.write_text("# comment\nroot:x:0\n\nuser:x:1\n")
    lines = Dataset.text_file(spark, str(path)).filter(~F.col("value").startswith("#"))
    assert lines.flat_map("split(value, ':')").map("1").reduce("sum").collect() == [7]


def test_text_contract(spark, tmp_path):
    """Only newlines end lines; one carriage return before them goes; long lines stay whole; no final newline is fine."""
    long = "x" * 200_000
    path = tmp_path / "t"
    path.write_bytes(f"a\r\nb\rc\n\n{long}\nlast".encode())
    assert Dataset.text_file(spark, str(path)).collect() == ["a", "b\rc", "", long, "last"]
    with pytest.raises(Exception):
        Dataset.text_file(spark, str(tmp_path / "none")).collect()


def test_directories_are_not_read_recursively(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "a").write_text("1\n")
    (tmp_path / "b").write_text("2\n")
    (tmp_path / "below" / "c").write_text("3\n")
    d = str(tmp_path)
    assert sorted(r.value for r in sources.text_dir(spark, d).collect()) == ["1", "2"]
    named = {os.path.basename(r.path): r.value for r in sources.text_dir(spark, d, names=True).collect()}
    assert named == {"a": "1", "b": "2"}
    assert sorted(os.path.basename(r.path) for r in sources.binary_listing(spark, d).collect()) == ["a", "b"]
    assert [r.value for r in sources.text_of_paths(spark, [f"{d}/b"]).collect()] == ["2"]


def test_xml_rows(spark):
    lines = ['<?xml version="1.0"?>', "<posts>", '  <row PostTypeId="1" CreationDate="2008-07-31T21:42:52.667" Tags="&lt;c#&gt;&lt;.net&gt;" />', "<row PostTypeId=", "no markup", "</posts>"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sources.xml_rows(df, "_PostTypeId int, _CreationDate string, _Tags string").where("PostTypeId is not null").collect()
    assert [tuple(r) for r in got] == [(1, "2008-07-31T21:42:52.667", "<c#><.net>")]


def test_inverted_index_counts_empty_lines(spark):
    df = spark.createDataFrame([("a b\n\nb",)], "text string")
    got = df.select(F.explode(sources.numbered_words(F.col("text"))).alias("w")).select("w.*").collect()
    assert sorted(tuple(r) for r in got) == [(0, "a"), (0, "b"), (2, "b")]
