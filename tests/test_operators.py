"""Laws and edge cases of the dataflow operators."""

import datetime
import math
import random
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardflow import catalog, sources
from shardflow.dataset import Dataset
from shardflow.functions import fnv1a
from shardflow.operators import aggregation as agg
from shardflow.operators import exchange, joins, ordering
from shardflow.streaming import fan_in
from tests.oracle import of_duckdb, of_spark

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIRS = st.lists(st.tuples(st.integers(-4, 4), st.integers(-9, 9)), max_size=25)


def pairs(spark, rows, kind="key int, value int"):
    return spark.createDataFrame(rows, kind)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@given(PAIRS)
@FEW
def test_reduce_is_a_merge_of_local_reduces(spark, rows):
    df = pairs(spark, rows)
    local = agg.local_reduce(exchange.placed(df, 3), "max")
    want = [(max(v for _, v in rows),)] if rows else []
    assert got(agg.reduce(df, "max")) == want == got(agg.reduce(local.select("value"), "max"))
    assert got(agg.reduce_with(df, max)) == want


@given(PAIRS)
@FEW
def test_reduce_by_key_opaque_or_not(spark, rows):
    df = pairs(spark, rows)
    want = sorted(((k, min(v for x, v in rows if x == k)) for k in {k for k, _ in rows}), key=repr)
    assert got(agg.reduce_by_key(df, "min")) == want == got(agg.reduce_by_key_with(df, min))


@given(PAIRS, PAIRS)
@FEW
def test_joins(spark, left, right):
    a, b = pairs(spark, left), pairs(spark, right)
    inner = [(k, v, w) for k, v in left for x, w in right if x == k]
    only_left = [(k, v, None) for k, v in left if k not in {x for x, _ in right}]
    only_right = [(k, None, w) for k, w in right if k not in {x for x, _ in left}]
    order = lambda x: sorted(x, key=repr)
    assert got(joins.join(a, b)) == order(inner)
    assert got(joins.join(a, b, True)) == order(inner + only_left)
    assert got(joins.join(a, b, False, True)) == order(inner + only_right)
    assert got(joins.join(a, b, True, True)) == order(inner + only_left + only_right) == got(joins.join_co_partitioned(a, b, 4, True, True))
    both = joins.cogroup(a, b)
    crossed = both.select("key", F.explode("values1").alias("value1"), "values2").select("key", "value1", F.explode("values2").alias("value2"))
    assert got(crossed) == order(inner)
    assert got(joins.semi(a, b).select("key", "value")) == order([r for r in left if r[0] in {x for x, _ in right}])
    assert got(joins.anti(a, b).select("key", "value")) == order([r for r in left if r[0] not in {x for x, _ in right}])


@given(PAIRS, st.integers(1, 5))
@FEW
def test_partition_is_a_permutation_that_puts_keys_together(spark, rows, n):
    df = pairs(spark, rows)
    where = exchange.placed(df, n).withColumn("at", F.spark_partition_id())
    assert got(where.select("key", "value")) == sorted(rows, key=repr)
    assert all(r["at"] == r["key"] % n for r in where.collect())
    again = exchange.by_key(df, n).select("key", F.spark_partition_id().alias("at")).distinct().groupBy("key").count()
    assert all(r["count"] == 1 for r in again.collect())


@given(PAIRS)
@FEW
def test_groups(spark, rows):
    df = pairs(spark, rows)
    want = sorted(((k, sorted(v for x, v in rows if x == k)) for k in {k for k, _ in rows}), key=repr)
    assert got(agg.group_by_key(df)) == want
    local = agg.local_group_by_key(ordering.local_sort(exchange.placed(df, 3)))
    assert got(local.select("key", "values")) == want


@given(st.lists(st.sampled_from("aab"), max_size=20))
@FEW
def test_folds_of_runs(spark, keys):
    df = spark.createDataFrame([(i, k, 1) for i, k in enumerate(keys)], "at int, key string, value int")
    out = agg.fold_runs(df, "sum", "at").orderBy("run").select("key", "value").collect()
    assert [tuple(r) for r in out] == [(k, len(list(g))) for k, g in groupby(keys)]


def test_runs_are_not_groups(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a")], "at int, key string").withColumn("value", F.lit(1))
    assert [tuple(r) for r in agg.fold_runs(df, "sum", "at").orderBy("run").select("key", "value").collect()] == [("a", 2), ("b", 1), ("a", 1)]
    assert got(agg.reduce_by_key(df.select("key", "value"), "sum")) == [("a", 3), ("b", 1)]


def test_null_keys_are_a_run(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "a")], "at int, key string").withColumn("value", F.lit(1))
    assert [tuple(r) for r in agg.fold_runs(df, "sum", "at").orderBy("run").select("key", "value").collect()] == [(None, 2), ("a", 1)]


@pytest.mark.parametrize("shape", ["value int", "key int, value int"])
def test_empty_inputs(spark, shape):
    df = spark.createDataFrame([], shape)
    assert got(agg.reduce(df, "sum")) == got(agg.local_reduce(df, "sum")) == got(agg.reduce_with(df, min)) == []
    assert got(ordering.sort(df)) == got(ordering.sort_by_comparator(df, lambda a, b: a < b)) == []


def test_cogroup_with_an_empty_side(spark):
    a, none = pairs(spark, [(1, 2)]), pairs(spark, [])
    assert got(joins.cogroup(a, none)) == [(1, [2], [])]
    assert got(joins.cogroup(none, a)) == [(1, [], [2])]
    assert got(joins.cogroup(none, pairs(spark, []))) == []
    assert joins.cogroup(a, a).columns == ["key", "values"]


@pytest.mark.parametrize(
    "kind, keys",
    [
        ("tinyint", [-3, 0, 5]),
        ("double", [math.nan, -0.0, 0.0, 1.5]),
        ("timestamp", [datetime.datetime(2024, 1, 2), datetime.datetime(1960, 1, 1)]),
        ("boolean", [True, False]),
        ("binary", [b"", b"a", b"\xff"]),
        ("struct<a:int,b:string>", [(1, "x"), (2, None)]),
        ("decimal(20,0)", [None]),
        ("string", ["", "é", None]),
    ],
)
def test_keys_of_all_types(spark, kind, keys):
    df = spark.createDataFrame([(k, 1) for k in keys for _ in range(2)], f"key {kind}, value int")
    n = df.select("key").distinct().count()
    placed = exchange.placed(df, 4)
    assert placed.count() == len(keys) * 2
    assert placed.select("key", F.spark_partition_id().alias("p")).distinct().count() == n
    assert agg.reduce_by_key(df, "sum").count() == agg.group_by_key(df).count() == n
    matches = df.where("key is not null")
    assert joins.join(df, df.select("key", "value")).count() == joins.join(matches, matches).count()
    assert ordering.sort(df).count() == len(keys) * 2


@given(st.text(max_size=12))
@FEW
def test_fnv1a(spark, s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    assert spark.createDataFrame([(s,)], "s string").select(fnv1a(F.col("s"))).first()[0] == h


def test_hot_key_is_merged_before_it_moves(spark):
    """A key with nearly all rows: what reaches the opaque fold's last step is a row for each partition."""
    df = spark.range(0, 50_000, 1, 8).select(F.when(F.col("id") % 50 > 0, 0).otherwise(F.col("id")).alias("key"), F.lit(1).cast("long").alias("value"))
    want = got(agg.reduce_by_key(df, "sum"))
    assert got(agg.reduce_by_key_with(df, lambda a, b: a + b)) == want
    plan = agg.reduce_by_key(df, "sum")._jdf.queryExecution().toString()
    assert "partial_sum" in plan


def test_comparators(spark):
    ds = Dataset.slice(spark, ["b", "A", "c", "B", "a"], "value string")
    assert [x.lower() for x in ds.sort_with(lambda a, b: a.lower() < b.lower()).collect()] == ["a", "a", "b", "b", "c"]
    assert ds.sort(F.lower("value"), "value").collect() == ["A", "a", "B", "b", "c"]
    left = Dataset.slice(spark, [("A", 1), ("b", 2)], "key string, value int")
    right = Dataset.slice(spark, [("a", 3), ("C", 4)], "key string, value int")
    assert got(left.join_partitioned_sorted(right, F.lower, True, True).df) == sorted([("A", 1, 3), ("b", 2, None), ("C", None, 4)], key=repr)
    one = left.df.union(right.df).coalesce(1)
    assert got(agg.local_group_by_key(one, F.lower).select("key", "values")) == sorted([("A", [1, 3]), ("b", [2]), ("C", [4])], key=repr)
    by = Dataset(left.df.union(left.df)).reduce_by_user_defined_key("sum", F.lower("key")).collect()
    assert by == [("A", 2), ("b", 4)]


def test_flat_maps_agree(spark):
    ds = Dataset.slice(spark, ["a b", "", "c"], "value string")
    assert ds.flat_map("split(value, ' ')").collect() == ds.flat_map_with(lambda s: s.split(" "), "value string").collect() == ["a", "b", "", "c"]
    structs = ds.flat_map("transform(split(value, ' '), x -> struct(x as key, 1 as value))")
    assert structs.reduce_by_key("sum").collect() == [("", 1), ("a", 1), ("b", 1), ("c", 1)]


def test_filters_agree(spark):
    ds = Dataset.slice(spark, [(1, 2), (2, 1), (3, 3)], "key int, value int")
    assert ds.filter("key > value").collect() == ds.filter_with(lambda k, v: k > v).collect() == [(2, 1)]
    outer = Dataset.slice(spark, [(1, None), (2, 5)], "key int, value int")
    assert outer.filter("value is null").collect() == [(1, None)]


def test_partitioning_is_used_again_by_a_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select(F.col("id").alias("key"), F.col("id").alias("value"))
        plan = joins.join_co_partitioned(df, df, 4)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("ReusedExchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    from shardflow import catalog
    from tests.conftest import SMALL

    plan = catalog.queries()["filter_pair"](spark, SMALL)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    assert "GreaterThan(o_totalprice,1000.0)" in plan


@given(st.lists(st.text("abAB", max_size=3), max_size=40), st.integers(1, 6))
@FEW
def test_comparator_sorts_in_ranges(spark, words, shards):
    df = spark.createDataFrame([(w,) for w in words], "value string").repartition(3)
    out = ordering.sort_by_comparator(df, lambda a, b: a.lower() < b.lower(), shards=shards)
    have = [r[0] for r in out.collect()]
    assert sorted(have) == sorted(words) and [x.lower() for x in have] == sorted(x.lower() for x in words)


def test_opaque_steps_stay_parallel(spark):
    """The first step of an opaque fold and of an opaque sort run in all of their input's partitions."""
    df = spark.range(0, 1000, 1, 6).toDF("value")
    for out in (agg.reduce_with(df, max), ordering.sort_by_comparator(df, lambda a, b: a < b)):
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 1, false" not in text and "epartition" in text
    assert [r[0] for r in ordering.sort_by_comparator(df, lambda a, b: a > b).collect()] == list(range(999, -1, -1))


def test_opaque_fold_of_null_and_odd_float_keys(spark):
    add = lambda a, b: a + b
    whole = spark.createDataFrame([(None, 1), (None, 2), (3, 4)], "key bigint, value bigint").repartition(3)
    assert got(agg.reduce_by_key_with(whole, add)) == [(3, 4), (None, 3)]
    odd = spark.createDataFrame([(math.nan, 1), (math.nan, 2), (0.0, 4), (-0.0, 8), (None, 16)], "key double, value int").repartition(4)
    assert sorted(r["value"] for r in agg.reduce_by_key_with(odd, add).collect()) == [3, 12, 16]


WIDE = [9007199254740993, None, -9007199254740995, 1, None, (1 << 62) + 1]


def test_opaque_functions_keep_wide_numbers_beside_nulls(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(WIDE)], "key bigint, value bigint").repartition(3)
    ds = Dataset(df)
    assert sorted(ds.map_with(lambda k, v: (k, v), "key bigint, value bigint").collect()) == list(enumerate(WIDE))
    assert sorted(ds.filter_with(lambda k, v: v is not None and v > 1).collect()) == [(i, x) for i, x in enumerate(WIDE) if x is not None and x > 1]
    twice = ds.flat_map_with(lambda k, v: [(k, v)] * 2 if v is None else [], "key bigint, value bigint")
    assert sorted(twice.collect()) == [(1, None)] * 2 + [(4, None)] * 2
    total = ds.map("value").reduce_with(lambda a, b: (a or 0) ^ (b or 0)).collect()
    assert total == [9007199254740993 ^ -9007199254740995 ^ 1 ^ ((1 << 62) + 1)]
    kinds = Dataset(spark.createDataFrame([(datetime.date(2020, 1, 2), [1, None], {"a": 1.5})], "d date, l array<int>, m map<string,double>"))
    assert kinds.map_with(lambda d, n, m: (d.year, n, dict(m)["a"]), "y int, l array<int>, x double").collect() == [(2020, [1, None], 1.5)]
    assert ds.filter_with(lambda k, v: False).collect() == [] == ds.flat_map_with(lambda k, v: [], "x int").collect()


@pytest.mark.parametrize("n, keys, parts", [(500, 2, 7), (300, 1, 5), (200, 50, 3)])
def test_runs_go_on_across_ranges(spark, n, keys, parts):
    """Without shards the rows of one order are dealt over tasks; their runs are those of a walk."""
    r = random.Random(n)
    rows = [(i, None if (k := r.choice([0, 0, 0, r.randrange(keys + 1)])) == keys else f"k{k}", r.randrange(9)) for i in range(n)]
    df = spark.createDataFrame(rows, "at bigint, key string, value bigint").repartition(parts)
    want = []
    for _, k, v in rows:
        if want and want[-1][1] == k:
            want[-1][2] += v
        else:
            want.append([len(want) + 1, k, v])
    got = agg.fold_runs(df, "sum", "at")
    assert [[x["run"], x["key"], x["value"]] for x in got.orderBy("run").collect()] == want


def test_ties_of_a_comparator_are_dealt_over_ranges(spark):
    """A key that most rows share is sorted by several tasks, and the order stays."""
    df = spark.createDataFrame([("b" if i % 10 else "ac"[i // 10 % 2], i) for i in range(4000)], "key string, value bigint").repartition(4)
    out = ordering.sort_by_comparator(df, lambda a, b: a < b, shards=8)
    sizes = [x["n"] for x in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2000
    rows = out.collect()
    assert [x["key"] for x in rows] == ["a"] * 200 + ["b"] * 3600 + ["c"] * 200
    assert sorted(x["value"] for x in rows) == list(range(4000))
    many = ordering.sort_by_comparator(df, lambda a, b: a < b, shards=2, rows=300)
    assert many.rdd.getNumPartitions() == 14 and [x["key"] for x in many.collect()] == [x["key"] for x in rows]


def test_files_that_a_frame_names(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\n\nthree")
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes("käse\n".encode() + b"x" * 9_000_000 + b"\n")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.txt",) for n in "abc"] + [(None,)], "path string")
    got = [(r["path"][-5], r["value"]) for r in sources.text_of_listing(paths).collect()]
    assert sorted(got) == sorted([("a", "one"), ("a", "two"), ("a", ""), ("a", "three"), ("c", "käse"), ("c", "x" * 9_000_000)])
    with pytest.raises(Exception, match="gone"):
        sources.text_of_listing(spark.createDataFrame([(f"file://{tmp_path}/gone",)], "path string")).collect()


def test_fan_in(spark):
    a, b = (spark.createDataFrame([(x,)], "value int") for x in (1, 2))
    assert sorted(Dataset(fan_in(a, b, change=lambda d: d.select((F.col("value") * 2).alias("value")))).collect()) == [2, 4]
    assert Dataset(fan_in(a)).collect() == [1]


def test_groups_of_an_opaque_function_share_batches(spark):
    """As many batches as rows need, not one for each group; large groups, null, NaN and zero keys stay whole."""
    rows = [(k, v) for v in range(3000) for k in (None, math.nan, 0.0, -0.0, 5.0)] + [(float(k), 1) for k in range(100, 2100)]
    df = pairs(spark, rows, "key double, value int").repartition(5)
    out = agg.map_groups(df, lambda k, values: [(k, sum(1 for _ in values))], "key double, n bigint")
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    found = {repr(r.key): r.n for r in out.collect()}
    assert found == {"None": 3000, "nan": 3000, "0.0": 6000, "5.0": 3000} | {repr(float(k)): 1 for k in range(100, 2100)}


def test_groups_of_nested_keys_and_several_columns(spark):
    df = spark.createDataFrame([({"x": math.nan}, 1, "a"), ({"x": math.nan}, 2, None), ({"x": 1.0}, 3, "c")], "key struct<x:double>, a int, b string")
    out = agg.map_groups(df, lambda k, values: [(k["x"], sorted(values))], "x double, v array<struct<a:int,b:string>>")
    assert sorted((repr(r.x), [tuple(v) for v in r.v]) for r in out.collect()) == [("1.0", [(3, "c")]), ("nan", [(1, "a"), (2, None)])]


def test_group_map_with_odd_prices(spark, tmp_path):
    """Nulls don't count, NaN is the largest, a group of nulls has a null; null keys are a group."""
    rows = [(1, 5.0), (1, None), (1, 2.0), (2, None), (3, math.nan), (3, 1.0), (3, 9.0), (None, 4.0), (None, 1.5)]
    spark.createDataFrame(rows, "o_custkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    names, rows = of_spark(catalog.queries()["group_map_with"](spark, str(tmp_path)))
    assert (names, rows) == of_duckdb(catalog.oracle_sql()["group_map_with"], str(tmp_path))
    assert len(rows) == 4
