import hashlib
import re
from collections import defaultdict

import pytest

from shardflow.llm import exact_dedup
from shardflow.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from shardflow.llm.queries import oracle_sql, queries
from tests.conftest import SMALL
from tests.llm import cases
from tests.oracle import of_duckdb, of_spark


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((r[0], r[1] or ""))
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        done = False
        for m in members:
            kept = not done and m[0] == best[0] and len(m[1]) == len(best[1])
            done |= kept
            out.append((m[0], best[0], len(members), kept, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_awkward_rows(spark, salts):
    assert cases.rows(exact_duplicates(cases.docs(spark), salts=salts)) == brute(cases.awkward())


def test_query(spark):
    assert of_spark(queries()["op8_exact_dedup"](spark, SMALL)) == of_duckdb(oracle_sql()["op8_exact_dedup"], SMALL)


def test_digests_that_collide(spark, monkeypatch):
    """Full contents are compared: with a digest of one byte, results stay the same but for the digest shown."""
    from pyspark.sql import functions as F

    whole = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(whole(c, n), 1, 2))
    rows = cases.awkward() + [(100 + i, cases.prose(5, i), "en", "web", 1) for i in range(400)]
    got = [r[:4] + (r[4],) for r in cases.rows(exact_duplicates(cases.docs(spark, rows)))]
    want = sorted((r[:4] + (r[4][:2],) for r in brute(rows)), key=repr)
    assert got == want


def test_dropping(spark):
    plain = cases.docs(spark)
    out = drop_exact_duplicates(plain)
    assert out.columns == plain.columns and out.schema.simpleString() == plain.schema.simpleString()
    kept = [r for r in out.collect()]
    want = [(r[0], r[4]) for r in brute(cases.awkward()) if r[3]]
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    assert sorted(((r["doc_id"], sha(r["text"])) for r in kept), key=repr) == sorted(want, key=repr)
    assert drop_exact_duplicates(cases.clashing(plain)).columns == cases.clashing(plain).columns


def test_same_id_other_spacing(spark):
    """Of rows that share id and content, the longer text stays."""
    rows = [(1, "a b", "en", "w", 1), (1, "a  b", "en", "w", 1), (2, "ab", "en", "w", 1)]
    assert cases.rows(exact_duplicates(cases.docs(spark, rows)))[1][3] != cases.rows(exact_duplicates(cases.docs(spark, rows)))[0][3]
    assert [r["text"] for r in drop_exact_duplicates(cases.docs(spark, rows)).collect()] == ["a  b"]


def test_empty_and_clashes(spark):
    assert cases.rows(exact_duplicates(cases.docs(spark, []))) == []
    assert cases.rows(drop_exact_duplicates(cases.docs(spark, []))) == []
    cases.same_with_clashes(cases.docs(spark), exact_duplicates)


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}", "en", "w", 1) for i in range(3000)]
    got = exact_duplicates(cases.docs(spark, rows, 8))
    assert got.where("kept").count() == 1001
    assert got.where("group_size = 2000").select("keep_id").distinct().collect()[0][0] == 1


def test_one_row_repeated_very_often(spark):
    rows = [(7, "same  text", "en", "w", 1)] * 2000 + [(i, "same text", "en", "w", 1) for i in range(50)] + [(None, "x", "en", "w", 1)] * 500
    df = cases.docs(spark, rows, 8)
    got = exact_duplicates(df)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got.where("kept").collect()} == {(7, 7, 2050), (None, None, 500)}
    assert got.where("kept").count() == 2 and got.count() == len(rows)
    assert sorted((r["doc_id"], r["text"]) for r in drop_exact_duplicates(df).where("doc_id is not null").collect()) == [(7, "same  text")]
    assert drop_exact_duplicates(df).count() == 2


def test_ids_of_other_types(spark):
    """Strings are ids, too: the order is theirs."""
    df = spark.createDataFrame([("b", "x y"), ("a", "xy"), ("c", "x y"), (None, "x y"), ("b", "q"), ("b", "q"), (None, None), (None, "")], "doc_id string, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(df).collect()}
    assert got == {("b", "b", 4, True), ("a", "b", 4, False), ("c", "b", 4, False), (None, "b", 4, False), ("b", "b", 2, True), ("b", "b", 2, False), (None, None, 2, True), (None, None, 2, False)}
    assert cases.rows(drop_exact_duplicates(df).select("doc_id")) == [("b",), ("b",), (None,)]


def test_no_python_in_the_plan(spark):
    plan = exact_duplicates(cases.docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))
