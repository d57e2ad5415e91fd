import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shardflow.llm.mixing import mix, mixed
from shardflow.llm.queries import queries
from tests.conftest import SMALL
from tests.llm import cases


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(words: dict, weights=(5, 2, 1), limit=3.0):
    """By raising one source at a time until none is above its limit."""
    names = sorted(words, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(words.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        above = [s for s in free if rest * weight[s] / share > limit * words[s]]
        if not above:
            return fixed | {s: rest * weight[s] / share for s in free}
        fixed |= {s: limit * words[s] for s in above}


def check(rows, got, limit=3.0):
    words = defaultdict(int)
    for r in rows:
        words[r[3]] += size(r[1])
    want = brute_targets(words) if rows else {}
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r[0], size(r[1])) for r in rows if r[0] is not None)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == words[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= limit * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]


def test_awkward_rows(spark):
    check(cases.awkward(), mix(cases.docs(spark)).collect())


def test_sources_by_code_point_and_turns(spark):
    names = ["b", "a", "Z", "é", "￮", "\U0001f600", None, "", "aa", "0"]
    rows = [(i, cases.prose(20 + i % 37, i), "en", names[i % len(names)], 1) for i in range(900)]
    check(rows, mix(cases.docs(spark, rows)).collect())


def test_targets_that_reach_their_limit(spark):
    """Small sources stop at three times their size; what they can't take goes on by weight, also in cascades."""
    rows = [(i, cases.prose(40, i), "en", "a" if i < 3 else "b" if i < 12 else "c", 1) for i in range(400)]
    got = mix(cases.docs(spark, rows)).collect()
    check(rows, got)
    assert {r["copies"] for r in got if r["source"] == "a"} == {3}


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], 0) for r in docs.collect()]
    got = queries()["op2_mixing"](spark, SMALL).collect()
    check(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries()["op2_mixing"](spark, SMALL).collect()))


def test_inclusion_follows_the_odds(spark):
    """Over many seeds, documents of a source are drawn as often as each other, whatever their length."""
    rows = [(i, cases.prose(10 if i % 2 else 40, i), "en", "a" if i < 40 else "b", 1) for i in range(120)]
    df = cases.docs(spark, rows).cache()
    n = defaultdict(float)
    for seed in range(6):
        for r in mix(df, seed=seed).collect():
            if r["source"] == "b":
                n[r["size"]] += r["copies"] / (6 * 40)
    assert abs(n[10] - n[40]) < 0.12


def test_pareto_order_by_brute_force(spark):
    """With document weights: certain copies first, then the smallest odds ratios until the words are nearest."""
    df = spark.createDataFrame([(i, cases.prose(5 + i % 11, i), "s", 0.2 + (i % 5)) for i in range(200)], "doc_id bigint, text string, source string, w double")
    got = mix(df, weights=(1,), weight_col="w").withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(42), "doc_id"), 11) + 0.5) / F.lit(float(1 << 53))).collect()
    words = sum(r["size"] for r in got)
    expect = {r["doc_id"]: min(3.0, 1.0 * (0.2 + r["doc_id"] % 5)) for r in got}
    left = words - sum(int(expect[r["doc_id"]]) * r["size"] for r in got)
    order = []
    for r in got:
        p = expect[r["doc_id"]] - int(expect[r["doc_id"]])
        if p > 0:
            order.append(((r["u"] / (1 - r["u"])) / (p / (1 - p)), r["doc_id"], r["size"]))
    drawn, upto = set(), 0
    for _, doc, n in sorted(order):
        upto += n
        if upto - n / 2 > left:
            break
        drawn.add(doc)
    assert {r["doc_id"] for r in got if r["copies"] > int(expect[r["doc_id"]])} == drawn


def test_rows_without_ids_draw_each(spark):
    """Rows that share an id, or have none, and repeat with their texts are drawn one by one, near the target."""
    rows = [(None, cases.prose(40, i % 7), "en", "a", 1) for i in range(500)] + [(7, cases.prose(60, 1), "en", "b", 1)] * 300 + [(i, cases.prose(30, i), "en", "c", 1) for i in range(100, 400)]
    df = cases.docs(spark, rows, 5).cache()
    got = mix(df).collect()
    check(rows, got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 60 for s, t in target.items())
    assert len({r["copies"] for r in got if r["doc_id"] == 7}) == 2
    want, have = defaultdict(int), defaultdict(int)
    for r in got:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for r in mixed(df).collect():
        have[r["doc_id"], r["source"], size(r["text"])] += 1
    assert {k: v for k, v in want.items() if v} == dict(have)


def test_a_long_text_at_the_cut_is_passed_over(spark):
    """The words come near the target though one text has more than the target lacks, wherever it stands in the order."""
    for seed in range(4):
        rows = [(i, cases.prose(20 + i % 9, i), "en", "a", 1) for i in range(150)] + [(900, cases.prose(4000, 3), "en", "b", 1)] + [(1000 + i, cases.prose(25, i), "en", "b", 1) for i in range(200)]
        got = mix(cases.docs(spark, rows), weights=(3, 1), seed=seed).collect()
        target = next(r["target"] for r in got if r["source"] == "b")
        taken = sum(r["taken"] for r in got if r["source"] == "b")
        assert abs(taken - target) <= 0.01 * target + 25, seed


def test_only_long_texts(spark):
    """Where nothing fits the nearest is taken."""
    rows = [(i, cases.prose(400, i), "en", "a", 1) for i in range(9)] + [(20, cases.prose(10, 1), "en", "b", 1), (21, cases.prose(3000, 2), "en", "b", 1)]
    got = mix(cases.docs(spark, rows)).collect()
    check(rows, got)
    assert sum(r["taken"] for r in got if r["source"] == "b") == 3010


def test_uniform_stays_inside():
    assert 1 - 2.0**-53 < 1 and (1 - 2.0**-53) / (1 - (1 - 2.0**-53)) > 0


def test_rows_of_the_mix(spark):
    plain = cases.docs(spark)
    out = mixed(plain)
    assert out.columns == plain.columns
    want = defaultdict(int)
    for r in mix(plain).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    have = defaultdict(int)
    for r in out.collect():
        have[r["doc_id"], r["source"]] += 1
    assert {k: v for k, v in want.items() if v} == dict(have)
    assert mixed(cases.clashing(plain)).columns == cases.clashing(plain).columns


def test_empty_and_clashes(spark):
    assert cases.rows(mix(cases.docs(spark, []))) == []
    assert cases.rows(mixed(cases.docs(spark, []))) == []
    none = mix(cases.docs(spark, [(1, None, "en", "a", 0), (2, " ", "en", None, 0)])).collect()
    assert {(r["doc_id"], r["taken"]) for r in none} == {(1, 0), (2, 0)}
    cases.same_with_clashes(cases.docs(spark), mix)


def test_no_python_in_the_plan(spark):
    plan = mix(cases.docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"))
