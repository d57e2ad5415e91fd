import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardflow.llm.quality import BASE, FEATURES, Trees, fit, held_out, labelled, quality, repeated, statistics
from shardflow.llm.queries import queries
from tests.conftest import SMALL
from tests.llm import cases


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dups = set(), 0
    for x in lines:
        dups += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    n = [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside)]
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


@given(st.text(alphabet="ab \n\t#|é\U0001f600 \x85", max_size=80))
@settings(max_examples=300, deadline=None)
def test_statistics(text):
    assert tuple(statistics(text)[0]) == brute(text)[:5]


@given(st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=200, deadline=None)
def test_repeats_with_many_kinds_of_words(ids):
    a = np.array(ids, np.int64)
    want = brute(" ".join(map(str, ids)))[4]
    assert repeated(a, 4) == want
    assert repeated(a * 400_000, 2_000_000) == want


def test_awkward_rows(spark):
    got = cases.rows(quality(cases.docs(spark), cases.labels(spark)).select("doc_id", *BASE, "base_failed"))
    assert got == sorted(((r[0], *brute(r[1])) for r in cases.awkward()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op4_quality"](spark, SMALL)
    assert cases.rows(got.select("doc_id", *BASE, "base_failed")) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert not got.where("base_failed and kept").count()
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality is not null").collect()}
    seen = [(r["kept"], good[r["doc_id"]]) for r in got.collect() if r["doc_id"] in good and held_out(r["doc_id"])]
    assert len(seen) > 30 and np.mean([k == bool(g) for k, g in seen]) >= 0.85


def test_held_out_rows_do_not_train(spark):
    texts = {i: cases.prose(10 + i, i) for i in range(50)}
    docs, known = cases.of(spark, texts), cases.labels(spark, [(i, i % 2, 0) for i in range(50)])
    x, y = labelled(docs, known)
    want = [i for i in range(50) if not held_out(i)]
    assert x.tolist() == [statistics(texts[i])[1] for i in want] and y.tolist() == [i % 2 for i in want]
    few, _ = labelled(docs, known, sample=7)
    assert len(few) == 7 and all(r in x.tolist() for r in few.tolist())


def test_repeated_ids_train_once(spark):
    """However often an id repeats, in documents or labels, the driver gets one row of numbers."""
    marks = [i for i in range(40) if not held_out(i)]
    rows = [(marks[0], cases.prose(30, k % 5), "en", "web", 1) for k in range(3000)] + [(i, cases.prose(20, i), "en", "web", 1) for i in marks[1:]]
    x, y = labelled(cases.docs(spark, rows), cases.labels(spark, [(i, i % 2, 0) for i in marks] + [(marks[0], 1, 0)] * 50))
    assert len(x) == len(y) == len(marks)
    assert x[0].tolist() == min(statistics(cases.prose(30, k))[1] for k in range(5))


@pytest.fixture(scope="module")
def trees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(FEATURES)))
    y = (x[:, 0] - 1.5 * x[:, 2] + np.sin(3 * x[:, 3]) + 0.3 * rng.normal(size=3000) > 0).astype(float)
    return fit(x, y, list(FEATURES.values())), x, y


def test_trees_learn_and_keep_to_their_constraints(trees):
    model, x, y = trees
    assert np.mean((model.margins(x) > 0) == (y > 0)) > 0.85
    grid = np.linspace(-4, 4, 60)
    for j, sign in enumerate(FEATURES.values()):
        if sign:
            for base in x[:40]:
                rows = np.repeat(base[None], len(grid), 0)
                rows[:, j] = grid
                assert (sign * np.diff(model.margins(rows)) >= -1e-9).all()


def test_flat_nodes_score_as_a_walk_does(trees):
    model, x, _ = trees
    for row in x[:50]:
        total = model.start
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - len(f)]
        assert model.margins(row[None])[0] == pytest.approx(total)


def test_without_labels_rules_alone_decide(spark):
    got = {r["doc_id"]: r["kept"] for r in quality(cases.of(spark, {1: cases.prose(200, 1), 2: "too short"}), cases.labels(spark)).collect()}
    assert got == {1: True, 2: False}
    assert isinstance(Trees(np.zeros((1, 1), int), np.full((1, 1), np.inf), np.zeros((1, 2)), 1.0).margins(np.zeros((2, 16))), np.ndarray)


def test_empty_and_clashes(spark):
    none = cases.labels(spark)
    assert cases.rows(quality(cases.docs(spark, []), none)) == []
    cases.same_with_clashes(cases.docs(spark), lambda d: quality(d, none))
