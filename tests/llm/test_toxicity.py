import zlib
from itertools import combinations

import numpy as np
import pytest

from shardflow.llm import toxicity as tox
from shardflow.llm.queries import queries
from tests.conftest import SMALL
from tests.llm import cases

INSULTS = ("grobnik", "vlekhart", "smurzel", "dratpok")


def corpus(n=240):
    """Texts and labels: every other text has an insult."""
    texts, marks = [], []
    for i in range(n):
        t = cases.prose(30 + i % 20, 1000 + i)
        if i % 2:
            words = t.split(" ")
            words.insert(i % len(words), INSULTS[i // 2 % 4])
            t = " ".join(words)
        texts.append(t)
        marks.append(i % 2)
    return texts, marks


@pytest.fixture(scope="module")
def model():
    return tox.train(*corpus())


def brute_kernel(a, b):
    """Sum over common triples of the products of their summed weights, normalised, to the power."""

    def vector(s):
        c = [0, *(ord(x) - 96 for x in s), 0]
        c = tox.codes([s], len(s))[0].tolist()
        out = {}
        for t in combinations(range(len(c)), 3):
            if t[2] - t[0] <= tox.SPAN:
                k = tuple(c[i] for i in t)
                out[k] = out.get(k, 0) + tox.DECAY ** (t[2] - t[0] + 1)
        return out

    x, y = vector(a), vector(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    k = dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return k**tox.POWER if k >= tox.FLOOR else 0.0


def test_kernel():
    marks, words = ["grobnik", "smurzel", "aba"], ["grobnik", "grxobnik", "smurzelz", "abababa", "other", "ab", "grobniksmurzel"]
    who, rows = tox.Kernel(marks).rows(words)
    full = np.zeros((len(words), len(marks)))
    full[who] = rows
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            want = brute_kernel(w, m) if len(w) > 2 else 0.0
            assert full[i, j] == pytest.approx(want, abs=2e-4)
    assert full[0, 0] == pytest.approx(1, abs=1e-4)


def test_words_are_found_in_disguise(model):
    s = tox.Scorer(model)
    plain = cases.prose(60, 77)
    for w in INSULTS:
        for form in (w, w.upper(), f"'{w}!'", w[:3] + "x" + w[3:], w[:3] + w[2] + w[3:], ".".join(w), " ".join(w), w.replace("o", "0").replace("e", "3"), w + "s"):
            assert model.score(s.values([f"{plain} {form} {plain}"])[0]) >= 0.5, (w, form)


def test_clean_texts_stay(model):
    s = tox.Scorer(model)
    values = [model.score(v) for v in s.values([cases.prose(200, 5000 + i) for i in range(100)] + ["", " ", "a b c d e f", "x"])]
    assert max(values) < 0.5 and min(values) >= 0


def test_place_and_length_do_not_matter(model):
    s = tox.Scorer(model)
    long = cases.prose(20_000, 8)
    assert model.score(s.values([f"{long} grobnik"])[0]) >= 0.5 > model.score(s.values([long])[0])


def test_memory_of_words_changes_nothing(model, monkeypatch):
    texts = corpus(60)[0]
    want = tox.Scorer(model).values(texts)
    monkeypatch.setattr(tox, "WORDS", 5)
    s = tox.Scorer(model)
    assert [v for t in texts for v in s.values([t])] == pytest.approx(want)


def test_query(spark):
    got = {r["doc_id"]: r for r in queries()["op7_toxicity"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    marks = [(r["toxic"], got[r["doc_id"]]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic is not null").collect()]
    held = [(t, r["predicted"]) for t, r in marks if r["held_out"]]
    assert len(held) > 50 and np.mean([t == p for t, p in held]) >= 0.93


def test_held_out_labels_do_not_train(spark):
    texts, marks = corpus(100)
    docs = cases.of(spark, dict(enumerate(texts)))
    got, _ = tox.labelled(docs, cases.labels(spark, [(i, 0, m) for i, m in enumerate(marks)]))
    assert set(got) == {t for i, t in enumerate(texts) if not tox.held_out(i)}
    few, kinds = tox.labelled(docs, cases.labels(spark, [(i, 0, m) for i, m in enumerate(marks)]), sample=5)
    assert len(few) == 10 and sum(kinds) == 5


def test_repeated_ids_train_once(spark):
    """A hot id brings one row to the driver, and long texts stop at a bound in bytes."""
    marks = [i for i in range(60) if not tox.held_out(i)]
    rows = [(marks[0], f"copy {k % 7}", "en", "web", 1) for k in range(3000)] + [(i, f"text {i} " * 50, "en", "web", 1) for i in marks[1:]]
    known = cases.labels(spark, [(i, 0, i % 2) for i in marks] + [(marks[0], 0, 1)] * 40)
    got, kinds = tox.labelled(cases.docs(spark, rows), known)
    assert len(got) == len(kinds) == len(marks) and sum(x.startswith("copy") for x in got) == 1
    few, _ = tox.labelled(cases.docs(spark, rows), known, most=2000)
    assert 0 < len(few) < 6 and sum(map(len, few)) <= 2000
    assert tox.labelled(cases.docs(spark, rows), known, most=0) == ([], [])


def test_sentences():
    units = {w: tox.unit(w) for w in ("An", "id", "iot!", "g", "-", "r", "o", "b", "x", "you.", tox.BREAK)}
    got = list(tox.segments(tox.tokens("An id iot! g - r o b\nx you."), units))
    assert got == [["iot", "anid", "idiot"], ["grob"], ["you", "xyou"]]
    assert tox.tokens("a\n\nb") == ["a", tox.BREAK, tox.BREAK, "b"]
    assert [w for w in ("a", "a.", 'a!"', "a?)", "a,", "...") if tox.ends(w)] == ["a.", 'a!"', "a?)", "..."]


def test_values_by_brute_force(model):
    """A text's value is that of its highest sentence; a sentence adds up its different segments."""
    kernel = tox.Kernel(model.landmarks)

    def segment(u):
        who, rows = kernel.rows(tox.windows(u))
        return max((rows @ model.alpha).tolist(), default=0.0)

    def brute(text):
        words = tox.tokens(text)
        best = model.bias
        for s in tox.segments(words, {w: tox.unit(w) for w in words}):
            adds = {round(v, 9) for v in map(segment, dict.fromkeys(s)) if v}
            best = max(best, model.bias + sum(adds))
        return best

    texts = [*corpus(40)[0], "", "grob nik", "grobnik grobnik x", "vlek hart. a b", "s m u r z e l", "s - m - u r z e l now", "\n\n", "a grobnik.\nvlekhart smurzel", "ba" * 40 + "grobnik" * 5]
    for t, v in zip(texts, tox.Scorer(model).values(texts)):
        assert v == pytest.approx(brute(t), abs=1e-4), t


def test_long_segments_are_read_in_windows():
    for n in (25, 36, 37, 48, 49, 1000):
        u = "".join(chr(97 + i * i % 26) for i in range(n))
        cut = tox.windows(u)
        assert all(len(w) <= tox.WIDTH for w in cut)
        assert all(any(u[i : i + 12] in w for w in cut) for i in range(n - 11))


def test_split_insults_are_found(model):
    s = tox.Scorer(model)
    plain = cases.prose(60, 78)
    for form in ("grob nik", "vlek hart", "smur zel", "drat pok", "g - r o b - n i k"):
        assert model.score(s.values([f"{plain}. {form} {plain}"])[0]) >= 0.5, form


def test_awkward_rows(spark):
    texts, marks = corpus()
    rows = [(1000 + i, t, "en", "web", 1) for i, t in enumerate(texts)] + cases.awkward()
    known = cases.labels(spark, [(1000 + i, 0, m) for i, m in enumerate(marks)] + [(None, 1, 1), (5, None, 1), (4, None, None), (1000, 0, 0)])
    df = cases.docs(spark, rows)
    out = tox.toxicity(df, known)
    got = out.collect()
    assert sorted((repr(r["doc_id"]) for r in got)) == sorted(repr(r[0]) for r in rows)
    assert all(r["score"] is not None for r in got)
    same = {}
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        if r["doc_id"] is not None:
            assert same.setdefault(text_of[r["doc_id"]] or "", r["score"]) == r["score"]
    kept = tox.drop_toxic(df, known)
    assert kept.columns == df.columns
    assert kept.count() == sum(r["score"] < 0.5 for r in got)
    cases.same_with_clashes(df, lambda d: tox.toxicity(d, known))
    assert tox.drop_toxic(cases.clashing(df), known).columns == cases.clashing(df).columns


def test_without_usable_labels(spark):
    for known in (cases.labels(spark), cases.labels(spark, [(1, 0, 1), (2, 0, 1)]), cases.labels(spark, [(1, 0, 0)])):
        assert tox.toxicity(cases.docs(spark), known).where("predicted = 1").count() == 0
    assert cases.rows(tox.toxicity(cases.docs(spark, []), cases.labels(spark))) == []
