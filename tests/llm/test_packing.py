import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardflow.llm.packing import combination, pack, plan, sums
from shardflow.llm.queries import VOCABULARY, queries
from shardflow.llm.tokens import Ids
from tests.conftest import SMALL
from tests.llm import cases


def brute_pieces(rows, capacity=2048):
    t = Tokenizer.from_file(VOCABULARY)
    out = []
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check(rows, got, capacity=2048):
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_pieces(rows, capacity)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def first_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, room in enumerate(bins):
            if room >= x:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=20))
@settings(max_examples=150, deadline=None)
def test_plans_place_every_piece_once(counts):
    slots = plan(counts, 40)
    placed, room = Counter(), defaultdict(list)
    for length, first, n, sequence, offset in slots:
        for k in range(n):
            placed[length, first + k] += 1
            room[sequence + k].append((offset, length))
    assert placed == Counter({(x, k): 1 for x, n in counts.items() for k in range(n)})
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    lengths = [x for x, n in counts.items() for _ in range(n)]
    assert len(room) <= first_fit_decreasing(lengths, 40) + 1


@given(st.lists(st.integers(0, 3), min_size=20, max_size=20), st.integers(1, 19))
@settings(max_examples=200, deadline=None)
def test_exact_complements_are_found(free, gap):
    free = np.array([0, *free[1:]])
    single = free > 0
    pair, triple = sums(single)
    found = combination(free, gap, single, pair, triple)
    some = np.flatnonzero(single).tolist()
    assert set(np.flatnonzero(pair).tolist()) == {a + b for a in some for b in some if a + b < 20}
    assert set(np.flatnonzero(triple).tolist()) == {a + b + c for a in some for b in some for c in some if a + b + c < 20}
    ones = [a for a in range(1, 20) if free[a]]
    fits = lambda c: sum(c) == gap and all(free[x] >= n for x, n in Counter(c).items())
    there = any(fits(c) for c in [(a,) for a in ones] + [(a, b) for a in ones for b in ones] + [(a, b, c) for a in ones for b in ones for c in ones])
    assert bool(found) == there and (not found or fits(tuple(found)))


def test_steps_are_bounded_by_the_capacity():
    rng = np.random.default_rng(3)
    counts = {i: int(rng.integers(1, 10**7)) for i in range(1, 257)}
    assert len(plan(counts, 256)) < 6 * 256


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in cases.awkward()]
    check(rows, pack(cases.docs(spark), VOCABULARY).collect())


@pytest.mark.parametrize("n", [2046, 2047, 2048, 2049, 4095, 4096])
def test_borders_of_pieces(spark, n):
    text = " ".join(["a"] * n)
    assert len(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids) == n
    assert check([(1, text)], pack(cases.of(spark, {1: text}), VOCABULARY).collect()) == -(-(n + 1) // 2048)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op6_packing"](spark, SMALL).collect()
    n = check(rows, got)
    lengths = [r["length"] for r in got]
    assert n <= min(first_fit_decreasing(lengths, 2048), -(-sum(lengths) // 2048) + 2)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_by_words_are_ids_of_the_text(text):
    text = text.encode("utf-8", "replace").decode()
    want = Tokenizer.from_file(VOCABULARY) if not hasattr(test_ids_by_words_are_ids_of_the_text, "t") else test_ids_by_words_are_ids_of_the_text.t
    test_ids_by_words_are_ids_of_the_text.t = want
    if not hasattr(test_ids_by_words_are_ids_of_the_text, "own"):
        test_ids_by_words_are_ids_of_the_text.own = Ids(VOCABULARY, remember=50)
    got = np.frombuffer(test_ids_by_words_are_ids_of_the_text.own.encode([text])[0], "<u4").tolist()
    assert got == want.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|> Y <|", "<|ENDOFTEXT|>", "don't I'LL we're", "café!! 12,345.67", "a b c　d", "İstanbul", "naıve.", "ﬁsh?", "\U0001f600\U0001f600!", "áb", "\x1c\x1d\x1e\x1f\x85x"])
def test_odd_texts(text):
    want = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Ids(VOCABULARY).encode([text])[0], "<u4").tolist() == want


def test_empty_and_clashes(spark):
    assert cases.rows(pack(cases.docs(spark, []), VOCABULARY)) == []
    df = cases.docs(spark, parts=1)
    cases.same_with_clashes(df, lambda d: pack(d, VOCABULARY).select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_plain_words_by_the_model_alone():
    """Every letter below U+0250 in words of its own, with marks behind, against the tokenizer's way through all its steps."""
    t, own = Tokenizer.from_file(VOCABULARY), Ids(VOCABULARY)
    letters = [chr(c) for c in range(33, 0x260) if chr(c).isalpha()]
    words = [f"{a}{c}{b}{m}" for c in letters for a, b, m in (("", "", ""), ("th", "er", ""), ("", "e", "..."), ("s", "", "%%%'"), ("x", "x", "<|"), ("q", "", "'s"))]
    for w in words:
        assert np.frombuffer(own.encode([w])[0], "<u4").tolist() == t.encode(w, add_special_tokens=False).ids, w
