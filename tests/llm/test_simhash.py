import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shardflow.llm import simhash
from shardflow.llm.components import components
from shardflow.llm.queries import queries
from shardflow.llm.simhash import drop_near_duplicates, finer, fingerprint, links, masks, near_duplicates, pivot_table, survivors
from tests.conftest import SMALL
from tests.llm import cases


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps):
    """Smallest index that links reach, by trying all pairs."""
    fp = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3).tolist():
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(fps))]


def brute(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_roots(fps)
    best = {}
    for r, k in zip(rows, roots):
        if r[0] is not None:
            best[k] = min(best.get(k, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", best.get(k)) for r, f, k in zip(rows, fps, roots)), key=repr)


def test_awkward_rows(spark):
    assert cases.rows(near_duplicates(cases.docs(spark))) == brute(cases.awkward())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.rows(queries()["op5_simhash"](spark, SMALL)) == brute(rows)


def test_long_text_in_chunks(monkeypatch):
    text = cases.prose(700, 4)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert fingerprint(text) == brute_fingerprint(text)


def test_pivot_columns_are_the_table(spark):
    fp = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 200)
    df = spark.createDataFrame([(int(x),) for x in fp], "fp bigint")
    got = np.array([list(r)[1:] for r in df.select("fp", *simhash.pivot_columns(F.col("fp"))).collect()], np.int64)
    assert (got.view(np.int8) == pivot_table(fp.view(np.uint64))).all()


@pytest.mark.parametrize("bits", [0, 1, 3, 4])
def test_masks_cover_every_difference(bits):
    rng = np.random.default_rng(bits)
    for _ in range(2000):
        d = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
        assert any(m & d == 0 for m in masks(bits))


def test_pivot_tables_lose_no_pair():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 500, np.uint64)
    near = fp ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, np.uint64))
    table = pivot_table(np.concatenate([fp, near]))
    assert len(survivors(table, np.arange(500), np.arange(500, 1000), 3)) == 500
    far = survivors(table, np.arange(499), np.arange(1, 500), 3)
    assert len(far) < 50  # most pairs that are far apart are discarded


@pytest.mark.parametrize("bits", [1, 3])
def test_finer_masks_cover_every_difference(bits):
    rng = np.random.default_rng(bits)
    for m in masks(bits):
        open_ = [b for b in range(64) if not m >> b & 1]
        fine = finer(m, bits)
        assert all(f & m == m and 64 - f.bit_count() <= bits * -(-len(open_) // (bits + 5)) for f in fine)
        for _ in range(100):
            d = sum(1 << int(b) for b in rng.choice(open_, bits, replace=False))
            assert any(f & d == 0 for f in fine)


@pytest.mark.parametrize("long", [1, 20, 4096])
@pytest.mark.parametrize("n, spread", [(300, 6), (1500, 3), (800, 12)])
def test_links_span_the_same_components(spark, n, spread, long):
    """Crowded fingerprints: around a few centres, in chains and in long runs."""
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 4, np.uint64)
    fp = set()
    for i in range(n):
        x = int(centres[i % 4])
        for b in rng.choice(64, int(rng.integers(0, spread)), replace=False):
            x ^= 1 << int(b)
        fp.add(x)
    fp = sorted(fp)
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in components(links(nodes, long=long)).collect()}
    roots = brute_roots(fp)
    classes, mine = {}, {}
    for x, k in zip(signed, roots):
        classes.setdefault(k, set()).add(x)
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(300)], [(1, 2), (2, 1), (1, 2), (5, 4), (4, 6)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert cases.rows(components(df)) == sorted(((x, root[x]) for x in linked), key=repr)


def test_dropping(spark):
    plain = cases.docs(spark)
    out = drop_near_duplicates(plain)
    assert out.columns == plain.columns
    ids = [r["doc_id"] for r in out.collect()]
    want = {i for i, _, c in brute(cases.awkward()) if i == c}
    assert len(ids) == len(set(ids)) and set(ids) == want
    assert drop_near_duplicates(cases.clashing(plain)).columns == cases.clashing(plain).columns


def test_near_copies_meet_and_others_do_not(spark):
    base = cases.prose(400, 5)
    words = base.split(" ")
    edited = " ".join([*words[:200], "changed", *words[201:]])
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(cases.of(spark, {1: base, 2: edited, 3: cases.prose(400, 6)})).collect()}
    near = bin(fingerprint(base) ^ fingerprint(edited)).count("1") <= 3
    assert got[3] == 3 and (got[2] == 1) == near


def test_empty_and_clashes(spark):
    assert cases.rows(near_duplicates(cases.docs(spark, []))) == []
    assert cases.rows(drop_near_duplicates(cases.docs(spark, []))) == []
    cases.same_with_clashes(cases.docs(spark), near_duplicates)
