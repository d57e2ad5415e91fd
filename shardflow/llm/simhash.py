"""SimHash near-duplicates: fingerprints, links through pivot distance tables, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import keep, numbered, on_batches, pick
from shardflow.llm.components import components

#: Reference fingerprints of a pivot table.
PIVOTS = 32
#: Candidates with a common key up to which pairs are compared side by side.
SMALL = 32
#: Candidates with a common key beyond which they meet under finer keys instead.
LONG = 4096
_CHUNK = 1 << 16
_P = [f"p{k}" for k in range(PIVOTS // 8)]


def shingle_hashes(text: str | None, words: int, seed: int) -> tuple[np.ndarray, list[bytes]]:
    """XXH64 of a text's word shingles, repeats included, and its words. A-Z are lower-cased; fewer words than a shingle
    has are one shingle, also none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(w) - words + 1)), w


def fold(h: np.ndarray) -> int:
    """64 bits, each 1 if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words give 0."""
    h, w = shingle_hashes(text, words, seed)
    return fold(h) if w else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (a signed long) for every row."""
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), words, seed) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return on_batches(base, run, f"doc_id {kind}, fp bigint")


def masks(bits: int) -> list[int]:
    """Two fingerprints that differ in `bits` bits or fewer agree under one of these at least: of bits + 3
    blocks three are free of differences, whichever bits differ."""
    blocks = bits + 3
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b | c for a, b, c in combinations(parts, 3)]


def finer(mask: int, bits: int) -> list[int]:
    """Masks that hold a mask and five of bits + 5 parts of the other bits: a pair that agrees under the mask agrees
    under one of these. What is left open has few bits, so a bounded number of distinct fingerprints share a key."""
    parts = np.array_split([b for b in range(64) if not mask >> b & 1], bits + 5)
    return [mask | sum(1 << int(b) for part in some for b in part) for some in combinations(parts, 5)]


def references(seed: int = 7) -> np.ndarray:
    """The reference fingerprints, the same everywhere."""
    return np.random.default_rng(seed).integers(0, 1 << 63, PIVOTS, np.uint64) * np.uint64(2) + np.uint64(1)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the references, a row each. A pair within d differs by d at most
    in every coordinate (triangle inequality)."""
    return np.bitwise_count(fp[:, None] ^ references()[None, :]).astype(np.int8)


def pivot_columns(fp: Column) -> list[Column]:
    """The same as longs of eight distances each, in a fingerprint's row: computed once and carried along."""
    signed = [int(x) for x in references().view(np.int64)]
    byte = lambda k: F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed[k]))).cast("long"), 8 * (k % 8))
    return [reduce(Column.bitwiseOR, [byte(k) for k in range(at, at + 8)]).alias(f"p{at // 8}") for at in range(0, PIVOTS, 8)]


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of rows stay when the largest difference of a coordinate is held against `bits`. A few
    coordinates at a time: most pairs fall at the first."""
    at = np.arange(len(i))
    for k in range(0, PIVOTS, 4):
        at = at[np.abs(table[i[at], k : k + 4] - table[j[at], k : k + 4]).max(1, initial=0) <= bits]
    return at


def _pairs(fp: np.ndarray, table: np.ndarray, run: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside short runs of rows with equal `run`."""
    found = []
    for off in range(1, SMALL):
        i = np.flatnonzero(run[off:] == run[:-off]) if off < len(run) else []
        if not len(i):
            break
        at = survivors(table, i, i + off, bits)
        i = i[at]
        found.append((i := i[np.bitwise_count(fp[i] ^ fp[i + off]) <= bits], i + off))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 2
    return fp[i], fp[j]


def _forest(fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every component of a long run, one fewer than it has members at most. A member is
    compared with those that no component has yet and whose first pivot distance is near; the others fall by
    the rest of the pivot table."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    first, free = table[:, 0].astype(np.int64), np.ones(len(fp), bool)
    a, b = [], []
    for start in range(len(fp)):
        if not free[start]:
            continue
        free[start], stack = False, [start]
        while stack:
            i = stack.pop()
            lo, hi = np.searchsorted(first, first[i] - bits), np.searchsorted(first, first[i] + bits, "right")
            near = lo + np.flatnonzero(free[lo:hi])
            near = near[survivors(table, near, np.full(len(near), i), bits)]
            near = near[np.bitwise_count(fp[near] ^ fp[i]) <= bits]
            free[near] = False
            stack += near.tolist()
            a.append(np.full(len(near), fp[i]))
            b.append(fp[near])
    return np.concatenate(a) if a else fp[:0], np.concatenate(b) if b else fp[:0]


def _link(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp, pivot columns) sorted by t and key; a run can span batches."""

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        t, key, fp, *pivots = cols
        table = np.stack(pivots, 1).view(np.int8)
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])) if len(t) else np.empty(0, int)
        size = np.diff(np.append(new, len(t)))
        run, n, fp = np.repeat(np.arange(len(new)), size), np.repeat(size, size), fp.view(np.uint64)
        got = [_pairs(fp[few], table[few], run[few], bits)] if (few := (n > 1) & (n <= SMALL)).any() else []
        got += [_forest(fp[s : s + k], table[s : s + k], bits) for s, k in zip(new[size > SMALL], size[size > SMALL])]
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if not len(cols[0]):
            continue
        held.append(cols)
        if (cols[0][-1], cols[1][-1]) == (held[0][0][0], held[0][1][0]):
            continue  # all of it is one run
        cols = [np.concatenate(x) for x in zip(*held)]
        cut = len(cols[0]) - int(np.argmax(((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[::-1]))
        yield links([c[:cut] for c in cols])
        held = [[c[cut:] for c in cols]]
    if held:
        yield links([np.concatenate(x) for x in zip(*held)])


def _finer(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From (t, fp, pivot columns) rows (t, key, fp, pivot columns) under all finer masks; their t goes on counting behind
    each other."""
    fine = [np.array(finer(m, bits), np.uint64).view(np.int64) for m in masks(bits)]
    for b in batches:
        t, fp, *pivots = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
        for at in range(0, len(t), 1024):
            u, x = t[at : at + 1024], fp[at : at + 1024]
            under = np.stack([fine[k] for k in u]) if len(u) else np.empty((0, len(fine[0])), np.int64)
            place = u[:, None] * under.shape[1] + np.arange(under.shape[1])
            wide = [np.broadcast_to(c[at : at + 1024, None], under.shape) for c in (fp, *pivots)]
            cols = [place.astype(np.int32), under & x[:, None], *wide]
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in cols], ["t", "key", "fp", *_P])


def links(nodes: DataFrame, bits: int = 3, long: int = LONG) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that have the same components as all pairs within
    `bits` bits. Fingerprints meet under each mask of `masks`; only those that share a key are compared, by
    pivot distances first, which each fingerprint's rows carry. Short runs give all of their links, longer ones a spanning forest, so the rows don't
    grow with the square of a group. Keys that more than `long` fingerprints share are counted first (map-side) and
    never gathered: their members meet under finer keys, which bounds what a task holds."""
    keys = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for i, m in enumerate(masks(bits))))
    table = nodes.select("fp", *pivot_columns(F.col("fp")))
    met = table.select("fp", *_P, F.explode(keys).alias("k")).select("k.t", "k.key", "fp", *_P)
    hot = keep(met.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).select("t", "key"), "hot")
    if hot.head(1):
        crowd = on_batches(met.join(hot, ["t", "key"], "left_semi").select("t", "fp", *_P), lambda x: _finer(x, bits), "t int, key bigint, fp bigint, " + ", ".join(f"{p} bigint" for p in _P))
        first = F.lit(len(masks(bits))).cast("int")  # finer keys are counted behind the others
        met = met.join(hot, ["t", "key"], "left_anti").unionByName(crowd.withColumn("t", F.col("t") + first))
    met = met.repartition("t", "key").sortWithinPartitions("t", "key")
    return on_batches(met, lambda x: _link(x, bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id for every row: fingerprints within `bits` bits are linked, and
    component_id is the smallest doc_id that links reach.

    Rows with one fingerprint are one node, so groups of copies don't multiply; links, components and labels
    stay distributed, and a hot fingerprint meets its label in a join that Spark can split. Null and empty texts
    have fingerprint 0, which is linked like any other. Rows that repeat get equal results. A null id is the smallest
    only where a component has no other. An empty table gives no rows; other columns are ignored.
    """
    prints = keep(fingerprints(docs, id_col, text_col, words, seed), "prints")
    nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comps = keep(components(links(nodes, bits)), "components")
    linked = comps.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "component")
    labels = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    labels = keep(labels, "labels")
    out = prints.join(labels, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns. Ids name documents: of rows with
    one id that stays, one stays."""
    plain, at, names = numbered(docs, doc_id=id_col)
    found = keep(near_duplicates(docs, id_col, text_col, words, bits, seed), "found")
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int"))
    ids = keep(found.groupBy("doc_id").agg(stays.alias("stays"), F.count(F.lit(1)).alias("rows")), "ids")
    gone = ids.where("stays = 0").select(F.col("doc_id").alias("gone_id"))
    kept = plain.join(gone, F.col(at["doc_id"]).eqNullSafe(F.col("gone_id")), "left_anti")
    if ids.where("stays = 1 and rows > 1").head(1):
        kept = kept.dropDuplicates([at["doc_id"]])
    return kept.toDF(*names)
