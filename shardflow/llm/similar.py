"""Near-duplicates by shingle similarity: SimHash links first, wider ones after them; exact similarity decides.

Fingerprints within three bits are found as in `shardflow.llm.simhash`, under masks and by pivot distance tables. Such links
miss most pairs of a similarity of 0.8, whose fingerprints are some ten bits apart, and no masks of 64 bits find these
among very many. So what is still unlinked meets under minima of shingle hashes, too, and fingerprints and pivot distances
discard there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import if_few, keep, numbered, on_batches, pick
from shardflow.llm.components import components
from shardflow.llm.simhash import fold, pivot_columns, shingle_hashes
from shardflow.llm.simhash import links as bit_links

#: Keys of a document, each over ROWS minima: a pair of similarity 0.8 shares one with a chance of 1 - (1 - 0.8**4)**16,
#: which is 0.9998.
BANDS, ROWS = 16, 4
#: Keys under which documents meet first; only those that nothing was linked to meet under the others.
EARLY = 4
#: Bits by which the fingerprints of a pair of similarity 0.8 differ at most: ten are to be expected, and three the
#: standard deviation.
BITS = 24
#: Bits of the links that masks of fingerprints find.
CLOSE = 3
#: Nodes with a common key beyond which they meet in parts.
LONG = 50_000
#: Nodes with a common key that are compared by whole sets in one go.
BLOCK = 4096
_P = ("p0", "p1", "p2", "p3")
_MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 2048


def keys(h: np.ndarray) -> np.ndarray:
    """One number for each band: a hash of the band's minima over the distinct hashes of a document, each minimum under a
    multiplier of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK, None] * _MULTIPLIERS[None, :]
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(0), out=least)
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """doc_id, digest (of the words), fp, n (distinct shingles), keys and shingles (32 bits of each one's hash, which tell
    the shingles of two documents apart but for about n * n / 2**32 of them) for every row."""
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "digest", "fp", "n", "keys", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for x in part.column(1):
                    h, w = shingle_hashes(x.as_py(), words, seed)
                    own = np.unique(h)
                    rows.append((xxhash.xxh3_128_digest(b" ".join(w)), int(np.uint64(fold(h) if w else 0).view(np.int64)), len(own), keys(own), np.unique((own >> np.uint64(32)).astype(np.uint32)).view(np.int32)))
                cols = [part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return on_batches(base, run, f"doc_id {kind}, digest binary, fp bigint, n bigint, keys array<bigint>, shingles array<int>")


class _Rows:
    """Fingerprints, sizes and pivot distances of some nodes."""

    def __init__(self, cols: list[np.ndarray]):
        self.t, self.key, self.node, fp, self.n, flag, *pivots = cols
        self.fp, self.flag, self.table = fp.view(np.uint64), flag.astype(bool), np.stack(pivots, 1).view(np.int8)

    def starts(self) -> np.ndarray:
        """Where runs of one key begin."""
        return np.flatnonzero(np.concatenate([[True], (self.t[1:] != self.t[:-1]) | (self.key[1:] != self.key[:-1])]))

    def one(self, i: int) -> tuple:
        return self.node[i], self.fp[i], self.n[i], self.table[i]

    def near(self, other: tuple, j: np.ndarray, share: tuple[int, int]) -> np.ndarray:
        """Those of rows j that may be similar to another one: by their sizes, by the largest difference of a pivot distance,
        by their bits."""
        (_, fp, n, table), (up, down) = other, share
        j = j[down * np.minimum(n, self.n[j]) >= up * np.maximum(n, self.n[j])]
        for k in range(0, self.table.shape[1], 8):
            j = j[np.abs(self.table[j, k : k + 8] - table[k : k + 8]).max(1, initial=0) <= BITS]
        return j[np.bitwise_count(self.fp[j] ^ fp) <= BITS]


def _batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (a, b)], ["a", "b"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]


def _led(batches: Iterator[pa.RecordBatch], share: tuple[int, int], mark: bool = False) -> Iterator[pa.RecordBatch]:
    """From rows (t, key, node, fp, n, flag, pivot columns) in runs of one key, each in the order of the documents: pairs
    (a, b), a before b. The first of a run leads; those that may be similar to it are paired with it, and of the others
    the first leads on. Runs pass by; their leaders alone are held. mark: a leader is paired with itself, too."""
    open_: tuple | None = None
    leaders: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, a, b = _Rows(_columns(batch)), [], []
        edges = np.append(rows.starts(), len(rows.t)).tolist()
        for lo, hi in zip(edges, edges[1:]):
            if (key := (rows.t[lo], rows.key[lo])) != open_:
                open_, leaders = key, []
            free, at = np.arange(lo, hi), 0
            while len(free):
                if at == len(leaders):
                    leaders.append(rows.one(int(free[0])))
                    if mark:
                        a.append(rows.node[free[:1]])
                        b.append(rows.node[free[:1]])
                    free = free[1:]
                j = rows.near(leaders[at], free, share)
                if len(j):
                    a.append(np.full(len(j), leaders[at][0]))
                    b.append(rows.node[j])
                    free = free[~np.isin(free, j, assume_unique=True)]
                at += 1
        yield _batch(a, b)


def _tested(rows: _Rows, part: np.ndarray, sets: pa.ListArray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of one run: pairs of rows whose whole sets are similar, one of both flagged, and of different parts if the run has two.
    Rows are taken in their order; what is similar to one is linked to it and compared no further, so there are fewer
    pairs than rows."""
    a, b, (up, down) = [], [], share
    free = np.arange(len(part))
    if len(part) < 2 or not rows.flag.any():
        return free[:0], free[:0]
    at = sets.offsets.to_numpy().astype(np.int64)
    codes = np.unique(sets.values.to_numpy()[at[0] : at[-1]], return_inverse=True)[1].ravel()
    at, own = at - at[0], np.zeros(len(codes) + 1, bool)
    size, cross = np.diff(at), bool((part != part[0]).any())
    while len(free):
        i, free = int(free[0]), free[1:]
        j = free if rows.flag[i] else free[rows.flag[free]]
        j = rows.near(rows.one(i), j[part[j] != part[i]] if cross else j, share)
        if not len(j):
            continue
        ends = np.cumsum(size[j])
        places = np.arange(ends[-1]) + np.repeat(at[j] - ends + size[j], size[j])
        own[codes[at[i] : at[i + 1]]] = True
        common = np.add.reduceat(own[codes[places]].astype(np.int64), ends - size[j])
        own[codes[at[i] : at[i + 1]]] = False
        j = j[(up + down) * common >= up * (size[i] + size[j])]
        a.append(np.full(len(j), i))
        b.append(j)
        free = free[~np.isin(free, j, assume_unique=True)]
    return (np.concatenate(a), np.concatenate(b)) if a else (free, free)


def _flagged(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """From rows (t, key, node, fp, n, flag, part, shingles, pivot columns) in runs of one key: the links between flagged
    rows and all others of their run (`_tested`), verified here, so that what looks similar and isn't gives no rows.
    A run is held: it has some BLOCK rows of each of two parts at most."""

    def pairs(held: pa.Table) -> pa.RecordBatch:
        sets, plain = held.column("shingles").combine_chunks(), held.drop_columns(["part", "shingles"])
        part, cols, a, b = held.column("part").to_numpy(), _columns(plain), [], []
        edges = np.append(_Rows(cols).starts(), len(part)).tolist()
        for lo, hi in zip(edges, edges[1:]):
            i, j = _tested(_Rows([c[lo:hi] for c in cols]), part[lo:hi], sets.slice(lo, hi - lo), share)
            a.append(cols[2][lo:hi][i])
            b.append(cols[2][lo:hi][j])
        return _batch(a, b)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t, key = (batch.column(k).to_numpy() for k in (0, 1))
        if (t[-1], key[-1]) == (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()):
            continue  # all of it is one run
        last = (t == t[-1]) & (key == key[-1])
        cut = 0 if last.all() else len(t) - int(np.argmax(~last[::-1]))
        yield pairs(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield pairs(pa.Table.from_batches(held))


def links(nodes: DataFrame, shingles: DataFrame, share: tuple[int, int] = (4, 5), long: int = LONG) -> DataFrame:
    """a, b: pairs of similarity share[0] / share[1] or more (shared shingles by all of either) that connect every node
    (node, first, fp, n, keys) to the ones before it in the order of `first`, nulls last, that it is similar to, or to one
    that is connected to such a one: of two nodes that no link leads away from, none are similar.

    SimHash links come first: fingerprints within CLOSE bits, under masks and by pivot distance tables; equal fingerprints
    are one there, with a pair for each further node. What is still unlinked meets under common keys; in each such run
    leaders are paired with those that may be similar to them (`_led`). All pairs are verified by the whole sets of shingles
    (node, shingles). Nodes whose pairs all failed never led; they are compared with all that is still unlinked and has a
    key in common in a last round, set by set inside the tasks (`_flagged`), so no link is lost to the order. Keys
    that more than `long` nodes share are counted first (map-side): their nodes meet in parts of that size, and the
    leaders of the parts then under the whole key; in the last round every two parts of BLOCK nodes meet. Pairs tested once
    aren't tested again before that round. A run's pairs are one for each member at most and not the square of them,
    whatever looks similar and isn't."""
    up, down = share
    nodes = nodes.select("node", F.col("first").isNull().alias("last"), "first", "fp", "n", *pivot_columns(F.col("fp")), "keys")

    def met(some: DataFrame) -> DataFrame:
        return some.select("node", "last", "first", "fp", "n", "flag", *_P, F.posexplode("keys").alias("t", "key"))

    def close() -> DataFrame:
        """Pairs of nodes within CLOSE bits that connect all such nodes."""
        place = F.struct("last", "first", "node")
        heads = keep(nodes.groupBy("fp").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("many")), "heads")
        u, v = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"h{x}")) for x in "uv")
        far = bit_links(heads, CLOSE).distinct().join(u, "u").join(v, "v")
        far = far.select(F.least("hu", "hv")["node"].alias("a"), F.greatest("hu", "hv")["node"].alias("b"))
        same = nodes.select("fp", "node").join(heads.where("many > 1"), "fp").select(F.col("head.node").alias("a"), F.col("node").alias("b"))
        return far.unionByName(same.where("a <> b")).distinct()

    def candidates(rows: DataFrame, way: Callable, *more: str) -> DataFrame:
        rows = rows.repartition("t", "key").sortWithinPartitions("t", "key", "last", "first", "node")
        rows = rows.select("t", "key", "node", "fp", "n", F.col("flag").cast("int").alias("flag"), *more, *_P)
        return on_batches(rows, lambda x: way(x, share), "a bigint, b bigint").distinct()

    def leads(rows: DataFrame) -> DataFrame:
        crowded = keep(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > long), "crowded")
        if not crowded.head(1):
            return candidates(rows, _led)
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / long)).cast("int") + 1
        parts = rows.join(crowded, ["t", "key"]).withColumn("t", F.col("t") + BANDS * part).drop("many")
        found = keep(candidates(parts, lambda x, share: _led(x, share, True)), "parts")
        heads = rows.join(crowded.drop("many"), ["t", "key"], "left_semi").join(found.where("a = b").select(F.col("a").alias("node")), "node", "left_semi")
        rest = rows.join(crowded.drop("many"), ["t", "key"], "left_anti")
        return candidates(rest.unionByName(heads), _led).unionByName(found.where("a <> b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        """Only the sets that are asked for move."""
        pairs = keep(pairs, "pairs")
        asked = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
        sets = keep(shingles.join(if_few(asked), "node", "left_semi"), "sets")
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        # common / (sizes - common) >= up / down, in whole numbers
        return keep(both.select("a", "b", ((up + down) * common >= up * (F.size("sa") + F.size("sb"))).alias("good")), "tested")

    def ends(tested: DataFrame, good: bool) -> DataFrame:
        return tested.where("good" if good else "not good").select(F.col("b").alias("node")).distinct()

    def last(left: DataFrame) -> DataFrame:
        """Links of flagged nodes with all others that share a key with them."""
        asked = keep(left.where("flag").select(F.posexplode("keys").alias("t", "key")).distinct(), "asked")
        rows = keep(met(left).join(if_few(asked), ["t", "key"], "left_semi"), "hot")
        many = keep(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "many")
        rows = rows.join(many, ["t", "key"])
        # Every two parts of a key meet, each also on its own: a row goes to the pairs that its part is in.
        parts, block = F.ceil(F.col("many") / min(long, BLOCK)).cast("int"), F.col("t") + BANDS * (F.col("low") * F.col("parts") + F.col("high"))
        rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("low", F.least("part", "other").cast("long")).withColumn("high", F.greatest("part", "other")).withColumn("t", block)
        ids = keep(rows.select("node").distinct(), "asked")
        sets = keep(shingles.join(if_few(ids), "node", "left_semi"), "sets")
        return keep(candidates(rows.join(sets, "node"), _flagged, "part", "shingles"), "last")

    # What is linked needs no others: fingerprints link first, then most links are found under the first keys.
    every = nodes.withColumn("flag", F.lit(False))
    tested = verified(close())
    for way in (F.col("t") < EARLY, F.col("t") >= EARLY):
        left = every.join(if_few(keep(ends(tested, True), "linked")), "node", "left_anti")
        more = leads(met(left).where(way)).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = tested.unionByName(verified(more))
    linked = keep(ends(tested, True), "linked")
    failed = keep(ends(tested, False).join(linked, "node", "left_anti"), "failed")
    good = tested.where("good").select("a", "b")
    if failed.head(1):
        left = nodes.join(if_few(linked), "node", "left_anti").join(failed.withColumn("flag", F.lit(True)), "node", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
        good = good.unionByName(last(left))
    return good


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5), seed: int = 42, long: int = LONG) -> DataFrame:
    """doc_id, group_id for every row: documents whose sets of word shingles have a similarity (Jaccard) of share[0] /
    share[1] or more are linked (`links`), and group_id is the smallest doc_id that links reach.

    A-Z are lower-cased; documents with the same words are one node; fewer words than a shingle has are one shingle, and
    documents without words one group. A null id is the smallest only where a group has no other. Rows that repeat get
    equal results. An empty table gives no rows; other columns are ignored."""
    prints = keep(signatures(docs, id_col, text_col, words, seed).withColumn("row", F.monotonically_increasing_id()), "signatures")
    ones = keep(prints.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "nodes")
    mine = prints.select(F.col("row").alias("node"), "fp", "n", "keys")
    nodes = keep(ones.join(mine, "node").select("node", "first", "fp", "n", "keys"), "nodes")
    found = links(nodes, prints.select(F.col("row").alias("node"), "shingles"), share, long)
    comps = keep(components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    linked = comps.join(nodes.select("node", "first"), "node")
    least = linked.groupBy("root").agg(F.min("first").alias("group"))
    linked = linked.join(least, "root").select("node", "group")
    labels = keep(ones.join(linked, "node", "left").select("digest", F.coalesce("group", "first").alias("group_id")), "labels")
    return prints.select("doc_id", "digest").join(labels, "digest").select("doc_id", "group_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, share: tuple[int, int] = (4, 5), seed: int = 42) -> DataFrame:
    """One document of each group of `similar_groups`, the one with the smallest id, with all columns. Ids name documents:
    of rows with one id that stays, one stays."""
    plain, at, names = numbered(docs, doc_id=id_col)
    found = keep(similar_groups(docs, id_col, text_col, words, share, seed), "groups")
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("group_id")).cast("int"))
    ids = keep(found.groupBy("doc_id").agg(stays.alias("stays"), F.count(F.lit(1)).alias("rows")), "ids")
    gone = if_few(keep(ids.where("stays = 0").select(F.col("doc_id").alias("gone_id")), "gone"))
    kept = plain.join(gone, F.col(at["doc_id"]).eqNullSafe(F.col("gone_id")), "left_anti")
    if ids.where("stays = 1 and rows > 1").head(1):
        kept = kept.dropDuplicates([at["doc_id"]])
    return kept.toDF(*names)
