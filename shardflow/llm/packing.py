"""Best-fit packing by exact-complement hashing over length counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardflow.llm.common import keep, on_batches, pick
from shardflow.llm.tokens import ids

Slot = tuple[int, int, int, int, int]


def sums(single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of pair and triple sums: whether two, or three, of the lengths that are there make a length."""
    one = single.astype(np.float32)
    two = (np.convolve(one, one)[: len(one)] > 0.5).astype(np.float32)
    return two > 0.5, np.convolve(two, one)[: len(one)] > 0.5


def combination(free: np.ndarray, gap: int, single: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> list[int]:
    """Lengths of one, two or three free pieces that fill the gap exactly, long ones first; none: []. single, pair and
    triple index the sums that are there: whether a piece, two or three make a length. A sum that is there may need
    more pieces of a length than are free, so counts decide."""
    if single[gap]:
        return [gap]
    if pair[gap]:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        fit = a[single[a] & single[gap - a] & ((2 * a != gap) | (free[a] > 1))]
        if len(fit):
            return [int(fit[0]), gap - int(fit[0])]
    if not triple[gap]:
        return []
    for a in np.flatnonzero(single[:gap] & pair[gap:0:-1])[::-1].tolist():
        rest = gap - a
        b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
        c = rest - b
        need = lambda x: (x == a).astype(int) + (x == b) + (x == c)
        fit = b[single[b] & single[c] & (free[b] >= need(b)) & (free[c] >= need(c)) & (free[a] >= need(np.full_like(b, a)))] if len(b) else b
        if len(fit):
            return [a, int(fit[0]), rest - int(fit[0])]
    return []


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Slots (length, first, n, sequence, offset): of the pieces of a length, those numbered first to first + n - 1
    go to sequences from `sequence` on, one each, at `offset`.

    From long to short, a piece opens a sequence and its gap looks for an exact complement; failing that, the
    longest free piece that fits goes in (best fit) and what is left of the gap looks again. Each step serves as many
    equal sequences at once as the counts allow and so uses up a length: the steps are bounded by the capacity,
    whatever the number of documents.
    """
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] += n
    used, slots, sequence = np.zeros(capacity + 1, np.int64), [], 0
    single = free > 0

    pair, triple = sums(single)
    while single.any():
        top = int(np.flatnonzero(single)[-1])
        pieces, gap = [top], capacity - top
        free[top] -= 1
        single[top] = free[top] > 0
        while gap:
            found = combination(free, gap, single, pair, triple)
            if not found:
                fit = np.flatnonzero(single[: gap + 1])
                if not len(fit):
                    break
                found = [int(fit[-1])]
            for x in found:
                free[x] -= 1
                single[x] = free[x] > 0
            pieces += found
            gap -= sum(found)
        for x in pieces:
            free[x] += 1
        need = np.bincount(pieces, minlength=capacity + 1)
        times = int((free[need > 0] // need[need > 0]).min())
        free -= times * need
        offset = 0
        for x in pieces:
            slots.append((x, int(used[x]), times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
        if (single != (now := free > 0)).any():
            single = now
            pair, triple = sums(single)
    return slots


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place: `place` numbers the pieces of a length that task
    `part` made."""
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = ids(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, who = [], []
            texts = (t for k in range(0, batch.num_rows, 128) for t in encoder.encode(batch.column(1).slice(k, 128).to_pylist()))
            for at, data in enumerate(texts):
                data += tail
                n = len(data) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, int(seen[length])))
                    who.append(at)
                    seen[length] += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    return on_batches(base, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint", "ids")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A document's ids (null text: none) and the id `end` are one piece; only longer ones are cut, into pieces of
    `capacity` and a rest. The driver gets how many pieces have each length, `capacity` numbers at most, and plans
    sequences by counts (`plan`); a piece finds its sequence by its number among those of its length: its task's
    place among the tasks, then its place in the task. No task sees all pieces of a length. The pieces are
    written before they are numbered, so lost executors can't renumber them. Equal rows are packed each. An
    empty table gives no rows; other columns are ignored.
    """
    made = keep(pieces(docs, vocabulary, capacity, end, id_col, text_col), "pieces")
    counts = keep(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", before.alias("before"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = sorted(plan(totals, capacity))
    length, first, _, sequence, offset = (np.array(x, np.int64) for x in (zip(*slots) if slots else [()] * 5))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    key = (length << 44) + first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            at, number = (col[n].to_numpy() for n in ("length", "number"))
            k = np.searchsorted(key, (at << 44) + number, "right") - 1
            yield pa.RecordBatch.from_arrays([*(col[n] for n in names[:5]), pa.array(sequence[k] + number - first[k]), pa.array(offset[k])], names)

    numbered = made.join(starts, ["length", "part"]).withColumn("number", F.col("before") + F.col("place"))
    kind = made.schema["doc_id"].dataType.simpleString()
    return on_batches(numbered.select(*names[:5], "number"), place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
