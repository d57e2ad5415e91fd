"""Words and the places they stand at (document and line from 0), in Arrow batches: no row is made for a single place.

Lines end at newlines; words are parted by spaces, tabs, form feeds and carriage returns, as RE2 has it in [^\\S\\n]+. Places
sort by document and line and are written as `document:line`, joined by commas; documents without an id have words, but no
places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.session import ship

#: Bytes of text whose words are grouped at once, and of packed places that are written out at once.
TEXT, PACKED = 12 << 20, 2 << 20
#: Rows of a batch that goes to Spark; places of one word that are written out at once.
ROWS, PLACES = 1 << 16, 1 << 20


def by_word(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(key, places): a row for each word. Tasks send packed places, a row for each word of some MB of text."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where("text is not null")
    packed = own.mapInArrow(_pack, "key string, packed binary")
    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(_unpack, "key string, places string")


def by_segment(docs: DataFrame, doc: str, text: str, segment: Column) -> DataFrame:
    """(key, segment, places): a row for each word and segment, a whole number that depends on the document. Texts
    move to their segment's task, which is less than their words with places."""
    ship(docs.sparkSession)
    own = docs.select(segment.cast("bigint").alias("segment"), F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where("text is not null")
    return own.repartition("segment").sortWithinPartitions("segment").mapInArrow(_segments, "key string, segment bigint, places string")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in _parts(b):
            keys, *places = _grouped(part.column("doc"), part.column("text"))
            packed = _packed(*places)
            del places
            pa.default_memory_pool().release_unused()
            yield from _batches([keys, packed], ["key", "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole(batches, "key", "packed", PACKED):
        first = _firsts(t.column("key"))
        doc, line, ends = _unpacked(t.column("packed"))
        starts = np.append(0, ends)[np.append(first, len(ends))]
        word = np.repeat(np.arange(len(first)), np.diff(starts))
        same = word[1:] == word[:-1]
        if (same & ((doc[1:] < doc[:-1]) | (doc[1:] == doc[:-1]) & (line[1:] < line[:-1]))).any():
            order = np.lexsort((line, doc, word))
            doc, line = doc[order], line[order]
        yield from _batches([t.column("key").take(pa.array(first)), _written(doc, line, starts)], ["key", "places"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole(batches, "segment", "text", TEXT):
        first = np.append(_firsts(t.column("segment")), t.num_rows)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            keys, doc, line, starts = _grouped(t.column("doc").slice(a, z - a), t.column("text").slice(a, z - a))
            segment = t.column("segment").slice(a, 1).take(pa.array(np.zeros(len(keys), np.int64)))
            yield from _batches([keys, segment, _written(doc, line, starts)], ["key", "segment", "places"])


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about TEXT bytes, or one row."""
    size = np.cumsum(_numbers(pc.binary_length(b.column("text"))).astype(np.int64))
    a = 0
    while a < b.num_rows:
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + TEXT, "right")))
        yield b.slice(a, z - a)
        a = z


def _whole(batches: Iterator[pa.RecordBatch], key: str, large: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows that come in runs of equal keys, cut between runs once `limit` bytes are there."""
    held, size, most = [], 0, limit
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += pc.sum(pc.binary_length(b.column(large))).as_py() or 0
        if size >= most:
            t = pa.concat_batches(held)
            cut = int(_firsts(t.column(key))[-1])
            if cut:
                yield t.slice(0, cut)
            held = [t.slice(cut)]
            size = pc.sum(pc.binary_length(held[0].column(large))).as_py() or 0
            most = max(limit, 2 * size)  # a long run isn't put together anew for each batch
    if held:
        yield pa.concat_batches(held)


def _firsts(keys: pa.Array) -> np.ndarray:
    """Where runs of equal keys begin; nulls are equal."""
    a, z = keys[:-1], keys[1:]
    other = pc.coalesce(pc.not_equal(a, z), pc.xor(pc.is_null(a), pc.is_null(z)))
    return np.append(0, np.flatnonzero(_numbers(other)) + 1)


def _numbers(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _grouped(doc: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, then document and line of each place, by word, document and line; where each word's places
    start, and at last their number."""
    n_known, ids = len(doc) - doc.null_count, _numbers(doc.fill_null(0))
    if n_known < len(ids) or (ids[1:] < ids[:-1]).any():
        order = pc.sort_indices(doc, null_placement="at_end")  # texts without an id lose their places below
        ids, text = ids[_numbers(order)], text.take(order)
    lines = pc.split_pattern(text, "\n")
    per_text = _numbers(pc.list_value_length(lines))
    words = pc.split_pattern(pc.replace_substring_regex(lines.flatten(), "[\t\f\r]", " "), " ")
    del lines
    at = np.repeat(np.arange(len(words), dtype=np.int32), _numbers(pc.list_value_length(words)))
    words = words.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    words, at = words.filter(full), at[_numbers(full)]
    coded = words.dictionary_encode()
    del words, full
    text_of = np.repeat(np.arange(len(ids), dtype=np.int32), per_text)
    line_of = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    code = _numbers(coded.indices)
    if n_known < len(ids):
        known = text_of[at] < n_known
        code, at = code[known], at[known]
    counts = np.bincount(code, minlength=len(coded.dictionary))
    if (ids[1:] == ids[:-1]).any():
        at = at[np.lexsort((line_of[at], ids[text_of[at]], code))]
    else:
        at = at[np.argsort(code, kind="stable")]
    return coded.dictionary, ids[text_of[at]], line_of[at], np.append(0, np.cumsum(counts))


def _packed(doc: np.ndarray, line: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Each word's places as bytes: the document's distance from the one before (from 0 at first), and the line's from
    the one before in this document, in groups of seven bits, the lowest first. Distances wrap at 64 bits."""
    first = np.zeros(len(doc), bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    pair = np.empty((len(doc), 2), np.uint64)
    before = np.where(first, 0, np.append(0, doc[:-1])[: len(doc)])
    pair[:, 0] = doc.view(np.uint64) - before.view(np.uint64)
    same = ~first & (pair[:, 0] == 0)
    pair[:, 1] = line - np.where(same, np.append(0, line[:-1])[: len(line)], 0)
    v = pair.ravel()
    size = np.ones(len(v), np.int8)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.append(0, np.cumsum(size, dtype=np.int64))
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[ends[has] + k] = (v[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1) * 128).astype(np.uint8)
    offsets = ends[2 * starts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and line of each place, and where each row's places end."""
    lengths = _numbers(pc.binary_length(packed)).astype(np.int64)
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = packed.buffers()[2]
    b = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    last = np.flatnonzero(b < 128)
    start = np.append(0, last[:-1] + 1)[: len(last)]
    v = np.zeros(len(last), np.uint64)
    size = last - start + 1
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        v[has] |= (b[start[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    ends = np.searchsorted(last, np.cumsum(lengths)) // 2
    step, line = v[0::2], v[1::2].astype(np.int64)
    first = np.zeros(len(step), bool)
    first[np.append(0, ends[:-1])[np.diff(np.append(0, ends)) > 0]] = True
    return _sums(step, first).view(np.int64), _sums(line, first | (step != 0)), ends


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where `first` is true."""
    total, begin = np.cumsum(x, dtype=x.dtype), np.flatnonzero(first)
    return total - np.repeat(total[begin] - x[begin], np.diff(np.append(begin, len(x))))


def _written(doc: np.ndarray, line: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A text for each word, null where it has no places."""
    if len(starts) == 2 and len(doc) > PLACES:
        cuts = np.append(np.arange(0, len(doc), PLACES), len(doc))
        return pa.array([",".join(_written(doc[a:z], line[a:z], np.array([0, z - a]))[0].as_py() for a, z in zip(cuts[:-1], cuts[1:]))], pa.string())
    each = pc.binary_join_element_wise(pa.array(doc).cast(pa.string()), pa.array(line).cast(pa.string()), ":")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each), ",")
    return pc.if_else(pa.array(np.diff(starts) > 0), joined, pa.scalar(None, pa.string()))


def _batches(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    b = pa.RecordBatch.from_arrays(columns, names)
    for a in range(0, b.num_rows, ROWS):
        yield b.slice(a, ROWS)
