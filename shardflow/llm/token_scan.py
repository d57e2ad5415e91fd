"""Token counts of flat token files, which hold ids and end-of-document ids and nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardflow.llm.common import keep, on_batches, pick
from shardflow.llm.tokens import ids

#: Ids of a block: what is read and searched at once.
BLOCK = 1 << 18
#: Bytes of the blocks that a task reads, one after another.
TASK = 64 << 20
#: Blocks whose summaries are scanned by one task before the sums of such groups are scanned.
GROUP = 1024
#: Words that a worker remembers while it writes.
REMEMBER = 250_000
#: Documents whose ids are noted in one row beside a file.
NOTED = 1024


def write_files(docs: DataFrame, path: str, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a flat file of unsigned little-endian 16-bit ids (the vocabulary is smaller) for each input partition below
    `path`, a folder that all executors reach: a document's ids, then `end`, and so on, without any index. Special
    tokens' strings are ordinary text, so `end` ends documents only.

    Gives rows (file, path, bytes, first, doc_ids), some for each file: documents in the order in which they end, `first`
    being the place of the row's first one, and the bytes that they take. A file's name tells the attempt that wrote it, so
    that a task that is run again doesn't disturb what another one wrote; the rows name the files that count."""
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = ids(vocabulary, True, REMEMBER), TaskContext.get()
        file, out, first, name = context.partitionId(), None, 0, f"{path}/part-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        try:
            for b in batches:
                for at in range(0, b.num_rows, NOTED):
                    part, size = b.slice(at, NOTED), 0
                    for k in range(0, part.num_rows, 128):
                        for data in encoder.encode(part.column(1).slice(k, 128).to_pylist()):
                            data = np.frombuffer(data, "<u4").astype("<u2").tobytes() + tail
                            if out is None:
                                where, plain = fs.FileSystem.from_uri(name)
                                where.create_dir(plain.rsplit("/", 1)[0])
                                out = where.open_output_stream(plain, buffer_size=1 << 20)
                            out.write(data)
                            size += len(data)
                    who = pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type))
                    cols = [pa.array([file], pa.int32()), pa.array([name]), pa.array([size], pa.int64()), pa.array([first], pa.int64()), who]
                    first += part.num_rows
                    yield pa.RecordBatch.from_arrays(cols, ["file", "path", "bytes", "first", "doc_ids"])
        finally:
            if out is not None:
                out.close()

    return on_batches(base, run, f"file int, path string, bytes bigint, first bigint, doc_ids array<{kind}>", "ids")


def _summary(blocks: list[np.ndarray], end: int, head: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """For each block: its length, how many separators it has, where the first and the last one are, and the gaps between."""
    n, count, first, last, gaps = [], [], [], [], []
    for a in blocks:
        at = np.flatnonzero(a == end)
        n.append(len(a))
        count.append(len(at))
        first.append(int(at[0]) if len(at) else None)
        last.append(int(at[-1]) if len(at) else None)
        gaps.append((np.diff(at) - 1).astype(np.int64))
    cols = [*head, *(pa.array(c, pa.int64()) for c in (n, count, first, last)), pa.array(gaps, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, [*names, "n", "ends", "first", "last", "gaps"])


_SUMMARY = "n bigint, ends bigint, first bigint, last bigint, gaps array<bigint>"


def scan_files(files: DataFrame, end: int, kind_of_id: str = "<u2", block: int = BLOCK) -> DataFrame:
    """file, document (its place in the file, from 0), n_tokens from files (file, path, bytes): flat files of numbers of
    one kind (unsigned little-endian, 16 bits, unless said otherwise).

    Files are cut into ranges of `block` numbers anywhere; a task opens a file and reads its ranges. Each is searched
    for `end` at once, and `stitch` joins what they found. Bytes behind the last whole number are left out; an empty file
    has no documents; a path that isn't there is an error.
    """
    wide = np.dtype(kind_of_id).itemsize
    spans = F.ceil(F.col("bytes") / F.lit(wide * block)).cast("bigint")
    ranges = files.where(F.col("bytes") > 0).select("file", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), spans - 1)).alias("block"))
    total = files.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, min(-(-total // (wide * block)), max(-(-total // TASK), files.sparkSession.sparkContext.defaultParallelism)))
    ranges = ranges.repartition(tasks, "path", "block").sortWithinPartitions("path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        for b in batches:
            for k in range(0, b.num_rows, 16):
                part, found = b.slice(k, 16), []
                for path, number in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if path != name:
                        where, plain = fs.FileSystem.from_uri(path)
                        name, stream = path, where.open_input_file(plain)
                    data = stream.read_at(wide * block, wide * block * number)
                    found.append(np.frombuffer(data, kind_of_id, len(data) // wide))
                yield _summary(found, end, [part.column(0), part.column(2)], ["file", "block"])

    kind = ranges.schema["file"].dataType.simpleString()
    return stitch(on_batches(ranges, run, f"file {kind}, block bigint, {_SUMMARY}"))


def scan(blocks: DataFrame, end: int, kind_of_id: str = "<u2") -> DataFrame:
    """As `scan_files`, of blocks (file, block, ids) of any lengths that are rows already. Null blocks count as empty;
    blocks that repeat must not occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x.as_py() or b"", kind_of_id) for x in b.column(2)]
            yield _summary(found, end, [b.column(0), b.column(1)], ["file", "block"])

    kind = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return stitch(on_batches(blocks.select("file", "block", "ids"), run, f"file {kind['file']}, block {kind['block']}, {_SUMMARY}"))


def stitch(found: DataFrame) -> DataFrame:
    """file, document, n_tokens from the summaries of blocks.

    A prefix scan of the summaries (in groups of GROUP blocks, then over the groups) tells each block how many documents
    and tokens came before and where the last separator was, which stitches the document across its border. Tokens
    after the last separator of a file are a document of their own.
    """
    found = found.withColumn("group", F.floor(F.col("block") / GROUP))
    before = W.partitionBy("file", "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    inner = found.withColumn("n0", zero(F.sum("n").over(before))).withColumn("e0", zero(F.sum("ends").over(before)))
    inner = inner.withColumn("l0", F.max(F.col("n0") + F.col("last")).over(before))
    groups = inner.groupBy("file", "group").agg(F.sum("n").alias("gn"), F.sum("ends").alias("ge"), F.max(F.col("n0") + F.col("last")).alias("gl"))
    over = W.partitionBy("file").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("gn0", zero(F.sum("gn").over(over))).withColumn("ge0", zero(F.sum("ge").over(over))).withColumn("gl0", F.max(F.col("gn0") + F.col("gl")).over(over))
    all_ = inner.join(groups.select("file", "group", "gn0", "ge0", "gl0"), ["file", "group"])
    begin = F.col("gn0") + F.col("n0")
    prior = F.coalesce(F.col("gn0") + F.col("l0"), F.col("gl0"), F.lit(-1))
    head = F.when(F.col("ends") > 0, F.array(begin + F.col("first") - prior - 1)).otherwise(_none())
    inside = all_.select("file", (F.col("ge0") + F.col("e0")).alias("base"), F.posexplode(F.concat(head, "gaps")).alias("k", "n_tokens"))
    inside = inside.select("file", (F.col("base") + F.col("k")).alias("document"), "n_tokens")
    tail = groups.groupBy("file").agg(F.sum("ge").alias("document"), F.max(F.col("gn0") + F.col("gn")).alias("length"), F.max(F.col("gn0") + F.col("gl")).alias("stop"))
    tail = tail.select("file", "document", (F.col("length") - F.coalesce("stop", F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0")
    return inside.unionByName(tail)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def document_tokens(docs: DataFrame, path: str, vocabulary: str, end: int, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, file, document, n_tokens for every row of docs, which are written to flat files below `path` first: the scan
    sees these files alone, and its counts then get the ids that were noted beside.

    Null and empty texts have no tokens. Rows that repeat are documents each; ids aren't interpreted. An empty table
    gives no rows; other columns are ignored."""
    noted = keep(write_files(docs, path, vocabulary, end, id_col, text_col), "noted")
    files = noted.groupBy("file", "path").agg(F.sum("bytes").alias("bytes"))
    named = noted.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
    named = named.select("file", (F.col("first") + F.col("k")).alias("document"), "doc_id")
    return scan_files(files, end, block=block).join(named, ["file", "document"]).select("doc_id", "file", "document", "n_tokens")
