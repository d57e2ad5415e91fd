"""Text, directories and XML rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.session import ship

#: Bytes that a task reads at once.
BLOCK = 4 << 20


def text_file(spark: SparkSession, path: str, shards: int | None = None) -> DataFrame:
    """(value): lines that end in a newline, without a carriage return before it; lines of any length. A path
    that isn't there is an error. Large files are split by Spark; shards deals the lines anew."""
    df = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    return df.repartition(shards) if shards else df


def text_dir(spark: SparkSession, path: str, names: bool = False) -> DataFrame:
    """(value), or (path, value): lines of all files of a directory, not of those below it."""
    df = spark.read.option("lineSep", "\n").text(path)
    line = F.regexp_replace("value", "\r$", "").alias("value")
    return df.select(F.col("_metadata.file_path").alias("path"), line) if names else df.select(line)


def binary_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of a directory's files; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def text_of_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value): lines of the files listed."""
    df = spark.read.option("lineSep", "\n").text(paths)
    return df.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("value"))


def text_of_listing(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, value): lines of the files that a frame names, which may be as many as it likes: tasks open them where they
    run, and read a block at a time. A file that isn't there is an error; null paths are left out."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in filter(None, b.column(0).to_pylist()):
                where, plain = fs.FileSystem.from_uri(path)
                with where.open_input_stream(plain) as f:
                    rest = b""
                    while data := f.read(BLOCK):
                        *lines, rest = (rest + data).split(b"\n")
                        yield _lines(path, lines)
                    if rest:
                        yield _lines(path, [rest])

    return paths.select(column).mapInArrow(run, "path string, value string")


def _lines(path: str, lines: list[bytes]) -> pa.RecordBatch:
    text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(text), pa.string()), pa.array(text, pa.string())], ["path", "value"])


def numbered_words(text: Column, separator: str = r"[ \t\f\r]+") -> Column:
    """An array of (line_number from 0, word) of a text; empty words are left out, empty lines counted."""
    per_line = F.transform(F.split(text, "\n"), lambda line, i: F.transform(F.filter(F.split(line, separator), lambda w: w != ""), lambda w: F.struct(i.alias("line_number"), w.alias("word"))))
    return F.flatten(per_line)


def xml_rows(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Attributes of one XML element a line, by a schema of names with a leading underscore; lines that aren't such
    an element are dropped."""
    fields = F.from_xml(F.col(column), f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    row = lines.where(F.trim(F.col(column)).startswith("<")).select(fields.alias("r")).where("r is not null and r._corrupt_record is null")
    names = [c for c in row.select("r.*").columns if c != "_corrupt_record"]
    return row.select(*(F.col(f"r.{c}").alias(c.removeprefix("_")) for c in names))
