"""Where rows go: files, taps, collections."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row

Tap = Callable[[Iterator[Row]], None]


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """Columns by position under the names of a caller's structure, which has as many."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns don't fit {len(names)} fields")
    return df.toDF(*names)


def save_text(df: DataFrame, path: str) -> None:
    """A directory of text files, one for each partition, in place of what was there."""
    df.select(df.columns[0]).write.mode("overwrite").text(path)


def _one_file(path: str) -> pa.NativeFile:
    """A file to write, by URI or path; folders above it are made."""
    where, plain = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    where.create_dir(plain.rpartition("/")[0])
    return where.open_output_stream(plain, buffer_size=1 << 20)


def save_text_file(df: DataFrame, path: str) -> None:
    """One file, a line for each row; rows stream through the driver, a partition at a time."""
    with _one_file(path) as f:
        for row in df.select(df.columns[0]).toLocalIterator(prefetchPartitions=True):
            f.write(f"{row[0]}\n".encode())


def save_bytes_file(df: DataFrame, path: str) -> None:
    """One file, rows one after another."""
    with _one_file(path) as f:
        for row in df.select(df.columns[0]).toLocalIterator(prefetchPartitions=True):
            f.write(bytes(row[0]))


def send(df: DataFrame, topic: str) -> None:
    """Appends lines to a topic, a directory that shardflow.streaming.receive follows."""
    df.select(df.columns[0]).write.mode("append").text(topic)


def run_taps(df: DataFrame, *taps: Tap) -> None:
    """Gives every tap every row; with several the rows are computed once."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK) if len(taps) > 1 else df
    try:
        for tap in taps:
            tap(held.toLocalIterator(prefetchPartitions=True))
    finally:
        if held is not df or len(taps) > 1:
            held.unpersist()


def for_each(df: DataFrame, f: Callable[[Iterator[Row]], None]) -> None:
    """Side effects on the executors, a call for each partition."""
    df.foreachPartition(f)
