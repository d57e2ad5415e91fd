"""Sorting: by expressions, which Spark ranges over partitions, or by an opaque comparator."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shardflow.session import ship
from shardflow.shapes import key_of

#: Keys that are sampled for each range of an opaque order.
SAMPLE = 64
#: Rows of a range of an opaque order, which a task sorts in Python.
RANGE = 500_000


def default_order(df: DataFrame) -> list[Column]:
    return [F.col(key_of(df)).asc()]


def sort(df: DataFrame, *by: Column | str) -> DataFrame:
    """Global order: range partitions, each sorted (and spilled) on its own. Without `by`, ascending by key."""
    return df.orderBy(*(by or default_order(df)))


def local_sort(df: DataFrame, *by: Column | str) -> DataFrame:
    """Order inside each partition."""
    return df.sortWithinPartitions(*(by or default_order(df)))


def merge_sorted(df: DataFrame, *by: Column | str) -> DataFrame:
    """One order from sorted shards. The range exchange makes no use of the shards' order, nor relies on it."""
    return sort(df, *by)


def sort_by_comparator(df: DataFrame, less: Callable[[object, object], bool], column: str | None = None, shards: int | None = None, rows: int = RANGE) -> DataFrame:
    """Global order by less(a, b) over the key (or another column), an opaque function of two Python values.

    A sample of SAMPLE keys for each range, sorted on the driver, cuts the order into ranges of about `rows` rows (at
    least `shards` of them), so that what a task sorts in Python doesn't grow with the input. A key that ties with several
    cuts is dealt over all the ranges between them, which hold nothing else, so a key that very many rows share is no
    task's alone."""
    spark = df.sparkSession
    ship(spark)
    name = column or key_of(df)
    n = max(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    ranks = lambda: cmp_to_key(lambda a, b: -1 if less(a, b) else int(less(b, a)))  # noqa: E731, made anew on each worker
    few = sorted((r[0] for r in df.select(name).orderBy(F.rand(7)).limit(SAMPLE * n).collect()), key=ranks())
    cuts = [few[len(few) * i // n] for i in range(1, n)] if few else []
    kind = StructType([*df.schema.fields, StructField("range_", IntegerType())])
    place = df.columns.index(name)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks()
        marks, turn = [rank(c) for c in cuts], 0
        for b in batches:
            at = []
            for k in map(rank, b.column(place).to_pylist()):
                lo = bisect_left(marks, k)
                hi = bisect_right(marks, k, lo)
                turn += 1
                at.append(lo + turn % (hi - lo + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "range_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            every = pa.Table.from_batches(parts).drop_columns(["range_"])
            k = list(map(ranks(), every.column(place).to_pylist()))
            yield from every.take(pa.array(sorted(range(len(k)), key=k.__getitem__), pa.int64())).to_batches(max_chunksize=8192)

    return df.mapInArrow(deal, kind).repartitionById(n, F.col("range_")).mapInArrow(run, df.schema)


def top(df: DataFrame, n: int, *by: Column | str) -> DataFrame:
    """The first n rows of an order: each task keeps n."""
    return sort(df, *by).limit(n)
