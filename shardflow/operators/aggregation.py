"""The reduce and group family. Folds that Spark knows are named; others are Python functions of two values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce as fold
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shardflow.operators import opaque
from shardflow.session import shared_dir, ship
from shardflow.shapes import key_of

Fold = str | Callable[[Column], Column]
NAMED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "count": lambda c: F.count(F.lit(1)),
    "and": F.bool_and, "or": F.bool_or, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor,
}


def aggregate_of(f: Fold, column: str) -> Column:
    """An aggregate by name, or by a function from column to aggregate."""
    return (NAMED[f] if isinstance(f, str) else f)(F.col(column))


def reduce(df: DataFrame, f: Fold, column: str = "value") -> DataFrame:
    """One row, folded over all shards (each folds its part first); an empty input gives no row."""
    every = df.agg(aggregate_of(f, column).alias(column), F.count(F.lit(1)).alias("n_"))
    return every.where("n_ > 0").drop("n_")


def local_reduce(df: DataFrame, f: Fold, column: str = "value") -> DataFrame:
    """(shard, value): a row for each partition that has rows. The partition's number is taken before anything is
    exchanged, and map-side sums leave a row for each partition."""
    return df.groupBy(F.spark_partition_id().alias("shard")).agg(aggregate_of(f, column).alias(column))


def reduce_by_key(df: DataFrame, f: Fold, ordered: bool = False) -> DataFrame:
    """(key, value) with one row for each key; ordered by key if that is wanted."""
    out = df.groupBy("key").agg(aggregate_of(f, "value").alias("value"))
    return out.orderBy("key") if ordered else out


def reduce_by_user_key(df: DataFrame, f: Fold, order: Column) -> DataFrame:
    """As reduce_by_key, ordered by an expression; keys that tie stay apart."""
    return df.groupBy("key").agg(aggregate_of(f, "value").alias("value")).orderBy(order, "key")


def local_reduce_by_key(df: DataFrame, f: Fold) -> DataFrame:
    """(shard, key, value): keys folded inside each partition."""
    return df.groupBy(F.spark_partition_id().alias("shard"), "key").agg(aggregate_of(f, "value").alias("value"))


def fold_runs(df: DataFrame, f: Fold, order: str, shard: Column | None = None) -> DataFrame:
    """(shard, run, key, value): runs of equal neighbouring keys in a given order are folded; a key may have
    several. Runs are numbered from 1 inside a shard (an expression over df; without one all rows are a shard).

    Rows are ranged by shard and order, so no task sees more than its range however large a shard is; ranges are
    written to the shared folder, and a range's first run continues the last one of the range before where the keys
    are equal, which is told from one row for each range and shard."""
    spark = df.sparkSession
    path = shared_dir(spark)
    ranged = df.withColumn("shard", shard if shard is not None else F.lit(0)).repartitionByRange("shard", order)
    ranged = ranged.withColumn("range_", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    inside = W.partitionBy("range_", "shard").orderBy(order)
    new = F.when(F.lag("key").over(inside).eqNullSafe(F.col("key")) | (F.row_number().over(inside) == 1), 0).otherwise(1)
    ranged = ranged.withColumn("new_", new).withColumn("turn_", F.sum("new_").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    ends = ranged.groupBy("shard", "range_").agg(F.min_by(F.struct("key"), order).alias("a_"), F.max_by(F.struct("key"), order).alias("z_"), F.sum("new_").alias("n_"))
    over = W.partitionBy("shard").orderBy("range_")
    starts = ends.withColumn("s_", F.when(F.lag("z_").over(over).isNotNull() & (F.lag("z_").over(over) == F.col("a_")), 0).otherwise(1))
    first = F.sum(F.col("s_") + F.col("n_")).over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_")
    runs = ranged.join(starts.select("shard", "range_", first.alias("first_")), ["shard", "range_"])
    runs = runs.withColumn("run", F.col("first_") + F.col("turn_"))
    return runs.groupBy("shard", "run", "key").agg(aggregate_of(f, "value").alias("value"))


def group_by_key(df: DataFrame, order: bool = True) -> DataFrame:
    """(key, values); values are sorted unless their order doesn't matter."""
    values = F.collect_list("value")
    return df.groupBy("key").agg((F.sort_array(values) if order else values).alias("values"))


def local_group_by_key(df: DataFrame, normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """(shard, key, values) inside each partition. normal maps keys that a comparator holds equal to one form; the
    least key of the group is shown."""
    form = normal(F.col("key")) if normal else F.col("key")
    out = df.groupBy(F.spark_partition_id().alias("shard"), form.alias("form_"))
    return out.agg(F.min("key").alias("key"), F.sort_array(F.collect_list("value")).alias("values")).drop("form_")


def reduce_with(df: DataFrame, f: Callable[[object, object], object], column: str = "value") -> DataFrame:
    """One row by an opaque associative, commutative function: each partition folds its rows batch by batch, then
    one task folds the partitions' results (after an exchange, so that the first step stays parallel). Nulls arrive as
    None. An empty input gives no row."""
    ship(df.sparkSession)
    one = df.select(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, parts = None, []
        for b in batches:
            if b.num_rows:
                kind = b.schema
                parts = [fold(f, [*parts, *b.column(0).to_pylist()])]
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array(parts, kind.types[0])], schema=kind)

    return one.mapInArrow(run, one.schema).repartition(1).mapInArrow(run, one.schema)


def reduce_by_key_with(df: DataFrame, f: Callable[[object, object], object]) -> DataFrame:
    """(key, value) by an opaque function; keys are values that Python can hash. Each partition folds its keys first, so
    a hot key reaches its final task as one row for each partition; the same step then folds those."""
    ship(df.sparkSession)
    pair = df.select("key", "value")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kinds = {}, None
        for b in batches:
            kinds = b.schema
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if isinstance(k, float):  # one NaN and one zero
                    k = k + 0.0 if k == k else math.nan
                at[k] = f(at[k], v) if k in at else v
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((list(at), list(at.values())), kinds.types)], ["key", "value"])

    return pair.mapInArrow(part, pair.schema).repartition("key").mapInArrow(part, pair.schema)


def map_groups(df: DataFrame, f: Callable[[object, Iterator], Iterable], schema: str) -> DataFrame:
    """An opaque function of all rows with one key: it gets the key and an iterator over the group's values (tuples, if
    there are several other columns), and yields values or tuples. Rows come sorted by key, in batches that know
    nothing of groups: a small group costs no call of its own between Spark and Python, a large one is never held."""
    ship(df.sparkSession)
    key, kind = key_of(df), StructType.fromDDL(schema)
    others = [c for c in df.columns if c != key]
    arrow = to_arrow_schema(kind)
    at = 1 if len(others) == 1 else slice(1, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in opaque.rows_of(b))
        groups = groupby(rows, lambda r: (_one_form(r[0]),))  # in a tuple the one NaN equals itself
        yield from opaque.batches_of((y for (k,), g in groups for y in f(k, (r[at] for r in g))), arrow)

    return df.select(key, *others).repartition(key).sortWithinPartitions(key).mapInArrow(run, kind)


def _one_form(k: object) -> object:
    """A key with one NaN and one zero, at any depth."""
    if isinstance(k, float):
        return k + 0.0 if k == k else math.nan
    if isinstance(k, dict):
        return {n: _one_form(x) for n, x in k.items()}
    return [_one_form(x) for x in k] if isinstance(k, list) else k
