"""The dataset facade: each method takes Column expressions first, and Python functions where none says the same."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardflow import sinks, sources
from shardflow.operators import aggregation as agg
from shardflow.operators import exchange, joins, opaque, ordering
from shardflow.plans import inspect
from shardflow.shapes import Shape, shape_of

Expr = Column | str


class Dataset:
    """An immutable frame of one of the five shapes (or rows of the caller's, whose first column is the key)."""

    def __init__(self, df: DataFrame):
        self.df = df

    # sources

    @classmethod
    def slice(cls, spark: SparkSession, items: Iterable, schema: str | StructType = "value bigint") -> Dataset:
        return cls(sources.slice_of(spark, items, schema))

    channel = slice

    @classmethod
    def source(cls, spark: SparkSession, make: Callable[[int, int], Iterator[tuple]], schema: str, shards: int = 1) -> Dataset:
        return cls(sources.generate(spark, make, schema, shards))

    @classmethod
    def text_file(cls, spark: SparkSession, path: str, shards: int | None = None) -> Dataset:
        return cls(sources.text_file(spark, path, shards))

    @property
    def shape(self) -> Shape:
        return shape_of(self.df)

    @property
    def shards(self) -> int:
        return self.df.rdd.getNumPartitions()

    # one row to one, to many, or to none

    def map(self, value: Expr) -> Dataset:
        return Dataset(self.df.select(_col(value).alias("value")))

    def map_pairs(self, key: Expr, value: Expr) -> Dataset:
        return Dataset(self.df.select(_col(key).alias("key"), _col(value).alias("value")))

    def select(self, **columns: Expr) -> Dataset:
        return Dataset(self.df.select(*(_col(c).alias(n) for n, c in columns.items())))

    def flat_map(self, values: Expr) -> Dataset:
        """A row for each element of an array; structs of key and value become pairs."""
        out = self.df.select(F.explode(_col(values)).alias("value"))
        kind = out.schema["value"].dataType
        return Dataset(out.select("value.*") if isinstance(kind, StructType) else out)

    def map_with(self, f: Callable, schema: str) -> Dataset:
        """An opaque function of the row's columns that returns a value or a tuple; nulls arrive as None."""
        return self.flat_map_with(lambda *row: (f(*row),), schema)

    def flat_map_with(self, f: Callable, schema: str) -> Dataset:
        """An opaque function of the row's columns that yields values or tuples; batches go through Arrow as Python values,
        so that whole numbers of any size stay exact beside nulls."""
        return Dataset(opaque.flat_map(self.df, f, schema))

    def filter(self, condition: Expr) -> Dataset:
        return Dataset(self.df.where(condition))

    def filter_with(self, f: Callable[..., bool]) -> Dataset:
        return Dataset(opaque.keep_rows(self.df, f))

    # placement and order

    def partition(self, shards: int, exact: bool = False) -> Dataset:
        """By key; exact places keys by shard_of, for when the shard's number matters."""
        return Dataset((exchange.placed if exact else exchange.by_key)(self.df, shards))

    def sort(self, *by: Expr) -> Dataset:
        return Dataset(ordering.sort(self.df, *by))

    def sort_with(self, less: Callable[[object, object], bool]) -> Dataset:
        return Dataset(ordering.sort_by_comparator(self.df, less))

    def local_sort(self, *by: Expr) -> Dataset:
        return Dataset(ordering.local_sort(self.df, *by))

    def merge_sorted(self, *by: Expr) -> Dataset:
        return Dataset(ordering.merge_sorted(self.df, *by))

    # reduce and group

    def reduce(self, f: agg.Fold) -> Dataset:
        return Dataset(agg.reduce(self.df, f))

    def reduce_with(self, f: Callable) -> Dataset:
        return Dataset(agg.reduce_with(self.df, f))

    def local_reduce(self, f: agg.Fold) -> Dataset:
        return Dataset(agg.local_reduce(self.df, f).select("value"))

    def merge_reduce(self, f: agg.Fold) -> Dataset:
        return self.reduce(f)

    def reduce_by_key(self, f: agg.Fold, ordered: bool = True) -> Dataset:
        return Dataset(agg.reduce_by_key(self.df, f, ordered))

    def reduce_by_key_with(self, f: Callable) -> Dataset:
        return Dataset(agg.reduce_by_key_with(self.df, f))

    def reduce_by_user_defined_key(self, f: agg.Fold, order: Column) -> Dataset:
        return Dataset(agg.reduce_by_user_key(self.df, f, order))

    def local_reduce_by_key(self, f: agg.Fold) -> Dataset:
        return Dataset(agg.local_reduce_by_key(self.df, f).select("key", "value"))

    def group_by_key(self) -> Dataset:
        return Dataset(agg.group_by_key(self.df))

    def local_group_by_key(self, normal: Callable[[Column], Column] | None = None) -> Dataset:
        return Dataset(agg.local_group_by_key(self.df, normal).select("key", "values"))

    # two datasets

    def join(self, other: Dataset, keep_left: bool = False, keep_right: bool = False) -> Dataset:
        return Dataset(joins.join(self.df, other.df, keep_left, keep_right))

    def join_partitioned_sorted(self, other: Dataset, normal: Callable[[Column], Column] | None = None, keep_left: bool = False, keep_right: bool = False) -> Dataset:
        return Dataset(joins.join_on(self.df, other.df, normal, keep_left, keep_right)) if normal else self.join(other, keep_left, keep_right)

    def cogroup(self, other: Dataset) -> Dataset:
        return Dataset(joins.cogroup(self.df, self.df if other is self else other.df))

    # sinks

    def collect(self) -> list:
        rows = self.df.collect()
        return [r[0] for r in rows] if len(self.df.columns) == 1 else [tuple(r) for r in rows]

    def add_outputs(self, *taps: Callable[[Iterator[Row]], None]) -> None:
        sinks.run_taps(self.df, *taps)

    def output_as(self, *names: str) -> Dataset:
        return Dataset(sinks.renamed(self.df, *names))

    def save_text_to_file(self, path: str) -> None:
        sinks.save_text_file(self.df, path)

    def save_bytes_to_file(self, path: str) -> None:
        sinks.save_bytes_file(self.df, path)

    def run(self) -> None:
        self.df.write.format("noop").mode("overwrite").save()

    def plot(self) -> str:
        return inspect.dot(self.df)


def _col(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e
