"""In-memory collections and generators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from shardflow.session import ship


def slice_of(spark: SparkSession, items: Iterable, schema: str | StructType) -> DataFrame:
    """One shard with the items in order. A one-column schema takes bare values."""
    rows = [x if isinstance(x, (tuple, list, dict)) else (x,) for x in items]
    return spark.createDataFrame(rows, schema).coalesce(1)


def channel(spark: SparkSession, items: Iterable, schema: str | StructType) -> DataFrame:
    """A bounded channel: what an iterable gives until it ends. Live ones are in shardflow.streaming."""
    return slice_of(spark, items, schema)


class _Reader(DataSourceReader):
    def __init__(self, make: Callable[[int, int], Iterator[tuple]], shards: int):
        self.make, self.shards = make, shards

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.shards)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.make(partition.value, self.shards)


class GeneratorSource(DataSource):
    """Base of a source that runs on the executors: make(shard, shards) yields a shard's rows. Subclasses set rows
    and columns; several shards read in parallel."""

    rows: Callable[[int, int], Iterator[tuple]]
    columns: str
    shards = 1

    @classmethod
    def name(cls) -> str:
        return cls.__name__

    def schema(self) -> str:
        return type(self).columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(type(self).rows, int(self.options.get("shards", type(self).shards)))


def generate(spark: SparkSession, make: Callable[[int, int], Iterator[tuple]], schema: str, shards: int = 1, name: str = "generated") -> DataFrame:
    """Rows of make(shard, shards), called once for each shard on the executors. To deal one producer's rows round robin,
    shard i of n yields its rows i, i + n, i + 2n and so on."""
    ship(spark)
    kind = type(name, (GeneratorSource,), {"rows": staticmethod(make), "columns": schema, "shards": shards})
    spark.dataSource.register(kind)
    return spark.read.format(name).load()
