from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from shardflow.session import shared_dir


def receive(spark: SparkSession, path: str, schema: str | StructType | None = None, files: int | None = None) -> DataFrame:
    """A stream of a directory: lines (value), or Parquet rows of a schema; `files` bounds each batch."""
    r = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    return r.schema(schema).parquet(path) if schema else r.text(path)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Reads all that is there now and stops; the rows are then a table in the shared folder, written by the executors.
    Stateless steps append, and each batch is committed once. A reduction gives its state in mode complete: each
    batch writes it whole to a folder of its own, and the last one counts."""
    spark = stream.sparkSession
    root = shared_dir(spark)
    at = checkpoint or f"{root}/checkpoint"
    w = stream.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", at)
    if mode == "append":
        w.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/rows")
    last: list[str] = []

    def whole(batch: DataFrame, number: int) -> None:
        path = f"{root}/state-{number}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    w.foreachBatch(whole).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


def sorted_batches(stream: DataFrame, sink: Callable[[DataFrame], None], *by: Column | str, checkpoint: str | None = None) -> None:
    """Sorting blocks until its input ends: each batch is sorted and handed to a sink."""
    w = stream.writeStream.foreachBatch(lambda batch, _: sink(batch.orderBy(*by))).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()


def fan_in(*streams: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of several channels (live or bounded, with the same columns) as one, in no order, each changed first if
    that is wanted. Nothing is exchanged: the shards of all stand side by side."""
    some = [change(s) if change else s for s in streams]
    out = some[0]
    for s in some[1:]:
        out = out.unionByName(s)
    return out
