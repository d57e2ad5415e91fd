"""Python functions over rows, in Arrow batches of Python values: nulls are None, and no number changes its type."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shardflow.session import ship

#: Rows that a function gives before they are sent on.
ROWS = 4096


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns)) if batch.num_columns else iter([()] * batch.num_rows)


def batches_of(items: Iterable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Values or tuples as batches."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for y in items:
        held.append(y if isinstance(y, tuple) else (y,))
        if len(held) >= ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def flat_map(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """The values or tuples that f yields for each row."""
    ship(df.sparkSession)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((y for b in batches for row in rows_of(b) for y in f(*row)), arrow)

    return df.mapInArrow(run, kind)


def keep_rows(df: DataFrame, f: Callable[..., bool]) -> DataFrame:
    """The rows for which f holds."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(f(*r)) for r in rows_of(b)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
