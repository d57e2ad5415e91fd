"""Placement of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.functions.placement import shard_of
from shardflow.shapes import key_of


def by_key(df: DataFrame, shards: int) -> DataFrame:
    """Rows with equal keys in one of `shards` partitions. A join or aggregation on the key that follows reuses this
    exchange."""
    return df.repartition(shards, key_of(df))


def placed(df: DataFrame, shards: int) -> DataFrame:
    """As by_key, but partition i holds just the keys whose shard_of is i: where placement can be seen."""
    key = key_of(df)
    return df.repartitionById(shards, shard_of(F.col(key), df.schema[key].dataType, shards))


def dealt(df: DataFrame, shards: int, order: str) -> DataFrame:
    """Round robin by a whole-number place: place i goes to partition i % shards."""
    return df.repartitionById(shards, F.pmod(F.col(order), F.lit(shards)).cast("int"))


def spread(df: DataFrame, shards: int) -> DataFrame:
    """One shard to many, evenly."""
    return df.repartition(shards)


def merged(df: DataFrame) -> DataFrame:
    """All shards to one, behind an exchange: what comes before stays parallel."""
    return df.repartition(1)
