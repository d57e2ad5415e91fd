"""Joins and cogroups by key; Spark picks the strategy by size and splits skewed keys."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.operators.aggregation import group_by_key
from shardflow.session import ship

KINDS = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}


def join(left: DataFrame, right: DataFrame, keep_left: bool = False, keep_right: bool = False) -> DataFrame:
    """(key, value1, value2) from two (key, value): every pair of values of a key; a side that is kept shows its
    unmatched rows beside nulls. Null keys match nothing."""
    a = left.select("key", F.col("value").alias("value1"))
    b = right.select("key", F.col("value").alias("value2"))
    return a.join(b, "key", KINDS[keep_left, keep_right]).select("key", "value1", "value2")


def join_on(left: DataFrame, right: DataFrame, normal: Callable[[Column], Column], keep_left: bool = False, keep_right: bool = False) -> DataFrame:
    """A join by keys that a comparator holds equal, given as a normal form; the left key is shown, or the right one
    of rows without a left."""
    a = left.select(F.col("key").alias("key_l"), F.col("value").alias("value1"), normal(F.col("key")).alias("form_"))
    b = right.select(F.col("key").alias("key_r"), F.col("value").alias("value2"), normal(F.col("key")).alias("form_"))
    both = a.join(b, "form_", KINDS[keep_left, keep_right])
    return both.select(F.coalesce("key_l", "key_r").alias("key"), "value1", "value2")


def join_co_partitioned(left: DataFrame, right: DataFrame, shards: int, keep_left: bool = False, keep_right: bool = False) -> DataFrame:
    """A join whose sides were dealt by key and sorted first, for sides that are used again."""
    ready = lambda d: d.repartition(shards, "key").sortWithinPartitions("key")
    return join(ready(left), ready(right), keep_left, keep_right)


def cogroup(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, values1, values2) with a row for each key of either side; a missing side is an empty array. With itself a
    dataset is just grouped: (key, values)."""
    if left is right:
        return group_by_key(left)
    none = lambda c, d: F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType)).alias(c)
    a = group_by_key(left).withColumnRenamed("values", "values1")
    b = group_by_key(right).withColumnRenamed("values", "values2")
    return a.join(b, "key", "full").select("key", none("values1", a), none("values2", b))


def cogroup_with(left: DataFrame, right: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An opaque function of both sides' rows with one key."""
    ship(left.sparkSession)
    return left.groupBy("key").cogroup(right.groupBy("key")).applyInPandas(f, schema)


def semi(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows whose key the right side has: cogroup and filter, without the groups."""
    return left.join(right.select("key"), "key", "left_semi")


def anti(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("key"), "key", "left_anti")
