"""The five row shapes and their column names."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame


class Shape(Enum):
    VALUE = ("value",)
    PAIR = ("key", "value")
    JOINED = ("key", "value1", "value2")
    GROUPED = ("key", "values")
    COGROUPED = ("key", "values1", "values2")
    ROW = ()  # several columns of the caller's; the first is the key

    def check(self, df: DataFrame) -> DataFrame:
        if self.value and tuple(df.columns) != self.value:
            raise ValueError(f"{self.name} has columns {self.value}, not {tuple(df.columns)}")
        return df


def shape_of(df: DataFrame) -> Shape:
    """By column names."""
    return next((s for s in Shape if s.value == tuple(df.columns)), Shape.ROW)


def key_of(df: DataFrame) -> str:
    """The key column: `key`, else the first (a bare value is its own key)."""
    return "key" if "key" in df.columns else df.columns[0]
