"""Scalar functions that dataflow programs over text need; literal separators are escaped."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, separator: str) -> Column:
    """Pieces between literal separators; empty ones stay."""
    return F.split(text, re.sub(r"([^A-Za-z0-9 \n\t])", r"\\\1", separator))


def words(text: Column) -> Column:
    """Lower-case alphanumeric words."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def strip_ends(text: Column) -> Column:
    """Without the first and the last character."""
    return F.when(F.length(text) > 2, text.substr(F.lit(2), F.length(text) - 2)).otherwise(F.lit(""))


def parse_time(text: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSS") -> Column:
    """A timestamp, null where the text isn't one."""
    return F.try_to_timestamp(text, F.lit(pattern))


def month(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")
