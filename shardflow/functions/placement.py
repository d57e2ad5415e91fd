"""Where a key goes, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, IntegralType, StringType


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes (or of a binary) as a long. 64-bit arithmetic never overflows: the state
    has 32 bits and the prime 25."""
    b = F.hex(key.cast("binary"))
    n = F.octet_length(key.cast("binary"))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(b, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(at, F.lit(2166136261).cast("long"), step)


def shard_of(key: Column, kind: DataType, shards: int) -> Column:
    """The shard of a key: whole numbers by remainder (never negative), strings and bytes by FNV-1a, all other
    types by Spark's hash. A null key goes to shard 0."""
    if isinstance(kind, IntegralType):
        at = F.pmod(key.cast("long"), F.lit(shards).cast("long"))
    elif isinstance(kind, (StringType, BinaryType)):
        at = F.pmod(fnv1a(key), F.lit(shards).cast("long"))
    else:
        at = F.pmod(F.xxhash64(key), F.lit(shards).cast("long"))
    return F.coalesce(at, F.lit(0)).cast("int")
