"""Column expressions for placement, text and time."""

from shardflow.functions.placement import fnv1a, shard_of
from shardflow.functions.text import lines, month, parse_time, strip_ends, tokens, words

__all__ = ["fnv1a", "lines", "month", "parse_time", "shard_of", "strip_ends", "tokens", "words"]
