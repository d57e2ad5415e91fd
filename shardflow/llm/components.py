"""Connected components of an edge table, as joins and sums over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import keep


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs: node, root for every node that has an edge to another one; root is the
    smallest node reachable. Loops and repeated edges don't matter; no edges give no rows.

    Large-star and small-star rounds: each hangs a node's neighbours below the smallest of them. Neighbours are
    never gathered: a round sums (min) by node and joins the minima back, so a node with very many edges is
    summed map-side and its join can be split. Each round is written to the shared folder; the driver sees a count
    and a checksum alone. The rounds needed grow with the logarithm of the longest path.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = keep(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
