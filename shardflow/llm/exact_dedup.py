"""Exact dedup by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shardflow.llm.common import SPACE, if_few, keep, numbered, pick

#: Salts by which the copies of one text are merged before the salt winners meet.
SALTS = 64
_BIAS = "9223372036854775807"
_STEP = "36893488147419103232"


def _preference(length: Column, doc_id: Column) -> Column:
    """Larger for more code points, then for a smaller id; a null id comes last. One number, which hash
    aggregation can keep in place: length * 2**65 + 2**63 - 1 - doc_id, or length * 2**65 - 1 without an id."""
    d = lambda x: F.lit(x).cast("decimal(38,0)")
    low = F.coalesce(d(_BIAS) - doc_id.cast("decimal(20,0)"), d("-1"))
    return (length.cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(20,0)") + low).cast("decimal(38,0)")


def _id_of(best: Column) -> Column:
    """The id inside a preference."""
    step = F.lit(_STEP).cast("decimal(20,0)")
    low = F.pmod(best, step.cast("decimal(38,0)"))
    return F.when(low < F.lit("18446744073709551616").cast("decimal(20,0)"), (F.lit(_BIAS).cast("decimal(20,0)") - low).cast("long"))


def normalised(text: Column) -> Column:
    """The text without white space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical without white space. Three stages, each of which groups by the digest AND
    the full content, so that texts whose digests collide stay apart:

    1. each map task merges the copies that it reads (the partial aggregation of 2);
    2. copies with the same salt (the input partition's number) are merged: a group holding a third of all
       rows meets in `salts` tasks, and no task gets more of its rows than there are input partitions;
    3. the at most `salts` winners of each text are merged.

    A row then finds its group by digest; only where a digest has several contents (a collision) the
    contents are joined too. The result's join is on rows of a few dozen bytes; Spark splits a hot digest there
    (skew join), as nothing follows that needs its rows together.

    Null texts count as empty; empty texts form one group. Ids may have any type with an order; a null id is larger than
    any other. Of rows that repeat with id and text, one is kept: the first in the order in which rows were read, found by
    a sum (min) over them, so that rows which repeat very often don't meet. An empty table gives no rows; other columns
    are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    whole = isinstance(base.schema["doc_id"].dataType, IntegralType)
    base = base.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("len"), normalised(F.col("text")).alias("body"))
    base = base.withColumn("digest", F.unhex(F.sha2("body", 256)))
    if whole:
        best, rank = F.max, _preference(F.col("len"), F.col("doc_id"))
    else:  # the same order, as a structure
        best, rank = F.min, F.struct((-F.col("len")).alias("l"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    local = base.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "body")
    salted = local.agg(F.count(F.lit(1)).alias("n"), best(rank).alias("best"))
    groups = salted.groupBy("digest", "body").agg(F.sum("n").alias("n"), best("best").alias("best"))
    # Contents of one digest: all but never more than one. Only the groups of such digests keep their content.
    shared = groups.select("digest", F.xxhash64("body").alias("h"), "n", "best")
    classes = shared.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.max("n").alias("n"), F.max("best").alias("best"))
    classes = keep(classes, "classes")
    mine = keep(base.select("doc_id", "len", "digest").withColumn("row", F.monotonically_increasing_id()), "mine")
    found = mine.join(classes.where("contents = 1").select("digest", "n", "best"), "digest")
    if classes.where("contents > 1").head(1):
        odd = classes.where("contents > 1").select("digest")
        apart = base.join(odd, "digest").join(groups.join(odd, "digest", "left_semi"), ["digest", "body"])
        apart = keep(apart.select("doc_id", "len", "digest", "n", "best").withColumn("row", F.monotonically_increasing_id()), "apart")
        found = found.select("doc_id", "len", "digest", "row", "n", "best").unionByName(apart)
    found = found.withColumn("keep_id", _id_of(F.col("best")) if whole else F.col("best.id")).withColumn("first", F.col("best") == rank)
    # Rows that repeat with id and text: the first that was read is kept.
    again = found.where("first").groupBy("digest", "best").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("leader"))
    again = keep(again.where("times > 1").select("digest", "best", "leader"), "again")
    kept = F.col("first")
    if again.head(1):
        found = found.join(again, ["digest", "best"], "left")
        kept = F.col("first") & (F.col("leader").isNull() | (F.col("leader") == F.col("row")))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that `exact_duplicates` keeps, with all their columns; of rows that repeat with id and text, the
    longest: they are merged where they are read first."""
    plain, at, names = numbered(docs, doc_id=id_col, text=text_col)
    found = exact_duplicates(docs, id_col, text_col, salts)
    seen = found.groupBy("doc_id", "text_sha256").agg(F.max(F.col("kept").cast("int")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    seen = keep(seen.where("stays = 0 or rows > 1").select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("sha_"), "stays"), "dropped")
    sha = F.sha2(normalised(F.col(at["text"])), 256)
    same = F.col(at["doc_id"]).eqNullSafe(F.col("id_")) & (sha == F.col("sha_"))
    # Rows whose id is none of these need no comparison, and so no move, of their texts.
    ids = if_few(keep(seen.select(F.col("id_").alias("any_")).distinct(), "ids"))
    named = F.col(at["doc_id"]).eqNullSafe(F.col("any_"))
    kept = plain.join(ids, named, "left_anti").unionByName(plain.join(ids, named, "left_semi").join(seen, same, "left_anti"))
    if seen.where("stays = 1").head(1):  # rows that share id and text with a kept one
        many = plain.join(seen.where("stays = 1").select("id_", "sha_"), same)
        one = many.groupBy("id_", "sha_").agg(F.max_by(F.struct(*plain.columns), F.coalesce(F.length(at["text"]), F.lit(0))).alias("r"))
        kept = kept.unionByName(one.select("r.*"))
    return kept.toDF(*names)
