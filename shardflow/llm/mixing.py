"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardflow.llm.common import keep, n_words, numbered, pick

#: Buckets of a source's ranks: the cut is found in a histogram, then inside one bucket.
BUCKETS = 4096
#: Part of its target by which a source may miss it before texts that no longer fit are passed over.
NEAR = 0.01
#: Copies of a source's row that joins it, so that a hot source meets in several tasks.
SALTS = 32


def _uniform(seed: int, *cols: Column) -> Column:
    """In (0, 1), the same on every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.least(u, F.lit(1 - 2.0**-53))  # the largest would round to 1


def _running(df: DataFrame, name: str, order: Sequence[str], **sums: Column) -> DataFrame:
    """df with the sums over all rows before in an order: by ranges of it, so that no task sees all rows."""
    ranged = keep(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), name)
    before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = ranged.groupBy("part_").agg(*(F.sum(c).alias(f"{k}_0") for k, c in sums.items()))
    parts = parts.select("part_", *(zero(F.sum(f"{k}_0").over(before)).alias(f"{k}_0") for k in sums))
    inside = W.partitionBy("part_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(parts, "part_").select(*df.columns, *((zero(F.sum(c).over(inside)) + F.col(f"{k}_0")).alias(k) for k, c in sums.items()))
    return keep(out, f"{name}-sums")


def targets(sources: DataFrame, weights: Sequence[float], limit: float) -> DataFrame:
    """sources (source, words) with the words that each is to give, as target.

    By code point, null last, the sources weigh `weights` in turn. A source gives `limit` times its words at
    most; what is above goes to the others by weight, until none is above: then each target is the least of
    its limit and one common multiple of its weight. In the order of limit / weight the sources at their limit come
    first; the multiple is that of the first source that, with all before it at their limit, stays below its own. Two
    running sums tell it; the number of jobs doesn't depend on the sources.
    """
    placed = _running(sources.withColumn("rest", F.col("source").isNull()), "sources", ["rest", "source"], place=F.lit(1))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    each = placed.select("source", "words", "place", F.get(turn, F.pmod("place", F.lit(len(weights))).cast("int")).alias("weight"))
    each = each.withColumn("most", F.lit(float(limit)) * F.col("words")).withColumn("ratio", F.try_divide("most", "weight"))
    each = _running(each.withColumn("never", F.col("ratio").isNull()), "weights", ["never", "ratio", "place"], full=F.col("most"), spent=F.col("weight"))
    total, weight = (float(x or 0) for x in each.agg(F.sum("words"), F.sum("weight")).first())
    multiple = F.try_divide(F.lit(total) - F.col("full"), F.lit(weight) - F.col("spent"))
    first = each.where(multiple <= F.col("ratio")).agg(F.min_by(multiple, F.struct("ratio", "place"))).first()[0]
    free = F.lit(first) * F.col("weight") if first is not None else F.when(F.col("weight") > 0, F.col("most")).otherwise(0.0)
    return each.select("source", "words", F.least("most", free).alias("target"))


def _by_source(docs: DataFrame, small: DataFrame) -> DataFrame:
    """docs with the columns of the row of small that has their source (null is a source). The planner
    broadcasts small when its file is small; else a hot source is dealt over SALTS tasks."""
    left = docs.withColumn("k_", F.coalesce("source", F.lit(""))).withColumn("null_", F.col("source").isNull())
    left = left.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "hash", "copy"), F.lit(SALTS)).cast("int"))
    right = small.withColumn("k_", F.coalesce("source", F.lit(""))).withColumn("null_", F.col("source").isNull()).drop("source")
    right = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["k_", "null_", "salt_"]).drop("k_", "null_", "salt_")


def _told_apart(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """rows (doc_id, source, hash and more) with `copy`, which numbers rows that are equal in these three, and the
    doc_id that several rows have, null included (None if there are none). Equal rows are numbered in SALTS parts, so a row
    that is repeated very often is in no task more than a part of the times; most tables have none, and nothing is done."""
    twins = keep(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twins")
    zero = F.lit(0).cast("long")
    if not twins.head(1):
        return rows.withColumn("copy", zero), None
    key = F.struct("doc_id", "source", "hash")
    equal = keep(rows.groupBy(key.alias("key_")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key_"), "equal")
    if not equal.head(1):
        return rows.withColumn("copy", zero), twins
    fixed = keep(rows.withColumn("part_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), name).withColumn("key_", key)
    many = fixed.join(equal, "key_", "left_semi")
    parts = many.groupBy("key_", "part_").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key_").orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    many = many.join(parts.select("key_", "part_", before.alias("before_")), ["key_", "part_"])
    number = F.col("before_") + F.row_number().over(W.partitionBy("key_", "part_").orderBy("part_")) - 1
    many = many.select(*rows.columns, number.cast("long").alias("copy"))
    return keep(fixed.join(equal, "key_", "left_anti").select(*rows.columns, zero.alias("copy")).unionByName(many), f"{name}-told"), twins


def _ranked(docs: DataFrame, params: DataFrame, twins: DataFrame | None, seed: int) -> DataFrame:
    """docs (doc_id, source, size, weight, hash, copy) with copies, the certain whole ones, and rank in (0, 1): the Pareto
    order of the rest, null where there's nothing to draw for. rank = q / (1 + q) with q = odds of a uniform
    number divided by the odds of inclusion; times a source's mean odds, which keeps its order and spreads the ranks."""
    d = docs
    u = _uniform(seed, F.col("doc_id"))
    if twins is not None:  # rows with one id have draws of their own
        t = twins.select(F.coalesce("doc_id", F.lit(0)).alias("t_"), F.col("doc_id").isNull().alias("tn_"), F.lit(True).alias("twin_"))
        d = d.withColumn("t_", F.coalesce("doc_id", F.lit(0))).withColumn("tn_", F.col("doc_id").isNull()).join(t, ["t_", "tn_"], "left").drop("t_", "tn_")
        u = F.when(F.col("twin_"), _uniform(seed, F.col("doc_id"), F.col("source"), F.col("hash"), F.col("copy"))).otherwise(u)
    d = _by_source(d, params)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expect = F.least(F.col("most"), share * F.col("weight"))
    d = d.withColumn("expect", expect).withColumn("copies", F.floor("expect")).withColumn("p", F.col("expect") - F.col("copies"))
    mean = share - F.floor(share)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))) * F.when(mean > 0, mean / (1 - mean)).otherwise(1.0)
    return d.withColumn("rank", F.when(F.col("p") > 0, q / (1 + q))).drop("expect", "p", "most", "twin_")


def _taken(place: Column, size: Column) -> Column:
    """Whether a row is drawn, by the steps of its source's plan."""
    step = F.exists("steps", lambda s: (s["after"].isNull() | (place > s["after"])) & (place <= s["upto"]) & (size <= s["fit"]))
    return F.coalesce(step | F.exists("extra", lambda x: x == place), F.lit(False))


def sample_plan(docs: DataFrame, twins: DataFrame | None, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0, seed: int = 42, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """From docs (doc_id, source, size, weight, hash, copy): one row for each source, with source_size, target, most and
    the steps in which documents are drawn; and the ranked documents.

    A step goes through the order from the place `after` and takes the documents of `fit` words at most up to the place
    `upto`, as far as they fit the target; of the document that no longer fits it is tried whether with it the words
    are nearer to the target. A source that misses its target by more than `near` of it passes that document over and
    takes another step with what fits the gap. Where nothing is left that fits, the smallest document may fill the gap
    (`extra`). All sources step together; the order is cut by a histogram of the ranks, then inside one bucket.
    """
    sized = keep(docs, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("words"))
    params = targets(sources, weights, limit).withColumnRenamed("words", "source_size").withColumn("most", F.lit(float(limit)))
    params = keep(params, "targets")
    place = F.struct("rank", "doc_id", "hash", "copy")
    drawn = keep(_ranked(sized, params, twins, seed).withColumn("bucket", F.floor(F.col("rank") * BUCKETS)), "ranks")
    sure = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("sure")).withColumnRenamed("source", "s_")
    kind = drawn.select(place.alias("x")).schema["x"].dataType.simpleString()
    steps, extra = F.array().cast(f"array<struct<after:{kind},upto:{kind},fit:bigint>>"), F.array().cast(f"array<{kind}>")
    state = params.join(sure, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    state = state.withColumn("gap", F.col("target") - F.coalesce("sure", F.lit(0))).withColumn("after", F.lit(None).cast(kind)).withColumn("fit", F.lit((1 << 63) - 1))
    state = keep(state.withColumn("steps", steps).withColumn("extra", extra).withColumn("open", F.col("gap") > 0).drop("sure"), "plan")
    some = drawn.where("rank is not null").withColumn("place", place).select(F.col("source").alias("s_"), "place", "bucket", "size")
    same = F.col("source").eqNullSafe(F.col("s_"))
    while state.where("open").head(1):
        left = state.where("open").select("source", "after", "fit", "gap")
        able = some.join(left, same & (F.col("size") <= F.col("fit")) & (F.col("after").isNull() | (F.col("place") > F.col("after")))).drop("s_", "fit", "after")
        hist = able.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        hist = hist.withColumn("room", F.col("gap") - F.coalesce(upto, F.lit(0)))
        # The last bucket that begins within the gap; all before it are taken whole.
        last = keep(hist.where("room >= 0").groupBy("source").agg(F.max_by("room", "bucket").alias("room"), F.max("bucket").alias("at")), "edges")
        inside = able.join(last.withColumnRenamed("source", "s_"), same & (F.col("bucket") == F.col("at"))).drop("s_")
        order = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
        inside = inside.select("source", "place", "size", "room", F.sum("size").over(order).alias("upto"))
        fits = F.col("upto") <= F.col("room")
        cut = inside.groupBy(F.col("source").alias("s_")).agg(F.max(F.when(fits, F.col("place"))).alias("in_"), F.max(F.when(fits, F.col("upto"))).alias("words"), F.min(F.when(~fits, F.struct("place", "size"))).alias("next"))
        cut = last.join(cut, same).drop("s_")
        edge = F.struct((F.col("at") / F.lit(float(BUCKETS))).alias("rank"), F.lit(None).alias("doc_id"), F.lit(None).alias("hash"), F.lit(None).alias("copy")).cast(kind)
        cut = cut.select(F.col("source").alias("s_"), F.coalesce("in_", edge).alias("in_"), (F.col("room") - F.coalesce("words", F.lit(0))).alias("rest"), "next", F.lit(True).alias("went"))
        now = state.join(cut, same, "left").drop("s_")
        over, most = F.col("next.size") - F.col("rest"), F.lit(near) * F.col("target")
        take = F.coalesce((over < F.col("rest")) & ((F.col("rest") <= most) | (over <= most)), F.lit(False))
        step = F.struct(F.col("after"), F.when(take, F.col("next.place")).otherwise(F.col("in_")).alias("upto"), F.col("fit"))
        went = F.col("open") & F.col("went").isNotNull()
        goes = went & ~take & F.col("next").isNotNull() & (F.col("rest") > most)
        now = now.select("source", "source_size", "target", "most", "extra", F.when(went, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"), F.when(went, F.when(take, 0.0).otherwise(F.col("rest"))).otherwise(F.col("gap")).alias("gap"), F.when(goes, F.col("next.place")).otherwise(F.col("after")).alias("after"), F.when(goes, F.floor("rest")).otherwise(F.col("fit")).alias("fit"), F.coalesce(goes, F.lit(False)).alias("open"))
        state = keep(now, "plan")
    short = state.where(F.col("gap") > F.lit(near) * F.col("target")).select("source", "steps", "extra", "gap")
    if short.head(1):
        free = some.join(short, same).drop("s_").where(~_taken(F.col("place"), F.col("size")))
        least = free.groupBy(F.col("source").alias("s_")).agg(F.min(F.struct("size", "place")).alias("one"), F.max("gap").alias("g"))
        least = least.where(F.col("one.size") < 2 * F.col("g")).select("s_", "one.place")
        state = state.join(least, same, "left").drop("s_").withColumn("extra", F.when(F.col("place").isNotNull(), F.array("place")).otherwise(F.col("extra"))).drop("place")
        state = keep(state, "plan")
    return state.select("source", "source_size", "target", "most", "steps", "extra"), drawn


def decide(ranked: DataFrame) -> DataFrame:
    """Ranked documents with steps and extra: copies, the drawn one included."""
    drawn = F.col("rank").isNotNull() & _taken(F.struct("rank", "doc_id", "hash", "copy"), F.col("size"))
    return ranked.withColumn("copies", F.col("copies") + drawn.cast("long")).drop("rank", "steps", "extra")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    cols = {"doc_id": id_col, "text": text_col, "source": source_col} | ({"weight": weight_col} if weight_col else {})
    weight = F.coalesce(F.greatest(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return pick(docs, **cols).select("doc_id", "source", n_words(F.col("text")).alias("size"), weight.alias("weight"), F.xxhash64("text").alias("hash"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs.

    Sources are weighed in turn and share all words (`targets`). A document of a source with target t and
    words w is expected t / w times (times its weight, if a column gives one), `limit` at most: the whole part
    is certain, and for the rest documents are ranked by random odds divided by the odds of inclusion and taken
    in that order until the words are nearest to the target. The size that is fixed is that of the sample in
    words; a long document at the cut that would miss it by more than NEAR is passed over for the next that fit
    (`sample_plan`), so a source misses its target by more than NEAR only where no document is left that comes nearer
    (or where weights leave too few words below the limit).

    The cut in the order is found over a histogram of the ranks and then inside one of BUCKETS buckets, so no
    task sees all of a source. Draws depend on seed and doc_id alone: reruns agree. Rows that share an id (or have
    none) also draw by source and text, equal ones by a number, so that each has a draw of its own. Null texts have no words; documents
    without words take none; a null source is a source; a null weight counts as 0. An empty table gives no rows; other
    columns are ignored.
    """
    base, twins = _told_apart(keep(sized(docs, id_col, text_col, source_col, weight_col), "rows"), "told")
    plan, drawn = sample_plan(base, twins, weights, limit, seed)
    out = decide(_by_source(drawn, plan.select("source", "steps", "extra")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as many times as `mix` takes it (none to `limit` times), with all columns. Where rows repeat
    with id, source and text all rows are written once more, with numbers that tell these apart."""
    plain, at, names = numbered(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = plain.select(*plain.columns, F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.xxhash64(at["text"]).alias("hash"))
    rows, twins = _told_apart(rows, "whole")
    rows = rows.withColumn("size", n_words(F.col(at["text"]))).withColumn("weight", F.lit(1.0))
    plan, _ = sample_plan(rows.select("doc_id", "source", "size", "weight", "hash", "copy"), twins, weights, limit, seed)
    rows = decide(_ranked(rows, plan, twins, seed)).where("copies > 0")
    return rows.select(*plain.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("again")).drop("again").toDF(*names)
