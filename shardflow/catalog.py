"""Registry of the queries on the dataflow operators: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardflow import functions as fn
from shardflow import sinks, sources
from shardflow.dataset import Dataset
from shardflow.operators import aggregation as agg
from shardflow.operators import exchange, joins, ordering, postings
from shardflow.session import shared_dir
from shardflow.plans import dot, observed
from shardflow.streaming import fan_in, receive, run_to_end, sorted_batches

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _all.items() if s}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pairs(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    return df.select(F.col(key).alias("key"), (F.expr(value) if isinstance(value, str) else value).alias("value"))


def _money(column: str) -> Column:
    """An exact sum of amounts with two decimals."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


# tokens, maps, filters


@query("select word as key, count(*) as value from (select unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as word from documents) where word <> '' group by word")
def word_count(spark, d):
    words = Dataset(_t(spark, d, "documents")).flat_map(fn.words(F.col("text")))
    return words.map_pairs("value", "1L").reduce_by_key("sum", ordered=False).df


@query("select count(*) as value from (select unnest(string_split(text, ' ')) from documents where not starts_with(text, '#')) having count(*) > 0")
def token_total(spark, d):
    ds = Dataset(_t(spark, d, "documents")).filter(~F.col("text").startswith("#"))
    return ds.flat_map(fn.tokens(F.col("text"), " ")).map("1L").reduce("sum").df


@query("select l_orderkey as key, l_extendedprice * (1 - l_discount) as value from lineitem")
def map_pairs(spark, d):
    return Dataset(_t(spark, d, "lineitem")).map_pairs("l_orderkey", "l_extendedprice * (1 - l_discount)").df


@query("select o_orderkey * 2 + 1 as value from orders")
def map_with(spark, d):
    """An opaque function, in Arrow batches."""
    return Dataset(_t(spark, d, "orders").select("o_orderkey")).map_with(lambda k: k * 2 + 1, "value bigint").df


@query("select unnest(string_split(p_name, ' ')) as value from part")
def flat_map_with(spark, d):
    return Dataset(_t(spark, d, "part").select("p_name")).flat_map_with(lambda s: s.split(" "), "value string").df


@query("select p_partkey, p_name from part where starts_with(p_name, 'a') or contains(p_name, 're')")
def filter_prefix(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_name").where(F.col("p_name").startswith("a") | F.col("p_name").contains("re"))


@query("select o_custkey as key, o_totalprice as value from orders where o_custkey % 3 = 0 and o_totalprice > 1000")
def filter_pair(spark, d):
    return Dataset(_t(spark, d, "orders")).map_pairs("o_custkey", "o_totalprice").filter("key % 3 = 0 and value > 1000").df


@query("select c_custkey as key, c_nationkey as value from customer where (c_custkey + c_nationkey) % 5 = 0")
def filter_with(spark, d):
    return Dataset(_t(spark, d, "customer")).map_pairs("c_custkey", "c_nationkey").filter_with(lambda k, v: (k + v) % 5 == 0).df


@query("select o_orderkey + 7 as key, 2 * o_orderkey + 7 as value from orders")
def static_loop(spark, d):
    df = _pairs(_t(spark, d, "orders"), "o_orderkey", "2 * o_orderkey")
    for _ in range(7):
        df = df.select((F.col("key") + 1).alias("key"), (F.col("value") + 1).alias("value"))
    return df


# reduce


@query("select cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as value from lineitem having count(*) > 0")
def reduce_sum(spark, d):
    return agg.reduce(_t(spark, d, "lineitem").select(F.col("l_extendedprice").cast("decimal(18,2)").alias("value")), "sum").select(F.col("value").cast("double"))


@query("select max(l_extendedprice) as value from lineitem having count(*) > 0")
def reduce_max(spark, d):
    return Dataset(_t(spark, d, "lineitem")).map("l_extendedprice").reduce("max").df


@query("select max(l_extendedprice) as value from lineitem where l_quantity < 0 having count(*) > 0")
def reduce_empty(spark, d):
    return Dataset(_t(spark, d, "lineitem")).filter("l_quantity < 0").map("l_extendedprice").reduce("max").df


@query("select bit_xor(o_orderkey) as value from orders having count(*) > 0")
def reduce_with(spark, d):
    return Dataset(_t(spark, d, "orders")).map("o_orderkey").reduce_with(lambda a, b: a ^ b).df


_SHARD_MAX = "select cast(o_custkey % 4 as int) as shard, max(o_totalprice) as value from orders group by 1"


@query(_SHARD_MAX)
def local_reduce_by_shard(spark, d):
    return agg.local_reduce(exchange.placed(_pairs(_t(spark, d, "orders"), "o_custkey", "o_totalprice"), 4), "max")


@query(f"select max(value) as value from ({_SHARD_MAX}) having count(*) > 0")
def merge_reduce(spark, d):
    return agg.reduce(local_reduce_by_shard(spark, d).select("value"), "max")


@query("select o_custkey as key, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as value from orders group by 1")
def reduce_by_key_sum(spark, d):
    return _pairs(_t(spark, d, "orders"), "o_custkey", "o_totalprice").groupBy("key").agg(_money("value").alias("value"))


@query("select o_custkey as key, max(o_orderkey) as value from orders group by 1")
def reduce_by_key_with(spark, d):
    return Dataset(_t(spark, d, "orders")).map_pairs("o_custkey", "o_orderkey").reduce_by_key_with(max).df


@query("select c_mktsegment as key, count(*) as value from customer group by 1")
def reduce_user_key(spark, d):
    return Dataset(_t(spark, d, "customer")).map_pairs("c_mktsegment", "1L").reduce_by_user_defined_key("sum", F.lower("key")).df


@query("select cast(o_custkey % 4 as int) as shard, o_custkey as key, count(*) as value from orders group by 1, 2")
def local_reduce_by_key(spark, d):
    return agg.local_reduce_by_key(exchange.placed(_pairs(_t(spark, d, "orders"), "o_custkey", "1L"), 4), "sum")


@query("""with e as (select event_id, event_type, user_id % 16 as shard, lag(event_type) over (partition by user_id % 16 order by event_id) as prev from events),
    r as (select *, sum(case when prev = event_type then 0 else 1 end) over (partition by shard order by event_id) as run from e)
    select shard, cast(run as bigint) as run, event_type as key, count(*) as value from r group by 1, 2, 3""")  # fmt: skip
def run_fold(spark, d):
    df = _t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("key"), F.lit(1).cast("long").alias("value"))
    return agg.fold_runs(df, "sum", "event_id", F.col("user_id") % 16).withColumn("run", F.col("run").cast("long"))


@query("""select o_custkey as key, cast(sum(cast(o_totalprice as decimal(18,2))) / count(*) as double) as mean, count(*) as n from orders group by 1""")
def composite_fold(spark, d):
    """A fold over (sum, count) as an average."""
    both = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return both.select("key", (F.col("s").cast("double") / F.col("n")).alias("mean"), "n")


# group


@query("select o_custkey as key, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as orders from orders group by 1")
def group_by_key(spark, d):
    g = Dataset(_t(spark, d, "orders")).map_pairs("o_custkey", "o_orderkey").group_by_key().df
    return g.select("key", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("orders"))


@query("select o_custkey as key, count(*) as n from orders group by 1")
def group_sizes(spark, d):
    return _pairs(_t(spark, d, "orders"), "o_custkey", "o_orderkey").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(c_custkey % 4 as int) as shard, min(c_mktsegment) as key, count(*) as n from customer group by 1, lower(c_mktsegment)")
def local_group_by_key(spark, d):
    """Grouping inside shards, by keys that a case-blind comparator holds equal."""
    df = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    df = exchange.placed(df, 4).select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("value"))
    return agg.local_group_by_key(df, F.lower).select("shard", "key", F.size("values").cast("long").alias("n"))


@query("select o_custkey as key, max(o_totalprice) - min(o_totalprice) as spread from orders group by 1")
def group_map_with(spark, d):
    """An opaque function of a group, in one pass over its values."""
    return agg.map_groups(_pairs(_t(spark, d, "orders"), "o_custkey", "o_totalprice"), _spread, "key bigint, spread double")


def _spread(key, values):
    """Nulls don't count, and NaN is the largest number, as in SQL."""
    low = high = None
    for v in values:
        if v is not None:
            low = v if low is None or v < low else low
            high = v if high is None or v > high or v != v else high
    yield key, None if low is None else high - low


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
    w as (select unnest(string_split_regex(line, '[^\S\n]+')) as word, doc_id, n from l)
    select word as key, string_agg(doc_id || ':' || n, ',' order by doc_id, n) as places from w where word <> '' group by 1""")  # fmt: skip
def inverted_index(spark, d):
    """A row for each word, with all its places."""
    return postings.by_word(_t(spark, d, "documents"), "doc_id", "text")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
    w as (select unnest(string_split_regex(line, '[^\S\n]+')) as word, doc_id, n from l)
    select word as key, doc_id // 256 as segment, string_agg(doc_id || ':' || n, ',' order by doc_id, n) as places from w where word <> '' group by 1, 2""")  # fmt: skip
def inverted_index_segments(spark, d):
    """The same in segments of 256 documents: a row stays bounded however common its word is, and a common word's
    segments are grouped by many tasks."""
    return postings.by_segment(_t(spark, d, "documents"), "doc_id", "text", F.expr("doc_id div 256"))


# placement


@query("select cast(o_custkey % 8 as int) as shard, count(*) as n from orders group by 1")
def partition_counts_int(spark, d):
    df = exchange.placed(_pairs(_t(spark, d, "orders"), "o_custkey", "1L"), 8)
    return df.groupBy(F.spark_partition_id().alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("""select cast(list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, strlen(c_mktsegment) + 1), lambda i: ascii(c_mktsegment[i])::bigint)),
    lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 8 as int) as shard, count(*) as n from customer group by 1""")  # fmt: skip
def partition_counts_str(spark, d):
    df = exchange.placed(_pairs(_t(spark, d, "customer"), "c_mktsegment", "1L"), 8)
    return df.groupBy(F.spark_partition_id().alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast((row_number() over (order by event_id) - 1) % 5 as int) as shard, event_id from events")
def round_robin_source(spark, d):
    """Place i of the source goes to shard i % 5; event_id is the place here."""
    df = exchange.dealt(_t(spark, d, "events").select("event_id"), 5, "event_id")
    return df.select(F.spark_partition_id().alias("shard"), "event_id")


@query("select cast(i % 4 as int) as shard, i as value from range(1000) t(i)")
def generated_source(spark, d):
    df = sources.generate(spark, lambda k, n: ((k, i) for i in range(k, 1000, n)), "shard int, value bigint", 4)
    return df


# joins

# Whole tables for the inner join; the outer ones see customers with money and large orders, so that each side has rows without a match.
_CUST = "(select c_custkey as key, c_name as value from customer where c_acctbal > 0)"
_ORD = "(select o_custkey as key, o_orderkey as value from orders where o_totalprice > 300000)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _pairs(_t(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "c_name"), _pairs(_t(spark, d, "orders").where("o_totalprice > 300000"), "o_custkey", "o_orderkey")


def _join_sql(kind: str) -> str:
    return f"select coalesce(a.key, b.key) as key, a.value as value1, b.value as value2 from {_CUST} a {kind} join {_ORD} b on a.key = b.key"


_INNER = "select c_custkey as key, c_name as value1, o_orderkey as value2 from customer join orders on c_custkey = o_custkey"


@query(_INNER)
def join_inner(spark, d):
    return joins.join(_pairs(_t(spark, d, "customer"), "c_custkey", "c_name"), _pairs(_t(spark, d, "orders"), "o_custkey", "o_orderkey"))


@query(_join_sql("left"))
def join_left(spark, d):
    return joins.join(*_sides(spark, d), keep_left=True)


@query(_join_sql("right"))
def join_right(spark, d):
    return joins.join(*_sides(spark, d), keep_right=True)


@query(_join_sql("full"))
def join_full(spark, d):
    return joins.join(*_sides(spark, d), keep_left=True, keep_right=True)


@query(_join_sql("full"))
def join_partitioned_sorted(spark, d):
    return joins.join_co_partitioned(*_sides(spark, d), 8, True, True)


@query("select a.user_id as key, a.event_id as value1, b.v as value2 from events a join (values (1, 10), (1, 11), (2, 20), (3, 30), (3, 31)) b(k, v) on a.user_id = b.k")
def join_dup_cartesian(spark, d):
    small = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (3, 31)], "key bigint, value int")
    return joins.join(_pairs(_t(spark, d, "events"), "user_id", "event_id"), small)


@query("select a.n_regionkey as key, a.n_name as value1, b.n_name as value2 from nation a join nation b on a.n_regionkey = b.n_regionkey")
def self_join(spark, d):
    n = Dataset(_t(spark, d, "nation")).map_pairs("n_regionkey", "n_name")
    return n.join(n).df


@query("select a.key as key, a.value as value1, b.value as value2 from (select c_mktsegment as key, c_custkey as value from customer) a join (select upper(c_mktsegment) as key, count(*) as value from customer group by 1) b on lower(a.key) = lower(b.key)")
def join_ci_key(spark, d):
    c = _t(spark, d, "customer")
    right = _pairs(c.groupBy(F.upper("c_mktsegment").alias("k")).agg(F.count(F.lit(1)).alias("n")), "k", "n")
    return joins.join_on(_pairs(c, "c_mktsegment", "c_custkey"), right, F.lower)


@query("""with a as (select word as key, count(*) as value from (select unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) as word from part) where word <> '' group by 1),
    b as (select word as key, count(*) as value from (select unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as word from documents) where word <> '' group by 1)
    select coalesce(a.key, b.key) as key, a.value as value1, b.value as value2 from a full join b on a.key = b.key""")  # fmt: skip
def join_word_counts(spark, d):
    counts = lambda t, c: Dataset(_t(spark, d, t)).flat_map(fn.words(F.col(c))).map_pairs("value", "1L").reduce_by_key("sum", ordered=False).df
    return joins.join(counts("part", "p_name"), counts("documents", "text"), True, True)


def _nation_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _pairs(_t(spark, d, "customer").where("c_nationkey < 20"), "c_nationkey", "c_custkey"), _pairs(_t(spark, d, "supplier").where("s_nationkey > 4"), "s_nationkey", "s_suppkey")


_CO = """(select c_nationkey as key, count(*) as n, string_agg(cast(c_custkey as varchar), ',' order by c_custkey) as l, sum(c_custkey) as s from customer where c_nationkey < 20 group by 1) a
    full join (select s_nationkey as key, count(*) as n, string_agg(cast(s_suppkey as varchar), ',' order by s_suppkey) as l, sum(s_suppkey) as s from supplier where s_nationkey > 4 group by 1) b on a.key = b.key"""  # fmt: skip


@query(f"select coalesce(a.key, b.key) as key, coalesce(a.l, '') as values1, coalesce(b.l, '') as values2 from {_CO}")
def cogroup(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return joins.cogroup(*_nation_sides(spark, d)).select("key", text("values1"), text("values2"))


@query(f"select coalesce(a.key, b.key) as key, cast(coalesce(a.s, 0) + coalesce(b.s, 0) as bigint) as total from {_CO}")
def cogroup_sum(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, v: x + v)
    return joins.cogroup(*_nation_sides(spark, d)).select("key", (total("values1") + total("values2")).alias("total"))


@query(f"select coalesce(a.key, b.key) as key, coalesce(a.n, 0) as n1, coalesce(b.n, 0) as n2 from {_CO}")
def cogroup_with(spark, d):
    """An opaque function of both groups."""
    import pandas as pd

    def sizes(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [(a if len(a) else b)["key"].iloc[0]], "n1": [len(a)], "n2": [len(b)]})

    return joins.cogroup_with(*_nation_sides(spark, d), sizes, "key int, n1 bigint, n2 bigint")


@query("select n_regionkey as key, count(*) as n from nation group by 1")
def cogroup_self(spark, d):
    n = Dataset(_t(spark, d, "nation")).map_pairs("n_regionkey", "n_name")
    return n.cogroup(n).df.select("key", F.size("values").cast("long").alias("n"))


_BIG = "select o_custkey from orders where o_totalprice > 400000"


@query(f"select c_custkey as key, c_name as value from customer where c_custkey in ({_BIG})")
def semi_by_cogroup(spark, d):
    return joins.semi(_pairs(_t(spark, d, "customer"), "c_custkey", "c_name"), _pairs(_t(spark, d, "orders").where("o_totalprice > 400000"), "o_custkey", "1"))


@query(f"select c_custkey as key, c_name as value from customer where c_custkey not in ({_BIG})")
def anti_by_cogroup(spark, d):
    return joins.anti(_pairs(_t(spark, d, "customer"), "c_custkey", "c_name"), _pairs(_t(spark, d, "orders").where("o_totalprice > 400000"), "o_custkey", "1"))


# order


@query("select o_orderkey as key, o_totalprice as value from orders")
def sort_global(spark, d):
    return Dataset(_t(spark, d, "orders")).map_pairs("o_orderkey", "o_totalprice").sort().df


@query("select p_name as value from part")
def sort_ci(spark, d):
    return Dataset(_t(spark, d, "part")).map("p_name").sort(F.lower("value"), "value").df


@query("select n_name as value from nation")
def sort_comparator(spark, d):
    return Dataset(_t(spark, d, "nation")).map("n_name").sort_with(lambda a, b: a.lower() < b.lower()).df


@query("select event_type as key, count(*) as value from events group by 1")
def sort_desc_count(spark, d):
    return ordering.sort(Dataset(_t(spark, d, "events")).map_pairs("event_type", "1L").reduce_by_key("sum", ordered=False).df, F.desc("value"), "key")


@query("select cast(o_orderkey % 4 as int) as shard, o_orderkey as key, row_number() over (partition by o_orderkey % 4 order by o_orderkey) as place from orders")
def local_sort_rank(spark, d):
    df = ordering.local_sort(exchange.placed(_t(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 4))
    return df.select(F.spark_partition_id().alias("shard"), "key", (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).alias("place"))


@query("select l_orderkey as key, l_linenumber as value from lineitem")
def merge_sorted(spark, d):
    return Dataset(_t(spark, d, "lineitem")).map_pairs("l_orderkey", "l_linenumber").partition(4).local_sort().merge_sorted("key", "value").df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_orders(spark, d):
    return ordering.top(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


# programs


@query("select strftime(o_orderdate, '%Y-%m') as key, count(*) as value from orders group by 1")
def monthly_counts(spark, d):
    return Dataset(_t(spark, d, "orders")).map_pairs(fn.month(F.col("o_orderdate")), F.lit(1).cast("long")).reduce_by_key("sum").df


@query("select event_type as key, count(*) as value from events where user_id % 2 = 0 group by 1")
def tag_pairs(spark, d):
    """Rows of XML, their tags taken apart and counted."""
    e = _t(spark, d, "events")
    xml = e.select(F.format_string('<row PostTypeId="%d" Tags="<%s>" />', (F.col("user_id") % 2).cast("int"), F.col("event_type")).alias("value"))
    xml = xml.select(F.regexp_replace("value", 'Tags="<(.*)>"', 'Tags="&lt;$1&gt;"').alias("value"))
    rows = sources.xml_rows(xml, "_PostTypeId int, _Tags string").where("PostTypeId = 0")
    tags = Dataset(rows).flat_map(fn.tokens(fn.strip_ends(F.col("Tags")), "><"))
    return tags.map_pairs("value", "1L").reduce_by_key("sum").df


@query("""select c_custkey as key, cast(coalesce(sum(cast(o_totalprice as decimal(18,2))), 0) as double) as total from customer left join orders on c_custkey = o_custkey
    group by 1 having max(o_orderdate) is null or max(o_orderdate) < timestamp '2001-02-01' - interval 12 month""")  # fmt: skip
def user_posts(spark, d):
    """Users not seen for a year before a fixed time, and what they have spent."""
    last = F.add_months(F.lit("2001-02-01").cast("date"), -12).cast("timestamp_ntz")
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("seen"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    both = _t(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    both = both.where(F.col("seen").isNull() | (F.col("seen") < last))
    return both.select(F.col("c_custkey").alias("key"), F.coalesce("spent", F.lit(0)).cast("double").alias("total"))


@query(_INNER.replace("as key", "as x").replace("as value1", "as y").replace("as value2", "as z"))
def output_struct(spark, d):
    return sinks.renamed(join_inner(spark, d), "x", "y", "z")


@query("select p_name as value from part")
def text_roundtrip(spark, d):
    path = shared_dir(spark)
    sinks.save_text(_t(spark, d, "part").select(F.col("p_name").alias("value")), path)
    return sources.text_file(spark, path)


@query("select count(*) as files from (values (1), (2), (3))")
def directory_listing(spark, d):
    path = shared_dir(spark)
    sinks.save_text(_t(spark, d, "nation").select("n_name").repartition(3), path)
    return sources.binary_listing(spark, path).agg(F.count(F.lit(1)).alias("files"))


@query("select n_name as value from nation union all select r_name from region")
def send_receive(spark, d):
    """Lines sent to a topic twice, and received as a stream."""
    path = shared_dir(spark)
    sinks.send(_t(spark, d, "nation").select("n_name"), path)
    sinks.send(_t(spark, d, "region").select("r_name"), path)
    return run_to_end(receive(spark, path), "received")


@query("select event_type as key, count(*) as value from events group by 1")
def channel_stream_count(spark, d):
    """A live channel, counted at its end."""
    kind = _t(spark, d, "events").schema
    stream = receive(spark, f"{d}/events.parquet*", kind)
    return run_to_end(stream.groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("value")), "counted", "complete")


@query("select user_id as key, event_id * 2 as value from events where value > 50")
def channel_stream_map(spark, d):
    stream = receive(spark, f"{d}/events.parquet*", _t(spark, d, "events").schema)
    return run_to_end(stream.where("value > 50").select(F.col("user_id").alias("key"), (F.col("event_id") * 2).alias("value")), "mapped")


@query("select event_id as value from events where event_type = 'click' union all select user_id as value from events where event_type <> 'click'")
def channel_fan_in(spark, d):
    """Two live channels as one."""
    kind = _t(spark, d, "events").schema
    a, b = (receive(spark, f"{d}/events.parquet*", kind) for _ in range(2))
    one = a.where("event_type = 'click'").select(F.col("event_id").alias("value"))
    return run_to_end(fan_in(one, b.where("event_type <> 'click'").select(F.col("user_id").alias("value"))), "joined")


@query("select 2 * n_nationkey as value from nation union all select 2 * r_regionkey from region")
def fan_in_doubled(spark, d):
    """Bounded channels, each changed on its way."""
    parts = (_t(spark, d, t).select(F.col(c).alias("value")) for t, c in (("nation", "n_nationkey"), ("region", "r_regionkey")))
    return fan_in(*parts, change=lambda x: x.select((F.col("value") * 2).alias("value")))


@query("select event_id as key, row_number() over (order by value desc, event_id) as place from events")
def channel_stream_sort(spark, d):
    """A live channel, sorted when it ends: rows come back in the order of the files that the sink wrote, with their place."""
    path = shared_dir(spark)
    stream = receive(spark, f"{d}/events.parquet*", _t(spark, d, "events").schema)

    def sink(batch: DataFrame) -> None:
        batch.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()).write.mode("append").parquet(path)

    sorted_batches(stream, sink, F.desc("value"), "event_id")
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.col("id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(sizes, "part").select(F.col("event_id").alias("key"), (F.col("before") + inside).alias("place"))


# opaque functions beside nulls, and whole numbers that no double holds

_WIDE = "case when o_orderkey % 7 = 0 then null else o_orderkey + 9007199254740993 end"


@query(f"select o_orderkey as key, v + 1 as value from (select o_orderkey, {_WIDE} as v from orders)")
def map_with_nulls(spark, d):
    wide = Dataset(_t(spark, d, "orders").select("o_orderkey", F.expr(_WIDE).alias("v")))
    return wide.map_with(lambda k, v: (k, None if v is None else v + 1), "key bigint, value bigint").df


@query(f"select o_orderkey as key, v as value from (select o_orderkey, {_WIDE} as v from orders) where v is null or v % 2 = 0")
def filter_with_nulls(spark, d):
    wide = Dataset(_t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.expr(_WIDE).alias("value")))
    return wide.filter_with(lambda k, v: v is None or v % 2 == 0).df


@query(f"select bit_xor(v) as value from (select {_WIDE} as v from orders) having count(*) > 0")
def reduce_with_nulls(spark, d):
    wide = Dataset(_t(spark, d, "orders").select(F.expr(_WIDE).alias("value")))
    return wide.reduce_with(lambda a, b: b if a is None else a if b is None else a ^ b).df


# sinks, side effects, sources


@query("select 'customers' as tap, count(*) as n, cast(sum(c_custkey) as bigint) as total from customer union all select 'rich', count(*), cast(sum(c_custkey) as bigint) from customer where c_acctbal > 5000")
def output_taps(spark, d):
    """Two taps in the middle of a plan see every row; what they add up is the result."""
    seen: list[tuple[str, int, int]] = []

    def tap(name: str, want) -> sinks.Tap:
        def run(rows) -> None:
            n = total = 0
            for r in rows:
                if want(r):
                    n, total = n + 1, total + r["c_custkey"]
            seen.append((name, n, total))

        return run

    Dataset(_t(spark, d, "customer").select("c_custkey", "c_acctbal")).add_outputs(tap("customers", lambda r: True), tap("rich", lambda r: r["c_acctbal"] > 5000))
    return spark.createDataFrame(seen, "tap string, n bigint, total bigint")


@query("select p_name as value from part")
def save_text_file(spark, d):
    """One text file, read back by lines."""
    path = f"{shared_dir(spark)}/out.txt"
    Dataset(_t(spark, d, "part")).map("p_name").save_text_to_file(path)
    return sources.text_file(spark, path)


@query("select cast(sum(strlen(p_name)) as bigint) as bytes, string_agg(p_name, '' order by p_partkey)[1:1000] as head from part")
def save_bytes_file(spark, d):
    """One file of bytes, row after row."""
    path = f"{shared_dir(spark)}/out.bin"
    Dataset(_t(spark, d, "part").orderBy("p_partkey")).map("cast(p_name as binary)").save_bytes_to_file(path)
    file = spark.read.format("binaryFile").load(path)
    return file.select(F.col("length").alias("bytes"), F.substring("content", 1, 1000).cast("string").alias("head"))


@query("select n_nationkey as key, n_name as value from nation")
def side_effect(spark, d):
    """A map for its side effect alone: each partition writes what it sees, on the executors."""
    path = shared_dir(spark)

    def write(rows) -> None:
        where, plain = fs.FileSystem.from_uri(path)
        where.create_dir(plain)
        with where.open_output_stream(f"{plain}/{TaskContext.get().partitionId()}.txt") as f:
            for r in rows:
                f.write(f"{r['n_nationkey']}\t{r['n_name']}\n".encode())

    sinks.for_each(_t(spark, d, "nation").repartition(3), write)
    return sources.text_dir(spark, path).select(F.split("value", "\t")[0].cast("int").alias("key"), F.split("value", "\t")[1].alias("value"))


@query("select i as value, i as place from range(100) t(i)")
def slice_source(spark, d):
    """One shard, in order."""
    df = Dataset.slice(spark, range(100)).df
    return df.select("value", F.monotonically_increasing_id().alias("place"))


@query("select n_name as value from nation where n_regionkey = 1")
def directory_source(spark, d):
    """Lines of the files of a directory, not of those below it."""
    path = shared_dir(spark)
    names = _t(spark, d, "nation").select("n_name", "n_regionkey")
    sinks.save_text(names.where("n_regionkey = 1").select("n_name"), path)
    sinks.save_text(names.where("n_regionkey <> 1").select("n_name"), f"{path}/below")
    return sources.text_dir(spark, path)


@query("select r_name as value from region")
def listed_files(spark, d):
    """Files that a frame of paths names, read where the tasks run."""
    path = shared_dir(spark)
    sinks.save_text(_t(spark, d, "region").select("r_name").repartition(3), path)
    return sources.text_of_listing(sources.binary_listing(spark, path)).select("value")


@query("select count(*) as n, 1 as shards from orders")
def all_to_one(spark, d):
    df = exchange.merged(_t(spark, d, "orders").select("o_orderkey"))
    return df.select(F.spark_partition_id().alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").cast("int").alias("shards"))


@query("select count(*) as n, 4 as shards, true as even from orders")
def one_to_all(spark, d):
    """One shard dealt to four, evenly."""
    df = exchange.spread(_t(spark, d, "orders").select("o_orderkey").coalesce(1), 4)
    sizes = df.groupBy(F.spark_partition_id().alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("shards"), (F.max("n") - F.min("n") <= 4).alias("even"))


@query("select o_orderkey as key, strptime(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000'), '%Y-%m-%dT%H:%M:%S.%g') as value from orders")
def parsed_times(spark, d):
    """Times as text, parsed; text that is no time would be null."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), fn.parse_time(text).cast("timestamp_ntz").alias("value"))


@query("select count(*) as rows from lineitem where l_quantity > 10")
def run_statistics(spark, d):
    """Rows counted as they pass, by an observation of the run."""
    df, seen = observed(_t(spark, d, "lineitem").where("l_quantity > 10").select("l_orderkey"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows bigint")


@query("select 2 as sources, 1 as ends, 1 as joins")
def plan_plot(spark, d):
    """The plan of a join as a graph: two edges leave the start, one reaches the end."""
    lines = dot(join_inner(spark, d)).split("\n")
    row = (sum(x.strip().startswith("start ->") for x in lines), sum("-> end" in x for x in lines), sum("Join" in x for x in lines))
    return spark.createDataFrame([row], "sources int, ends int, joins int")
