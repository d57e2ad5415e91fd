"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardflow.llm.common import scratch, table
from shardflow.llm.exact_dedup import exact_duplicates
from shardflow.llm.html_layout import extract
from shardflow.llm.licences import licences
from shardflow.llm.mixing import mix
from shardflow.llm.packing import pack
from shardflow.llm.quality import quality
from shardflow.llm.secret_scan import secrets
from shardflow.llm.simhash import near_duplicates
from shardflow.llm.token_scan import document_tokens
from shardflow.llm.toxicity import toxicity

#: A parameter of every query that tokenises; the file is never copied.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


#: Marks the ends of documents in flat token files.
END = 49407


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written to flat token files in the shared folder; the scan reads these alone."""
    return document_tokens(table(spark, sf_dir, "documents"), f"{scratch(spark)}/tokens-{uuid.uuid4().hex[:12]}", VOCABULARY, END)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: each is a file source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return licences(docs.withColumn("path", path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in sorted(globals().items()) if n[:2] == "op" and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    body = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
    return {
        "op8_exact_dedup": f"""
            with d as (select doc_id, {body} as body, length(coalesce(text, '')) as len from documents)
            select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size,
                   row_number() over w = 1 as kept, sha256(body) as text_sha256
            from d window w as (partition by body order by len desc, doc_id nulls last)"""
    }
