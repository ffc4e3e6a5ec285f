"""The subpackage's registered queries: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import bsi, chat, decontamination, packing, simhash, substrings, token_counts, toxicity, url_filters, warc
from verdigris.llm.common import new_path
from verdigris.llm.sql import ORACLE

#: (action, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bsi.top_inner_products(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    # One scan: the record type is pushed to the reader; responses' payloads are held against their digests, none is returned.
    return warc.read_warc(spark, path, payload=False, verify=True).where("record_type in ('response', 'revisit')").select(columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filters.RULE_SCHEMA)
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations")).drop("segment", "pos")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_packing, op2_topk, op3_toxicity, op4_warc, op5_decontamination, op6_url_filters, op7_chat, op8_token_counts, op9_simhash, op10_substrings, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
