"""Training-corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage judges each row by itself, told apart by its place in the table: rows with a null or repeated id too.
Documents with null or empty texts pass all filters but near-dedup, where they're copies of one another; empty tables
pass as they are; other columns, whatever their names, are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import decontamination, near_copies, packing, substrings, toxicity
from verdigris.llm.common import KEPT, kept_since, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays."""
    return near_copies.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; what is left keeps its spacing and line breaks, and all other columns."""
    done = substrings.cut_repeated(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

#: Tokenizers, fitted classifiers and hashed sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again as the next one's input."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), list(KEPT)
    for name, stage in STAGES[:-1]:
        # What a stage wrote on its way, and its predecessor's table, go once its own table is written.
        docs = stored(stage(spark, docs, sf_dir), name, clear=kept_since(start))
    return STAGES[-1][1](spark, docs, sf_dir)
