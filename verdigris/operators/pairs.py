"""Pairwise entailment: enumeration, global dedup, cache split, labelling on distinct misses, and the way back to matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import content_key


def ordered_pairs(records: DataFrame, keys: list[str], answers: str) -> DataFrame:
    """keys, i, j, premise, hypothesis for all i <> j; at most M * M rows per record, made in the row."""
    a = records.select(*keys, F.posexplode(answers).alias("i", "premise"), F.col(answers).alias("_all"))
    return a.select(*keys, "i", "premise", F.posexplode("_all").alias("j", "hypothesis")).where("i <> j")


def distinct_tasks(pairs: DataFrame) -> DataFrame:
    """Each differing (premise, hypothesis) once over all records; equal strings need no model."""
    return pairs.where("premise <> hypothesis").select("premise", "hypothesis").distinct()


def with_keys(tasks: DataFrame, model: str, mode: str) -> DataFrame:
    return tasks.withColumn("key", content_key(F.lit(model), F.lit(mode), F.col("premise"), F.col("hypothesis")))


def cache_split(tasks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their label, misses) by content key."""
    return tasks.join(cache.select("key", "label"), "key"), tasks.join(cache.select("key"), "key", "left_anti")


def labelled(pairs: DataFrame, cache: DataFrame, predict: Callable[[DataFrame], DataFrame], model: str = "stub", mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(pairs with label, the grown cache): predict(misses with key) adds label and sees every distinct miss once."""
    hits, misses = cache_split(with_keys(distinct_tasks(pairs), model, mode), cache)
    fresh = predict(misses)
    known = hits.select("key", "premise", "hypothesis", "label").unionByName(fresh.select("key", "premise", "hypothesis", "label"))
    met = pairs.join(known.select("premise", "hypothesis", "label"), ["premise", "hypothesis"], "left")
    done = met.withColumn("label", F.when(F.col("premise") == F.col("hypothesis"), "entailment").otherwise(F.col("label")))
    return done, cache.select("key", "label").unionByName(fresh.select("key", "label"))


def matrices(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matrix: codes 0 contradiction, 1 entailment, 2 neutral; the diagonal entails."""
    code = F.when(F.col("label") == "contradiction", 0).when(F.col("label") == "entailment", 1).otherwise(2)
    rows = pairs.select(*keys, "i", "j", code.alias("c"))
    cells = rows.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("j", "c"))).alias("r")).withColumn("r", F.concat(F.filter("r", lambda x: x["j"] < F.col("i")), F.array(F.struct(F.col("i").alias("j"), F.lit(1).alias("c"))), F.filter("r", lambda x: x["j"] > F.col("i"))))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: F.transform(x["r"], lambda y: y["c"])).alias("matrix"))
