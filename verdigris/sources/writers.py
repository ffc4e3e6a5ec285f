"""Writers: canonical JSONL, CSV summaries, splits, snapshots, and caches that a failed write can't harm."""

from __future__ import annotations

import json
import os
import random
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.quality import DataQualityError


def canonical_json(df: DataFrame) -> Column:
    """Each row as JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, source: str | None = None, compression: str = "none") -> None:
    """Sorted keys, one row per line, many files; refuses to write onto its own source."""
    if source is not None and os.path.realpath(source) == os.path.realpath(path):
        raise DataQualityError("input and output must be distinct paths")
    df.select(canonical_json(df).alias("value")).write.option("compression", compression).text(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A small summary as one CSV file with header; null is an empty cell."""
    kinds = dict(df.dtypes)
    shown = df if digits is None else df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
    shown.coalesce(1).write.option("header", True).option("emptyValue", "").csv(path)


def write_summary(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A small summary as CSV and as JSON lines with sorted keys, under path/csv and path/json."""
    write_csv(df, f"{path}/csv", digits)
    df.coalesce(1).select(canonical_json(df).alias("value")).write.text(f"{path}/json")


def write_export(df: DataFrame, path: str, sources: DataFrame) -> None:
    """Gzipped canonical JSONL under path/rows, and under path/manifest the (path, sha256) of what it was made from."""
    write_jsonl(df, f"{path}/rows", compression="gzip")
    write_jsonl(sources.select("path", "sha256").orderBy("path").coalesce(1), f"{path}/manifest")


def write_replication(train: DataFrame, validation: DataFrame, path: str, num_samples: int, seed: int = 10, few_shot: int = 5, ptrue: int = 20, index: str = "source_index") -> dict:
    """Train and eval files, few-shot demonstrations, P(True) examples and a manifest, all drawn by one seeded generator.

    Demonstrations and P(True) examples are answerable rows of train; the train draw avoids both. train and validation have
    question, context, answers (array of strings) and a number per row. Numbers are drawn on the driver, at most
    num_samples of them; rows are joined back by number.
    """
    rng = random.Random(seed)
    spark = train.sparkSession
    able = sorted(r[0] for r in train.where(F.exists("answers", lambda a: F.trim(a) != "")).select(index).collect())
    shots = rng.sample(able, few_shot)
    examples = rng.sample(sorted(set(able) - set(shots)), ptrue)
    rest = sorted(set(able) - set(shots) - set(examples))
    drawn = {"train": rng.sample(rest, min(num_samples, len(rest)))}
    others = sorted(r[0] for r in validation.select(index).collect())
    drawn["eval"] = rng.sample(others, min(num_samples, len(others)))

    def picked(df: DataFrame, numbers: list[int]) -> DataFrame:
        places = spark.createDataFrame(list(zip(numbers, range(len(numbers)), strict=True)), f"{index} long, _place long")
        return df.join(F.broadcast(places), index).orderBy("_place").drop("_place")

    parts = {"train": picked(train, drawn["train"]), "eval": picked(validation, drawn["eval"]), "ptrue_examples": picked(train, examples)}
    parts["fewshot"] = picked(train, shots).select("question", F.get("answers", 0).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), index)
    for name, df in parts.items():
        write_jsonl(df.coalesce(1), f"{path}/{name}")
    manifest = {"random_seed": seed, "num_few_shot": few_shot, "p_true_num_fewshot": ptrue, "num_samples": num_samples, "train_size": train.count(), "validation_size": len(others), "prompt_indices": shots, "p_true_indices": examples, "train_selected": drawn["train"], "validation_selected": drawn["eval"], "train_overlap_with_prompts": sorted(set(drawn["train"]) & {*shots, *examples})}
    write_json(manifest, f"{path}/manifest", spark)
    return manifest


def write_json(value: dict, path: str, spark) -> None:
    """One JSON object as a text file under path, wherever Spark writes."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def write_measurements(df: DataFrame, path: str) -> None:
    """The long fact table, partitioned so that slices prune."""
    df.write.partitionBy("condition", "entailment_backend").parquet(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder of canonical JSONL per split."""
    df.select(column, canonical_json(df).alias("value")).write.partitionBy(column).text(path)


def grow_cache(fresh: DataFrame, path: str) -> None:
    """New keys only, appended as files of their own; the default committer shows them all or none."""
    spark = fresh.sparkSession
    try:
        known = spark.read.parquet(path).select("key")
        fresh = fresh.join(known, "key", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.dropDuplicates(["key"]).write.mode("append").parquet(path)


def write_sidecar(meta: dict, path: str) -> None:
    """Job metadata beside an output, by a rename."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w") as out:
        json.dump(meta, out, sort_keys=True, indent=2)
    os.replace(part, path)
