"""Where artifacts come from: contracts of probe artifacts, alignment of runs, and provenance that records must carry."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators import metrics
from verdigris.operators.quality import DataQualityError, rules, same_keys

# Targets and kinds of probes, poolings, and what a reclustered record of the paper's protocol says of itself.
KIND_OF = {"correctness": "accuracy_probe", "semantic_entropy_threshold": "semantic_entropy_probe"}
POOLINGS = ("last", "mean", "mean_last_k")
RECLUSTERED = {"clustering_rule": "bidirectional", "clustering_closure": "anchor_scan", "cluster_input": "sampled_answers", "entailment_input_format": "question_answer_paper", "question_conditioned": True}
SHA256 = re.compile("[0-9a-f]{64}")


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def artifact_problems(probe: dict) -> list[str]:
    """What a probe's artifact (one JSON object, on the driver) lacks to be used; nothing for a sound one."""
    coef, source, meta = probe.get("coef"), probe.get("label_source"), probe.get("metadata") or {}
    checks = {
        "coef: finite numbers": isinstance(coef, list) and bool(coef) and all(map(_number, coef)),
        "intercept: finite number": _number(probe.get("intercept")),
        "hidden_dim: the coefficients' number": isinstance(coef, list) and probe.get("hidden_dim") == len(coef),
        "label_source: known": source in KIND_OF,
        "probe_kind: the target's": probe.get("probe_kind") == KIND_OF.get(source),
        "pooling: known": probe.get("pooling", "last") in POOLINGS,
        "train_size: positive": isinstance(probe.get("train_size"), int) and probe["train_size"] > 0,
        "positive_rate: within (0, 1)": _number(probe.get("positive_rate")) and 0 < probe["positive_rate"] < 1,
    }
    if source == "semantic_entropy_threshold":
        checks["label_threshold: finite number"] = _number(probe.get("label_threshold"))
        checks["source_score_field: named"] = bool(str(probe.get("source_score_field") or "").strip())
        checks["metadata.threshold_fit_scope: training records"] = meta.get("threshold_fit_scope") == "training_records_only"
    else:
        checks["label_threshold: none"] = probe.get("label_threshold") is None
    hashes = [k for k in meta if k.endswith("sha256")]
    checks |= {f"metadata.{k}: SHA-256": isinstance(meta[k], str) and bool(SHA256.fullmatch(meta[k])) for k in hashes}
    train, scored = meta.get("train_prompt_content_sha256"), meta.get("eval_prompt_content_sha256")
    checks["metadata: training and evaluation prompts differ"] = train is None or train != scored
    cut, total, most = (meta.get(k) for k in ("sampled_truncated", "sampled_total", "sampled_truncation_limit"))
    if total is not None:
        checks["metadata: truncation within its limit"] = all(map(_number, (cut, total, most))) and 0 <= cut <= total and total > 0 and cut / total <= most
    return [name for name, ok in checks.items() if not ok]


def common_identity(df: DataFrame, columns: list[str], role: str) -> dict:
    """The one value of each column that all rows share; an error if a column has several, is null or blank, or no rows."""
    found = df.agg(F.count("*").alias("_n"), *[F.countDistinct(F.coalesce(F.to_json(F.struct(c)), F.lit(""))).alias(f"_d{i}") for i, c in enumerate(columns)], *[F.first(c).alias(f"_v{i}") for i, c in enumerate(columns)]).first()
    bad = [c for i, c in enumerate(columns) if found[f"_d{i}"] != 1 or found[f"_v{i}"] is None or str(found[f"_v{i}"]).strip() == ""]
    if not found["_n"] or bad:
        raise DataQualityError(f"{role}: no common value of {', '.join(bad) or 'any column'}")
    return {c: found[f"_v{i}"] for i, c in enumerate(columns)}


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """digest: SHA-256 over the sorted distinct rows as JSON, one a line; rows of one split by design.

    Rows are hashed first, so what meets in one place is 64 characters a row, whatever their texts.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return df.select(row.alias("h")).distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("digest"))


def prompt_content_digest(records: DataFrame) -> DataFrame:
    """digest: SHA-256 of the held-out prompts as one JSON array, sorted by id; an error for blank, missing or repeated ones.

    The array's bytes are fixed, so it is put together in one place; it holds the prompts of one split, not its records.
    """
    names = ["prompt_id", "dataset", "split", "prompt"]
    blank = rules({f"{c}: not empty": F.trim(c) != "" for c in names} | {"reference_answers: strings": F.forall("reference_answers", lambda r: r.isNotNull())})
    bad = records.select("prompt_id", blank.alias("v")).where(F.size("v") > 0).limit(3).collect()
    twice = records.groupBy("prompt_id").count().where("count > 1").limit(3).collect()
    if bad or twice:
        raise DataQualityError(f"prompts that can't be told apart or are incomplete: {[r.asDict() for r in bad + twice]}")
    parts = F.concat(F.lit("["), F.array_join(F.concat(F.transform(F.array(*names), _json), F.array(F.to_json("reference_answers"))), ","), F.lit("]"))
    one = records.select(F.struct("prompt_id", parts.alias("json")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return one.select(F.sha2(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]")), 256).alias("digest"))


def _json(text: Column) -> Column:
    """A string as JSON: what an array of it alone is, without the brackets."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def probe_fits(probes: DataFrame, fits: DataFrame) -> DataFrame:
    """probes with their fit, by the SHA-256 of the fit's file; an error unless every probe has exactly one."""
    met = probes.join(fits.withColumnRenamed("sha256", "fit_sha256"), "fit_sha256", "left")
    told = met.groupBy(*probes.columns).agg(F.count("threshold").alias("n")).where("n <> 1").limit(3).collect()
    if told:
        raise DataQualityError(f"probes without exactly one fit: {[r.asDict() for r in told]}")
    return met


def probe_targets(records: DataFrame, provenance: dict, fit: dict, source_hash: str = "source_artifact_sha256") -> DataFrame:
    """records with target: the score is at or above the threshold that was fitted on training records alone.

    An error unless the artifact's threshold and provenance are the fit's, and all records come from the artifact that
    the provenance names.
    """
    wanted = {"label_source": "semantic_entropy_threshold", "threshold_fit_scope": "training_records_only", "label_threshold": fit["threshold"], "entropy_target_provenance": fit["entropy_target_provenance"]}
    wrong = [k for k, v in wanted.items() if provenance.get(k) != v]
    if wrong:
        raise DataQualityError(f"a probe's {', '.join(wrong)} differ from its fit")
    named = provenance["entropy_target_provenance"]["eval_source_artifact_sha256"]
    score = F.element_at("scores", provenance["source_score_field"])
    other = F.raise_error(F.lit("a record comes from another artifact than the target")).cast("boolean")
    return records.withColumn("target", F.when(F.col(source_hash) == named, score >= provenance["label_threshold"]).otherwise(other))


def aligned(grades: DataFrame, generations: DataFrame, backends: DataFrame, run: str = "run_id", key: str = "prompt_id", equal: tuple[str, ...] = ("prompt", "model", "correctness_label"), backend: str = "entailment_backend") -> DataFrame:
    """The backends' rows, once they're known to be those of the generations and grades of their run.

    Three tables meet on (run, key): each must hold the same keys in every run, and agree on the columns `equal`.
    """
    for name, other in (("grades", grades), ("generations", generations)):
        lost = same_keys(backends.select(run, key), other.select(run, key), [run, key]).limit(3).collect()
        if lost:
            raise DataQualityError(f"backends and {name} hold different rows: {[r.asDict() for r in lost]}")
    per_backend = backends.groupBy(run, backend).agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"))
    sizes = per_backend.join(generations.groupBy(run).agg(F.countDistinct(key).alias("g")), run).where("n <> d or d <> g").limit(3).collect()
    if sizes:
        raise DataQualityError(f"runs with lost or repeated rows: {[r.asDict() for r in sizes]}")
    met = backends.alias("b").join(generations.alias("a"), [run, key]).join(grades.alias("g"), [run, key])
    differ = rules({f"{c}: as generated and graded": F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) & F.col(f"b.{c}").eqNullSafe(F.col(f"g.{c}")) for c in equal})
    bad = met.select(run, key, differ.alias("differ")).where(F.size("differ") > 0).limit(3).collect()
    if bad:
        raise DataQualityError(f"rows that differ: {[r.asDict() for r in bad]}")
    return backends


def validate_snapshot(grades: DataFrame, generations: DataFrame, backends: DataFrame, published: DataFrame, methods: list[str], n_keys: int, judge: str, run: str = "run_id", key: str = "prompt_id", backend: str = "entailment_backend", digits: int = 6) -> DataFrame:
    """(run, backend, method, auroc) of a frozen set of runs, once all of it is sound; an error otherwise.

    Every run has n_keys keys, graded by the one judge; grades, generations and backends are aligned; scores are finite and
    both classes present; every AUROC is the published one to `digits` places, and none is missing on either side.
    published: run, backend, method, auroc. Scores are columns named like methods.
    """
    sizes = grades.groupBy(run).agg(F.countDistinct(key).alias("n"), F.min("judge_model").alias("low"), F.max("judge_model").alias("high")).where((F.col("n") != n_keys) | (F.col("low") != judge) | (F.col("high") != judge)).limit(3).collect()
    if sizes:
        raise DataQualityError(f"runs of another size or judge: {[r.asDict() for r in sizes]}")
    rows = aligned(grades, generations, backends, run, key, backend=backend)
    long = rows.select(run, backend, (~F.col("correctness_label")).alias("incorrect"), *methods).unpivot([run, backend, "incorrect"], methods, "method", "score")
    if long.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).limit(1).collect():
        raise DataQualityError("scores that aren't finite")
    cell = [run, backend, "method"]
    found = metrics.auroc(long, cell, "incorrect", "score")
    met = found.withColumnRenamed("auroc", "computed").join(published.select(*cell, F.col("auroc").alias("published")), cell, "full")
    off = met.where(~F.coalesce(F.round("computed", digits) == F.round("published", digits), F.lit(False))).limit(3).collect()
    if off:
        raise DataQualityError(f"measurements that aren't the published ones: {[r.asDict() for r in off]}")
    return found


def recluster_checks(df: DataFrame, expected: dict[str, object] = RECLUSTERED) -> dict[str, Column]:
    """A reclustered record says by which rule, closure and input; absent columns fail."""
    return {f"{k}: as expected": F.col(k) == F.lit(v) if k in df.columns else F.lit(False) for k, v in expected.items()}
