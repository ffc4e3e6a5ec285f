"""Data-quality rules as columns: an array of violations per row, and gates that fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed vocabularies of a record.
PHASES = ("phase1", "phase2")
CLUSTERS = ("local", "tinygpu", "alex")
TIERS = ("small", "7b_8b", "70b_plus")
STRINGS = ("run_id", "prompt_id", "dataset", "split", "prompt", "model", "entailment_backend")
REQUIRED_SCORES = ("surface_entropy", "discrete_semantic_entropy")


# The two sources of correctness labels, each with its scope.
AUTOMATED = ("automated_llm_reference_judge", "exploratory_proxy")
HUMAN = ("published_factualbio_human", "primary_human_annotation")


class DataQualityError(ValueError):
    """Rows break a rule that must hold for all."""


def rules(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold (null counts as not holding), in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def record_checks(df: DataFrame) -> dict[str, Column]:
    """The checks of a scored record for the columns that df has; absent required columns fail."""
    c = F.col
    has = set(df.columns)
    n = c("decoding.num_samples") if "decoding" in has else F.lit(None).cast("int")
    out = {f"{x}: non-empty string": F.trim(c(x)) != "" if x in has else F.lit(False) for x in STRINGS}
    for x, allowed in (("phase", PHASES), ("cluster", CLUSTERS), ("model_tier", TIERS)):
        out[f"{x}: closed vocabulary"] = c(x).isin(*allowed) if x in has else F.lit(False)
    out["reference_answers: not empty"] = F.size("reference_answers") > 0 if "reference_answers" in has else F.lit(False)
    for x in ("sampled_answers", "normalized_answers", "semantic_clusters"):
        out[f"{x}: num_samples entries"] = F.size(x) == n if x in has else F.lit(False)
    out["decoding: positive counts"] = (n > 0) & (c("decoding.max_new_tokens") > 0) if "decoding" in has else F.lit(False)
    out["cluster_representatives: one per cluster"] = F.size("cluster_representatives") == F.size(F.array_distinct("semantic_clusters")) if {"cluster_representatives", "semantic_clusters"} <= has else F.lit(False)
    out["scores: finite, not negative"] = F.forall(F.map_values("scores"), lambda v: finite(v) & (v >= 0)) if "scores" in has else F.lit(False)
    for x in REQUIRED_SCORES:
        out[f"scores.{x}: present"] = F.map_contains_key("scores", x) if "scores" in has else F.lit(False)
    out["correctness_label: boolean"] = c("correctness_label").isNotNull() if "correctness_label" in has else F.lit(False)
    if "sequence_logprobs" in has:
        lp = c("sequence_logprobs")
        out["sequence_logprobs: finite, num_samples entries"] = lp.isNull() | (F.forall(lp, finite) & (F.size(lp) == n))
    if "hidden_states" in has:
        hs = c("hidden_states")
        out["hidden_states: rectangular"] = hs.isNull() | (F.size(F.array_distinct(F.transform(hs, lambda v: F.size(v)))) <= 1)
    return out


def cluster_checks(ids: Column, representatives: Column, normalized: Column) -> dict[str, Column]:
    """Ids are contiguous from zero in some order, and every representative is a member of its cluster."""
    zipped = F.arrays_zip(ids.alias("i"), normalized.alias("a"))
    member = F.forall(F.sequence(F.lit(0), F.size(representatives) - 1), lambda k: F.exists(zipped, lambda z: (z["i"] == k) & (z["a"] == F.get(representatives, k))))
    return {"clusters: not negative": F.array_min(ids) >= 0, "clusters: contiguous": F.array_max(ids) == F.size(F.array_distinct(ids)) - 1, "representatives: one per cluster": F.size(representatives) == F.size(F.array_distinct(ids)), "representatives: members": member}


def require(df: DataFrame, violations: str = "violations", limit: int = 5) -> DataFrame:
    """df itself if no row has violations, else an error that shows some."""
    bad = df.where(F.size(violations) > 0).limit(limit).collect()
    if bad:
        raise DataQualityError("; ".join(str(r.asDict()) for r in bad))
    return df


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side; empty if the sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def common_value(df: DataFrame, column: str):
    """The one non-empty value that all rows share."""
    found = df.select(column).distinct().limit(2).collect()
    if len(found) != 1 or found[0][0] in (None, ""):
        raise DataQualityError(f"{column} has no common value")
    return found[0][0]


def degenerate_groups(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups whose rows all have one label."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(label).alias("n_labels")).where("n_labels < 2")


PROVENANCE = "struct<source: string, scope: string, judge_model: string, target: string, representative_policy: string>"


def automated_provenance(judge: str, target: str, policy: Column) -> Column:
    """The provenance of a label that a judge gave here."""
    if not judge.strip() or not target.strip():
        raise ValueError("a judge and a target must be named")
    values = {"source": F.lit(AUTOMATED[0]), "scope": F.lit(AUTOMATED[1]), "judge_model": F.lit(judge.strip()), "target": F.lit(target.strip()), "representative_policy": policy}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(PROVENANCE)


def provenance_checks(p: Column) -> dict[str, Column]:
    """A label's source is known and has its own scope; its target is named, and the judge of an automated one."""
    known = {AUTOMATED[0]: AUTOMATED[1], HUMAN[0]: HUMAN[1]}
    scope = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    judged = (p["source"] != AUTOMATED[0]) | (F.trim(F.coalesce(p["judge_model"], F.lit(""))) != "")
    return {"source: supported": p["source"].isin(*known), "scope: the source's": F.try_element_at(scope, p["source"]) == p["scope"], "target: not empty": F.trim(p["target"]) != "", "judge_model: named": judged}


def provenance_ok(p: Column) -> Column:
    out = F.lit(True)
    for ok in provenance_checks(p).values():
        out = out & F.coalesce(ok, F.lit(False))
    return out


def single_model(df: DataFrame, keys: list[str], model: str, judge: str | None = None) -> DataFrame:
    """(keys, n_models) of groups that don't have exactly one model, or another than their judge (a column)."""
    wrong = F.max(F.col(model) != F.col(judge)) if judge else F.lit(False)
    return df.groupBy(*keys).agg(F.countDistinct(model).alias("n_models"), wrong.alias("_wrong")).where((F.col("n_models") != 1) | F.coalesce("_wrong", F.lit(True))).drop("_wrong")


def off_by(computed: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys where a recomputed value differs from the published one by more than tolerance, or one side lacks it."""
    met = computed.select(*keys, F.col(value).alias("computed")).join(published.select(*keys, F.col(value).alias("published")), keys, "full")
    return met.where(~F.coalesce(F.abs(F.col("computed") - F.col("published")) <= tolerance, F.lit(False)))


def set_digest(df: DataFrame, column: str) -> DataFrame:
    """digest: SHA-256 over the sorted distinct values, one per line; one group by design, ids of one split."""
    return df.select(column).distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256).alias("digest"))


# The one admitted protocol of hidden-state features.
FEATURE_PROTOCOL = {
    "protocol": "kossen_sep_2024",
    "feature_response_decoding": "greedy",
    "token_selection": "final_content_token_before_eos_or_eot",
    "layer_selection": "preregistered_final_layer",
    "generation_termination": "eos_or_eot",
    "generation_config_source": "model_generation_config_clone",
    "sampling_temperature": 1.0,
    "sampling_top_p": 0.9,
    "sampling_top_k": 50,
    "sampling_num_responses": 10,
    "feature_response_max_new_tokens": 256,
}
RECORD_COUNTS = {"triviaqa": 378, "nqopen": 400, "svamp": 300, "bio": 500}


def feature_checks(metadata: Column, hidden: Column, greedy: Column, decoding: Column) -> dict[str, Column]:
    """The checks of a record's hidden-state feature: taken at a terminator, excluded, or recovered after exclusion.

    metadata is a struct of sources.schema.FEATURE. An excluded record (greedy decoding never ended) has no vector and
    no positions; one that names a feature_backfill has a vector but no positions; all others have both.
    """
    m = metadata
    sha = r"^[0-9a-fA-F]{40}$"
    excluded = F.coalesce(m["greedy_degenerate_excluded"], F.lit(False))
    back = m["feature_backfill"]
    absent = excluded & back.isNull()
    plain = ~excluded
    stopped = F.coalesce(m["feature_token_basis"], F.lit("eos_terminated")) == "stop_truncated"
    ends, index, end = m["termination_token_ids"], m["generated_content_token_index"], m["terminating_special_token_id"]

    def text(x: Column) -> Column:
        return F.trim(x) != ""

    def where(applies: Column, check: Column) -> Column:
        return F.when(applies, check).otherwise(True)

    out = {f"feature.{k}: admitted value": m[k] == v for k, v in FEATURE_PROTOCOL.items()}
    out |= {f"feature.{k}: non-empty string": text(m[k]) for k in ("model_id", "tokenizer_id")}
    out |= {f"feature.{k}: full revision": m[k].rlike(sha) for k in ("model_revision", "tokenizer_revision")}
    out |= {f"feature.{k}: integer": m[k].isNotNull() for k in ("hidden_layer", "sampling_max_new_tokens", "base_seed", "prompt_seed")}
    ended, cut = m["sampled_eos_or_eot_count"], m["sampled_max_new_tokens_count"]
    out["feature: termination counts"] = (ended >= 0) & (cut >= 0) & (ended + cut == m["sampling_num_responses"])
    out["feature.termination_token_ids: sorted, distinct, not empty"] = (F.size(ends) > 0) & (ends == F.array_sort(F.array_distinct(ends)))
    for k, want in (("temperature", F.lit(1.0)), ("top_p", F.lit(0.9)), ("top_k", F.lit(50)), ("num_samples", F.lit(10)), ("max_new_tokens", m["sampling_max_new_tokens"]), ("seed", m["base_seed"])):
        out[f"decoding.{k}: as in the feature"] = decoding[k] == want
    out["greedy answer: present"] = greedy.isNotNull()
    out["hidden state: finite vector, or none if excluded"] = F.when(absent, hidden.isNull()).otherwise((F.size(hidden) > 0) & F.forall(hidden, finite))
    out["feature.hidden_dimension: the vector's length"] = F.when(absent, m["hidden_dimension"].isNull()).otherwise(m["hidden_dimension"] == F.size(hidden))
    out["feature: no positions if excluded"] = where(excluded, end.isNull() & index.isNull() & m["full_sequence_token_index"].isNull())
    out["feature_backfill: named and revised"] = where(excluded & back.isNotNull(), text(back["method"]) & text(back["token_selection"]) & text(back["model_id"]) & back["model_revision"].rlike(sha) & back["hidden_layer"].isNotNull())
    out["feature_token_basis: closed vocabulary"] = where(plain, F.coalesce(m["feature_token_basis"].isin("eos_terminated", "stop_truncated"), F.lit(True)))
    out["feature: terminator"] = where(plain, F.when(stopped, end.isNull()).otherwise(F.array_contains(ends, end)))
    out["feature: position within the budget"] = where(plain, (index >= 0) & (index < m["feature_response_max_new_tokens"]) & m["full_sequence_token_index"].isNotNull())
    out["feature.sampling_max_new_tokens: positive"] = where(plain, m["sampling_max_new_tokens"] > 0)
    return out


def grid_coverage(cells: DataFrame, config: list[str], factors: list[str], expected: DataFrame) -> DataFrame:
    """(config, n_cells, n_repeated, problem): configurations whose cells aren't exactly the expected grid.

    expected holds each configuration with n_expected cells. Counted in one pass; only configurations meet.
    """
    once = cells.groupBy(*config, *factors).count()
    seen = once.groupBy(*config).agg(F.count("*").alias("n_cells"), F.count_if(F.col("count") > 1).alias("n_repeated"))
    met = seen.join(expected.select(*config, "n_expected"), config, "full")
    found = F.when(F.col("n_cells").isNull(), "missing").when(F.col("n_expected").isNull(), "unexpected").when(F.col("n_repeated") > 0, "repeated").when(F.col("n_cells") != F.col("n_expected"), "incomplete")
    zero = F.lit(0).cast("long")
    return met.select(*config, F.coalesce("n_cells", zero).alias("n_cells"), F.coalesce("n_repeated", zero).alias("n_repeated"), found.alias("problem")).where("problem is not null")


def range_checks(metrics: list[str], length: str | None = None) -> dict[str, Column]:
    """Metrics are finite and within [0, 1], a length is finite and not negative."""
    out = {f"{x}: within [0, 1]": finite(F.col(x)) & F.col(x).between(0, 1) for x in metrics}
    if length:
        out[f"{length}: finite, not negative"] = finite(F.col(length)) & (F.col(length) >= 0)
    return out


def count_checks(dataset: Column, n: Column, counts: dict[str, int] = RECORD_COUNTS) -> dict[str, Column]:
    """A cell has the number of records that its dataset has."""
    return {"n_records: as the dataset has": n == F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[dataset]}


def interval_checks(delta: Column, measured: Column, lo: Column, hi: Column, p: Column, tolerance: float = 2e-6) -> dict[str, Column]:
    """An exported interval: its point estimate is the measured one, its ends are in order, p is a probability."""
    return {"delta: as measured": finite(delta) & (F.abs(delta - measured) <= tolerance), "interval: in order": finite(lo) & finite(hi) & (lo <= hi), "p: within [0, 1]": finite(p) & p.between(0, 1)}


def split_audit(rows: DataFrame, split: str, key: str, content: list[str], left: str, right: str) -> DataFrame:
    """(measure, value): n_left, n_right, shared_keys and shared_content; a sound split shares neither."""
    is_l, is_r = F.col(split) == left, F.col(split) == right

    def shared(by: list[str], name: str) -> DataFrame:
        both = rows.groupBy(*by).agg(F.max(is_l).alias("_l"), F.max(is_r).alias("_r"))
        return both.agg(F.count_if(F.col("_l") & F.col("_r")).alias("value")).select(F.lit(name).alias("measure"), "value")

    sizes = rows.agg(F.count_if(is_l).alias("n_left"), F.count_if(is_r).alias("n_right")).unpivot([], ["n_left", "n_right"], "measure", "value")
    return sizes.unionByName(shared([key], "shared_keys")).unionByName(shared(content, "shared_content"))


def propagated_labels(graded: DataFrame, runs: DataFrame, cell: list[str], key: str, label: str) -> DataFrame:
    """(cell, key, label, side): labels for every row of runs; side is left or right where only one of the two has the key."""
    a = graded.select(*cell, key, label, F.lit(True).alias("_g"))
    b = runs.select(*cell, key, F.lit(True).alias("_r"))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_g").isNull(), "right")
    return a.join(b, [*cell, key], "full").select(*cell, key, label, side.alias("side"))


def finite_mean(x: Column) -> Column:
    """Mean of the finite values; null if there are none."""
    return F.avg(F.when(finite(x), x))


def spread_gate(df: DataFrame, keys: list[str], value: str, digits: int, least: int = 3) -> DataFrame:
    """Groups whose value takes fewer than least distinct values after rounding, or is one value throughout."""
    v = F.round(value, digits)
    return df.groupBy(*keys).agg(F.countDistinct(v).alias("n_values"), (F.min(v) == F.max(v)).alias("constant")).where((F.col("n_values") < least) | F.col("constant"))


def median_gate(df: DataFrame, keys: list[str], text: str, least: int = 300) -> DataFrame:
    """(keys, n, median_length) of groups whose texts are shorter than least in the median."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(F.length(text), F.lit(0.5)).alias("median_length")).where(F.col("median_length") < least)


# Mean and deviation of published answer lengths, by regime.
ANSWER_CHARS = {"default": (15.9, 21.8), "chat": (95.6, 69.6)}


def require_answer_length(df: DataFrame, answer: str, regime: str, deviations: float = 1.0) -> float:
    """The mean answer length in characters; an error unless it's within the regime's published band."""
    mean, sd = ANSWER_CHARS[regime]
    found = df.agg(F.avg(F.length(answer))).first()[0]
    if found is None or abs(found - mean) > deviations * sd:
        raise DataQualityError(f"mean answer length {found} is outside {mean} +- {deviations * sd} of {regime!r}")
    return found


def require_verdicts(df: DataFrame, label: str) -> dict[str, int]:
    """How often each verdict occurs; a single one for all rows is an error, as a wrong prompt or parse gives."""
    found = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).collect()}
    if len(found) < 2:
        raise DataQualityError(f"a single verdict for every pair: {found}")
    return found
