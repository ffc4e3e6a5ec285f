"""Discrimination and rejection metrics over groups; one exchange per group key, then distinct scores only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auroc(df: DataFrame, keys: list[str], positive: str, score: str, weight: str | None = None) -> DataFrame:
    """keys, auroc: P(score of a positive > score of a negative), ties a half; null where a class is missing.

    Rows are first summed by distinct score with map-side combine, so only distinct scores cross the window.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pos = F.col(positive).cast("double") * w
    by_score = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(pos).alias("_p"), F.sum(w - pos).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    ranked = by_score.withColumn("_c", below)
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_p") * (F.col("_c") - F.col("_n") / 2)), F.sum("_p") * F.sum("_n")).alias("auroc"))


def auroc_by_ranks(df: DataFrame, keys: list[str], positive: str, score: str) -> DataFrame:
    """The same from average ranks of all rows."""
    group = Window.partitionBy(*keys)
    rank = F.rank().over(group.orderBy(score)) + (F.count("*").over(Window.partitionBy(*keys, score)) - 1) / 2
    p = F.sum(F.col(positive).cast("double"))
    n = F.count("*") - p
    return df.withColumn("_r", rank).groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col(positive), F.col("_r"))) - p * (p + 1) / 2, p * n).alias("auroc"))


def rejection_curve(df: DataFrame, keys: list[str], correct: str, score: str, order: list[str]) -> DataFrame:
    """keys, rejected, retained, coverage, rejection_fraction, accuracy: the most uncertain rows go first, ties by order."""
    accuracy, retained = kept_accuracy(keys, correct, score, order)
    n = F.count("*").over(Window.partitionBy(*keys))
    curve = df.select(*keys, (n - retained).alias("rejected"), retained.alias("retained"), accuracy.alias("accuracy"), n.alias("_n"))
    return curve.select(*keys, F.col("rejected").cast("long").alias("rejected"), F.col("retained").cast("long").alias("retained"), (F.col("retained") / F.col("_n")).alias("coverage"), (F.col("rejected") / F.col("_n")).alias("rejection_fraction"), "accuracy")


def kept_accuracy(keys: list[str], correct: str, score: str, order: list[str]) -> tuple[Column, Column]:
    """(accuracy, number) of the rows left once all that are more uncertain are gone, this one kept.

    The rows are met from the last one rejected: a running mean, where a frame up to the group's end would be added up
    anew for every row.
    """
    by = Window.partitionBy(*keys).orderBy(F.col(score).asc_nulls_first(), *[F.col(o).desc_nulls_last() for o in order])
    return F.avg(F.col(correct).cast("double")).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(by)


def aurac_step(df: DataFrame, keys: list[str], correct: str, score: str, order: list[str]) -> DataFrame:
    """Mean retained accuracy over all coverages."""
    return rejection_curve(df, keys, correct, score, order).groupBy(*keys).agg(F.avg("accuracy").alias("aurac"))


def aurac_quantiles(df: DataFrame, keys: list[str], correct: str, score: str, quantiles: int = 20, lowest: float = 0.1) -> DataFrame:
    """Accuracy of rows at or below each of the score's quantiles from lowest to 1, left Riemann sum, not normalised."""
    qs = [lowest + (1 - lowest) * i / (quantiles - 1) for i in range(quantiles)]
    # The cuts of a group are twenty numbers beside each of its rows: conditional sums in the window's own exchange.
    cut = df.withColumn("_cuts", F.percentile(score, F.array(*[F.lit(q) for q in qs])).over(Window.partitionBy(*keys)))
    return cut.groupBy(*keys).agg(below_cuts(correct, score, quantiles, lowest).alias("aurac_paper"))


def below_cuts(correct: str, score: str, quantiles: int, lowest: float) -> Column:
    """The Riemann sum over rows at or below each of _cuts, as one aggregate."""
    parts = [F.avg(F.when(F.col(score) <= F.get("_cuts", i), F.col(correct).cast("double"))) for i in range(quantiles)]
    return sum(parts[1:], parts[0]) * F.lit((1 - lowest) / (quantiles - 1))


def aurac_prefix(df: DataFrame, keys: list[str], correct: str, score: str, order: list[str], quantiles: int = 20, lowest: float = 0.1) -> DataFrame:
    """keys, aurac_paper, aurac_mean_retained: prefixes of max(1, round-half-even(q * n)) rows by rising score."""
    by = Window.partitionBy(*keys).orderBy(score, *order)
    rows = df.select(*keys, F.row_number().over(by).alias("_k"), F.avg(F.col(correct).cast("double")).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_a"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    qs = [lowest + (1 - lowest) * i / (quantiles - 1) for i in range(quantiles)]
    hits = sum((F.when(F.col("_k") == F.greatest(F.lit(1), F.bround(F.lit(q) * F.col("_n")).cast("int")), 1).otherwise(0) for q in qs), F.lit(0))
    return rows.withColumn("_h", hits).groupBy(*keys).agg((F.sum(F.col("_h") * F.col("_a")) * F.lit((1 - lowest) / (quantiles - 1))).alias("aurac_paper"), F.avg("_a").alias("aurac_mean_retained"))


def best_split_threshold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, threshold: the midpoint of neighbouring distinct values with least squared error within the two sides; ties lower."""
    by = Window.partitionBy(*keys).orderBy("_v")
    group = Window.partitionBy(*keys)
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    distinct = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").cast("double").alias("_n"))
    s1, s2 = F.col("_n") * F.col("_v"), F.col("_n") * F.col("_v") * F.col("_v")
    told = distinct.select(*keys, "_v", F.lead("_v").over(by).alias("_next"), *[F.sum(x).over(w).alias(f"_{name}{side}") for name, x in (("c", F.col("_n")), ("s", s1), ("q", s2)) for side, w in (("l", run), ("t", group))])
    part = lambda c, s, q: q - s * s / c
    sse = part(F.col("_cl"), F.col("_sl"), F.col("_ql")) + part(F.col("_ct") - F.col("_cl"), F.col("_st") - F.col("_sl"), F.col("_qt") - F.col("_ql"))
    mid = (F.col("_v") + F.col("_next")) / 2
    return told.where("_next is not null").groupBy(*keys).agg(F.min_by(mid, F.struct(F.round(sse, 9), mid)).alias("threshold"))


def metric_summary(long: DataFrame, keys: list[str], correct: str = "correct", score: str = "score", order: list[str] = ()) -> DataFrame:
    """One row per group: n, accuracy, auroc of being incorrect, and the areas under rejection curves.

    The rows are dealt by group once and read once: average ranks, retained accuracies and quantiles are windows over the
    same exchange.
    """
    quantiles, lowest = 20, 0.1
    group, c = Window.partitionBy(*keys), F.col(correct).cast("double")
    rank = F.rank().over(group.orderBy(score)) + (F.count("*").over(Window.partitionBy(*keys, score)) - 1) / 2
    kept, _ = kept_accuracy(keys, correct, score, order)
    cuts = F.percentile(score, F.array(*[F.lit(lowest + (1 - lowest) * i / (quantiles - 1)) for i in range(quantiles)])).over(group)
    dealt = long.select(*dict.fromkeys([*keys, correct, score, *order])).repartition(*keys)
    told = dealt.withColumns({"_rank": rank, "_kept": kept, "_cuts": cuts})
    bad = F.sum(1 - c)
    area = F.try_divide(F.sum(F.when(~F.col(correct), F.col("_rank"))) - bad * (bad + 1) / 2, bad * F.sum(c))
    return told.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(c).alias("accuracy"), area.alias("auroc"), F.avg("_kept").alias("aurac"), below_cuts(correct, score, quantiles, lowest).alias("aurac_paper"))


def truncation_rate(truncated: Column, total: Column) -> Column:
    return F.try_divide(F.sum(truncated), F.sum(total))


def score_pairs(records: DataFrame, keys: list[str], field: str, excluded: Column | None = None) -> DataFrame:
    """keys, correct, score of the records that carry a score; without one only those that declare an exclusion are left out.

    Any other missing score, and one that isn't finite, is an error, so none is ever dropped unseen.
    """
    score = F.try_element_at("scores", F.lit(field)).cast("double")
    known = ~F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(True)
    missing = F.raise_error(F.concat(F.lit("record "), F.coalesce(F.col(keys[-1]).cast("string"), F.lit("<unknown>")), F.lit(f" is missing scores.{field}"))).cast("double")
    odd = F.raise_error(F.lit(f"scores.{field} must be finite")).cast("double")
    told = records.withColumns({"_score": score, "_known": known}).where(F.col("_known") | F.col("_score").isNotNull())
    value = F.when(F.col("_score").isNull(), missing).when(F.isnan("_score") | (F.abs("_score") == float("inf")), odd).otherwise(F.col("_score"))
    return told.select(*keys, F.col("correctness_label").alias("correct"), value.alias("score"))


def score_coverage(records: DataFrame, keys: list[str], fields: list[str], excluded: Column) -> DataFrame:
    """keys, score_field, scored, degenerate_greedy_excluded."""
    long = records.select(*keys, excluded.alias("_x"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.try_element_at("scores", F.lit(f)).isNotNull().alias("has")) for f in fields])).alias("_t"))
    return long.groupBy(*keys, F.col("_t.f").alias("score_field")).agg(F.count_if("_t.has").alias("scored"), F.count_if(~F.col("_t.has") & F.coalesce("_x", F.lit(False))).alias("degenerate_greedy_excluded"))


def cell_measurements(long: DataFrame, keys: list[str], order: list[str], correct: str = "correct", score: str = "score", chars: str = "chars") -> DataFrame:
    """keys, n_records, mean_answer_chars, accuracy, auroc, aurac_paper, aurac_mean_retained: one row a cell and method."""
    base = long.groupBy(*keys).agg(F.count("*").alias("n_records"), F.avg(chars).alias("mean_answer_chars"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return base.join(auroc(long.withColumn("_bad", ~F.col(correct)), keys, "_bad", score), keys).join(aurac_prefix(long, keys, correct, score, order), keys)


def length_diagnostics(rows: DataFrame, keys: list[str], incorrect: str, graded: str, sampled: str, cap: str, scores: list[str]) -> DataFrame:
    """keys, records, means and median of lengths, records with cap counts, and the AUROC of lengths and scores in each stratum.

    Strata: all; shorter (graded length at or below the cell's median) and longer; no_cap (no sample met the token limit)
    and any_cap, among records that know. (stratum, measure, auroc) come as a map per cell, so that cells stay one row.
    """
    mid = rows.groupBy(*keys).agg(F.percentile(graded, F.lit(0.5)).alias("_mid"))
    told = rows.join(mid, keys)
    strata = F.filter(F.array(F.lit("all"), F.when(F.col(graded) <= F.col("_mid"), "shorter").otherwise("longer"), F.when(F.col(cap) == 0, "no_cap").when(F.col(cap) > 0, "any_cap")), lambda x: x.isNotNull())
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in (graded, sampled, *scores)])
    long = told.select(*keys, F.col(incorrect).alias("_bad"), F.explode(strata).alias("stratum"), measures.alias("_m")).select(*keys, "_bad", "stratum", F.explode("_m").alias("_m")).select(*keys, "_bad", "stratum", "_m.*")
    found = auroc(long, [*keys, "stratum", "measure"], "_bad", "value")
    by_cell = found.where("auroc is not null").groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "stratum", "measure").alias("k"), F.col("auroc").alias("v"))))).alias("aurocs"))
    base = told.groupBy(*keys).agg(
        F.count("*").alias("records"), F.avg(graded).alias("graded_mean"), F.avg(sampled).alias("sampled_mean"), F.first("_mid").alias("graded_median"),
        F.count(cap).alias("cap_records"), F.avg(F.when(F.col(cap).isNotNull(), (F.col(cap) > 0).cast("double"))).alias("any_cap_share"),
    )
    return base.join(by_cell, keys, "left")


def flips(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, n, agreement, to_true, to_false: how a second grader's labels differ from the first's."""
    a, b = F.col(before), F.col(after)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("agreement"), F.count_if(~a & b).alias("to_true"), F.count_if(a & ~b).alias("to_false"))
