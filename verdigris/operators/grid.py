"""Grid statistics over cells: unit means, paired differences, seed ranges, leave-one-out, agreement, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit_mean(cells: DataFrame, keys: list[str], value: str, unit: tuple[str, ...] = ("dataset", "model")) -> DataFrame:
    """Mean over units of the mean over the unit's seeds."""
    return cells.groupBy(*keys, *unit).agg(F.avg(value).alias("_m")).groupBy(*keys).agg(F.avg("_m").alias("unit_mean"), F.count("*").alias("n_units"))


def paired_delta(cells: DataFrame, keys: list[str], method: str, left: str, right: str, value: str) -> DataFrame:
    """keys, delta: left minus right where both methods have the cell."""
    wide = cells.groupBy(*keys).pivot(method, [left, right]).agg(F.first(value))
    return wide.where(F.col(f"`{left}`").isNotNull() & F.col(f"`{right}`").isNotNull()).select(*keys, (F.col(f"`{left}`") - F.col(f"`{right}`")).alias("delta"))


def leave_one_out(deltas: DataFrame, factors: list[str], value: str = "delta") -> DataFrame:
    """omitted_factor, omitted, full_delta, retained_delta, change: means without one level of one factor at a time.

    Totals minus the level's part; no join of levels with rows.
    """
    total = deltas.agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    parts = None
    for f in factors:
        one = deltas.groupBy(F.col(f).cast("string").alias("omitted")).agg(F.sum(value).alias("_ps"), F.count(value).alias("_pc")).select(F.lit(f).alias("omitted_factor"), "omitted", "_ps", "_pc")
        parts = one if parts is None else parts.unionByName(one)
    met = parts.join(F.broadcast(total))  # one row
    full, kept = F.col("_s") / F.col("_c"), F.try_divide(F.col("_s") - F.col("_ps"), F.col("_c") - F.col("_pc"))
    return met.select("omitted_factor", "omitted", full.alias("full_delta"), kept.alias("retained_delta"), (kept - full).alias("change"))


def seed_range(cells: DataFrame, keys: list[str], config: list[str], value: str) -> DataFrame:
    """keys, n_configurations, mean_seed_range, max_seed_range over configurations with more than one seed."""
    spans = cells.groupBy(*keys, *config).agg((F.max(value) - F.min(value)).alias("_r"), F.count("*").alias("_c")).where("_c > 1")
    return spans.groupBy(*keys).agg(F.count("*").alias("n_configurations"), F.avg("_r").alias("mean_seed_range"), F.max("_r").alias("max_seed_range"))


def model_and_all_levels(df: DataFrame, keys: list[str], model: str, value: str) -> DataFrame:
    """Means per model and over all of them, in one pass of grouping sets."""
    grouped = df.groupingSets([[*[F.col(k) for k in keys], F.col(model)], [F.col(k) for k in keys]], *[F.col(k) for k in keys], F.col(model))
    return grouped.agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"), F.grouping(model).alias("_g")).select(*keys, F.when(F.col("_g") == 1, "all").otherwise(F.col(model)).alias("level"), "mean_value", "n")


def agreement(left: DataFrame, right: DataFrame, on: list[str], by: list[str], value: str) -> DataFrame:
    """by, n, agreement: share of common rows on which two graders or backends agree."""
    met = left.select(*on, F.col(value).alias("_l")).join(right.select(*on, F.col(value).alias("_r")), on)
    return met.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("_l") == F.col("_r")).cast("double")).alias("agreement"))


def backend_agreement(long: DataFrame, on: list[str], backend: str, value: str) -> DataFrame:
    """left, right, n, agreement for every pair of backends (left < right) on their common rows."""
    a = long.select(*on, F.col(backend).alias("left"), F.col(value).alias("_l"))
    b = long.select(*on, F.col(backend).alias("right"), F.col(value).alias("_r"))
    met = a.join(b, on).where(F.col("left") < F.col("right"))
    return met.groupBy("left", "right").agg(F.count("*").alias("n"), F.avg((F.col("_l") == F.col("_r")).cast("double")).alias("agreement"))


def grid_gaps(observed: DataFrame, factors: dict[str, list]) -> DataFrame:
    """Combinations of the closed factor lists (small literals) that observed lacks."""
    expected = observed.sparkSession.range(1)
    for name, levels in factors.items():
        expected = expected.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    expected = expected.select(*factors)
    return expected.exceptAll(observed.select(*factors).distinct())


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def best_overlap(trees: DataFrame, cells: DataFrame, root: str, cell: str, by: str) -> DataFrame:
    """(by, root, overlap): for each of by the tree that shares the most cells with it; ties to the smaller root."""
    met = trees.select(root, cell).distinct().join(cells.select(by, cell).distinct(), cell)
    found = met.groupBy(by, root).agg(F.count("*").alias("overlap"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.col("overlap").desc(), root))
    return found.withColumn("_k", best).where("_k = 1").select(by, root, "overlap")


def hash_top(df: DataFrame, by: str, key: str, salt: str, k: int) -> DataFrame:
    """The k rows per group of least sha256(salt + key): a selection that no row order changes."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key))
    return df.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def direction(lo, hi):
    """Which side an interval speaks for."""
    return F.when(lo > 0, "left").when(hi < 0, "right").otherwise("neither")
