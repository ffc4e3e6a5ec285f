"""Report tables over a grid of cells: unit means side by side, gaps with their intervals, lookups that must be total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import bootstrap, grid

UNIT = ("dataset", "model")


def units(cells: DataFrame, keys: list[str], value: str, unit: tuple[str, ...] = UNIT) -> DataFrame:
    """One row per key and unit: the mean over the unit's seeds, in a column named like value."""
    return cells.groupBy(*dict.fromkeys([*keys, *unit])).agg(F.avg(value).alias(value))


def side_by_side(cells: DataFrame, keys: list[str], column: str, levels: list[str], value: str, unit: tuple[str, ...] = UNIT) -> DataFrame:
    """keys and one column per level: the unit mean there; null where no cell has both. Levels are given, so no extra pass lists them."""
    return units(cells, [*keys, column], value, unit).groupBy(*keys).pivot(column, levels).agg(F.avg(value))


def paired_units(cells: DataFrame, keys: list[str], method: str, left: str, right: str, value: str, unit: tuple[str, ...] = UNIT) -> DataFrame:
    """keys, unit, _l, _r: the units' means of two methods over the cells that have both."""
    cell = list(dict.fromkeys([*keys, *unit, "seed"]))
    wide = cells.groupBy(*cell).pivot(method, [left, right]).agg(F.first(value)).where(F.col(f"`{left}`").isNotNull() & F.col(f"`{right}`").isNotNull())
    return wide.groupBy(*dict.fromkeys([*keys, *unit])).agg(F.avg(f"`{left}`").alias("_l"), F.avg(f"`{right}`").alias("_r"))


def gap_table(cells: DataFrame, keys: list[str], method: str, left: str, right: str, value: str, unit: tuple[str, ...] = UNIT) -> DataFrame:
    """keys, left_mean, right_mean, gap, lo, hi, n_units: two methods on the cells that have both.

    lo and hi are the 2.5 and 97.5 percentiles of the units' own gaps; bootstrap.bootstrap_units gives those of their mean.
    """
    per_unit = paired_units(cells, keys, method, left, right, value, unit)
    gap = F.col("_l") - F.col("_r")
    return per_unit.groupBy(*keys).agg(
        F.avg("_l").alias("left_mean"), F.avg("_r").alias("right_mean"), F.avg(gap).alias("gap"),
        F.percentile(gap, F.lit(0.025)).alias("lo"), F.percentile(gap, F.lit(0.975)).alias("hi"), F.count("*").alias("n_units"),
    )


def gap_intervals(cells: DataFrame, keys: list[str], method: str, left: str, right: str, value: str, unit: tuple[str, ...] = UNIT) -> DataFrame:
    """keys, left_mean, right_mean, gap, n_units, lo, hi: gap_table with the bootstrap interval of the mean gap over units drawn with replacement."""
    per_unit = paired_units(cells, keys, method, left, right, value, unit)
    gaps = per_unit.select(*keys, F.concat_ws("/", *unit).alias("unit"), (F.col("_l") - F.col("_r")).alias("delta"))
    ci = bootstrap.bootstrap_units(gaps, keys, "delta").select(*keys, F.col("lower").alias("lo"), F.col("upper").alias("hi"))
    means = per_unit.groupBy(*keys).agg(F.avg("_l").alias("left_mean"), F.avg("_r").alias("right_mean"), F.avg(F.col("_l") - F.col("_r")).alias("gap"), F.count("*").alias("n_units"))
    return means.join(ci, keys)


def own_backend(cells: DataFrame, own: dict[str, str], backend: str, method: str = "method") -> DataFrame:
    """The cells of each method on the one backend that it reports on."""
    lookup = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return cells.where(F.col(backend) == lookup[F.col(method)])


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """left with values of right and n_matches; the values are null unless exactly one row of right has the key."""
    found = right.groupBy(*keys).agg(F.count("*").alias("n_matches"), *[F.first(v).alias(v) for v in values])
    met = left.join(found, keys, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return met.withColumns({v: F.when(F.col("n_matches") == 1, F.col(v)) for v in values})


def seed_noise(cells: DataFrame, keys: list[str], slices: list[str], value: str) -> DataFrame:
    """keys, mean_range, max_range: the mean of the slices' mean seed ranges and the largest range of all."""
    spans = grid.seed_range(cells, [*keys, *slices], [u for u in UNIT if u not in slices], value)
    return spans.groupBy(*keys).agg(F.avg("mean_seed_range").alias("mean_range"), F.max("max_seed_range").alias("max_range"))
