"""Bootstrap intervals: units, paired hierarchical schemes and question-linked schemes, as weights instead of resampled rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.kernels import weighted_auroc
from verdigris.operators.quality import DataQualityError

DRAWS, SEED, BLOCK = 2000, 20260831, 100


def rng_of(*key: object) -> np.random.Generator:
    """A generator that depends on the key alone, so that any task draws the same."""
    import zlib

    return np.random.default_rng([zlib.crc32(repr(k).encode()) for k in key])


def interval(draws: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """keys, lower, upper (2.5 and 97.5 %), p (two-sided, capped at 1), finite_draws."""
    v = F.col(value)
    share = lambda cond: F.avg(F.when(v.isNotNull(), cond.cast("double")))
    p = F.least(F.lit(1.0), 2 * F.least(share(v <= 0), share(v >= 0)))
    return draws.groupBy(*keys).agg(F.percentile(value, F.lit(0.025)).alias("lower"), F.percentile(value, F.lit(0.975)).alias("upper"), p.alias("p"), F.count(value).alias("finite_draws"))


def bootstrap_units(units: DataFrame, keys: list[str], value: str, unit: str = "unit", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Percentile interval of the mean over units drawn with replacement; units of a slice are few."""
    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.select(*keys).schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(unit)
        values = pdf[value].to_numpy(float)
        rng = rng_of(seed, *pdf[keys].iloc[0].tolist())
        means = values[rng.integers(0, len(values), (draws, len(values)))].mean(axis=1)
        lo, hi = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([[*pdf[keys].iloc[0], len(values), values.mean(), lo, hi]], columns=[*keys, "n_units", "mean", "lower", "upper"])

    return units.select(*keys, unit, value).groupBy(*keys).applyInPandas(run, f"{spec}, n_units long, mean double, lower double, upper double")


#: Weights (draws times records) that a task holds at a time.
HELD = 1 << 23


def same_questions(records: DataFrame, keys: list[str]) -> None:
    """An error unless all cells of a dataset hold the same questions, each once."""
    h = F.xxhash64(F.col("qid").cast("string"))
    told = records.groupBy(*keys, "dataset", "model", "seed").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("d"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31)).cast("decimal(38,0)")).alias("y"))
    bad = told.groupBy(*keys, "dataset").agg(F.countDistinct("n", "x", "y").alias("k"), F.max(F.col("n") - F.col("d")).alias("repeated")).where("k > 1 or repeated > 0").limit(3).collect()
    if bad:
        raise DataQualityError(f"cells of a dataset hold different questions: {[r.asDict() for r in bad]}")


def paired_draws(records: DataFrame, keys: list[str], left: str, right: str, scheme: str, draws: int = DRAWS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """keys, draw, delta: AUROC(left) - AUROC(right), averaged over seeds and then units, in each draw."""
    cells = cell_draws(records, keys, left, right, scheme, draws, seed, block)
    units = cells.groupBy(*keys, "draw", "slot", "dataset", "model").agg(F.avg("delta").alias("delta"), F.max("weight").alias("weight"))
    known = F.when(F.col("delta").isNotNull(), F.col("weight"))
    return units.groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("delta") * F.col("weight")), F.sum(known)).alias("delta"))


def omissions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys and how much of the draws was undefined: shares of cell draws, of draws with any, and of draws without any
    defined unit, and the mean weight of defined units."""
    w, bad = F.col("weight"), F.col("delta").isNull()
    units = cells.groupBy(*keys, "draw", "slot", "dataset", "model").agg(F.sum(w).alias("all"), F.sum(F.when(bad, w).otherwise(0.0)).alias("bad"), F.max(w).alias("w"), F.max(~bad).alias("known"))
    per_draw = units.groupBy(*keys, "draw").agg(F.sum("all").alias("all"), F.sum("bad").alias("bad"), F.sum(F.when(F.col("known"), F.col("w")).otherwise(0.0)).alias("valid"))
    return per_draw.groupBy(*keys).agg(
        F.try_divide(F.sum("bad"), F.sum("all")).alias("invalid_cell_fraction"), F.avg((F.col("bad") > 0).cast("double")).alias("any_invalid_cell_draw_fraction"),
        F.avg((F.col("valid") == 0).cast("double")).alias("undefined_draw_fraction"), F.avg("valid").alias("mean_valid_unit_weight"),
    )


def cell_draws(records: DataFrame, keys: list[str], left: str, right: str, scheme: str, draws: int = DRAWS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """keys, dataset, model, seed, draw, slot, weight, delta of every cell in every draw.

    records has dataset, model, seed, qid, incorrect and the two scores. Schemes: records (records drawn within cells,
    units fixed), units (units drawn, records fixed), hier (units drawn, and the records of each drawn slot anew, so that
    a unit drawn twice has two draws of records), linked (questions drawn once per dataset, for all its cells, which must
    hold the same ones), crossed (linked, and each unit weighted by drawn datasets times drawn models).

    A cell is exchanged once per block of draws and answers it as weight matrices of bounded size; cells meet again
    only as one number per draw and slot.
    """
    if scheme not in ("records", "units", "hier", "linked", "crossed"):
        raise ValueError(f"unknown scheme {scheme!r}")
    if scheme in ("linked", "crossed"):
        same_questions(records, keys)
    cell = [*keys, "dataset", "model", "seed"]
    n_blocks = -(-draws // block)
    types = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    spec = ", ".join(f"{k} {types[k]}" for k in cell)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("qid")
        first = pdf.iloc[0]
        b, n = int(first["block"]), len(pdf)
        size = min(block, draws - b * block)
        head = [first[k] for k in keys]
        datasets, models = list(first["_datasets"]), list(first["_models"])
        unit, n_units = int(first["_unit"]), int(first["_units"])
        draw, slot, weight = np.arange(size), np.zeros(size, int), np.ones(size)
        if scheme in ("units", "hier"):
            drawn = rng_of(seed, "units", b, *head).integers(0, n_units, (size, n_units))
            draw, slot = np.nonzero(drawn == unit)
            weight = np.ones(len(draw))
        if scheme == "crossed":
            rng = rng_of(seed, "factors", b, *head)
            of = lambda levels: rng.multinomial(len(levels), np.full(len(levels), 1 / len(levels)), size)
            by_dataset, by_model = of(datasets), of(models)
            weight = (by_dataset[:, datasets.index(first["dataset"])] * by_model[:, models.index(first["model"])]).astype(float)
        own = {"records": cell, "hier": cell, "linked": ["dataset"], "crossed": ["dataset"]}.get(scheme)
        rng = rng_of(seed, scheme if scheme == "hier" else "records", b, *[first[k] for k in own or ()])
        bad, scores = pdf["incorrect"].to_numpy(bool), [pdf[x].to_numpy(float) for x in (left, right)]

        def delta(weights: np.ndarray) -> np.ndarray:
            return weighted_auroc(scores[0], bad, weights) - weighted_auroc(scores[1], bad, weights)

        step = max(1, HELD // n)
        if own is None:
            found = np.broadcast_to(delta(np.ones((1, n))), len(draw))
        else:
            found = np.concatenate([np.empty(0), *(delta(rng.multinomial(n, np.full(n, 1 / n), min(step, len(draw) - at))) for at in range(0, len(draw), step))])
        out = pd.DataFrame({k: [first[k]] * len(draw) for k in cell})
        return out.assign(draw=b * block + draw, slot=slot, weight=weight, delta=found)

    # Units, datasets and models of a slice are few: lists beside each of its cells.
    told = records.groupBy(*keys).agg(*[F.array_sort(F.collect_set(x)).alias(y) for x, y in ((F.struct("dataset", "model"), "_pairs"), (F.col("dataset"), "_datasets"), (F.col("model"), "_models"))])
    spread = records.select(*cell, "qid", "incorrect", left, right).join(F.broadcast(told), keys)
    spread = spread.withColumns({"_unit": F.array_position("_pairs", F.struct("dataset", "model")) - 1, "_units": F.size("_pairs")}).drop("_pairs")
    spread = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return spread.groupBy(*cell, "block").applyInPandas(run, f"{spec}, draw long, slot long, weight double, delta double").withColumn("delta", F.when(~F.isnan("delta"), F.col("delta")))
