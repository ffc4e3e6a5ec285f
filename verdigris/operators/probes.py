"""Linear probes on hidden states: entropy targets, L2 logistic regression, scoring."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions import arrays as A


def train_probe(df: DataFrame, features: str, target: str, c: float = 1.0, max_iter: int = 2000) -> dict:
    """L2 logistic regression with inverse strength c on an array column; a JSON-ready artifact."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(target).cast("double").alias("label"))
    told = data.agg(F.count("*").alias("n"), F.avg("label").alias("rate"), F.countDistinct("label").alias("classes")).first()
    if told["classes"] != 2:
        raise ValueError("a probe needs both classes")
    model = LogisticRegression(regParam=1 / (c * told["n"]), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10).fit(data)
    return {"coef": [float(x) for x in model.coefficients], "intercept": float(model.intercept), "hidden_dim": len(model.coefficients), "train_size": told["n"], "positive_rate": told["rate"], "artifact_schema": 1}


def score_probe(df: DataFrame, probe: dict, features: str, name: str = "probe_uncertainty") -> DataFrame:
    """df with the probe's probability; rows of another width are an error."""
    x = F.col(features).cast("array<double>")
    width = F.when(F.size(x) != probe["hidden_dim"], F.raise_error(F.lit("hidden state has another width than the probe")).cast("double"))
    return df.withColumn(name, F.coalesce(width, A.probe_score(x, F.array(*map(F.lit, probe["coef"])), F.lit(probe["intercept"]))))


def save_probe(probe: dict, path: str) -> None:
    with open(path, "w") as out:
        json.dump(probe, out, sort_keys=True)


def load_probe(path: str) -> dict:
    with open(path) as src:
        return json.load(src)


def feature_available(meta) -> F.Column:
    """Not excluded for a degenerate greedy answer, or filled in afterwards."""
    return ~(F.coalesce(meta["greedy_degenerate_excluded"], F.lit(False)) & meta["feature_backfill"].isNull())
