"""NumPy kernels for what has no built-in: kernel language entropy and seeded bootstrap weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def von_neumann_entropy(kernel: np.ndarray) -> float:
    """Entropy of the eigenvalues of kernel / trace, in nats; tiny ones are floored and then left out."""
    trace = np.trace(kernel)
    values = np.linalg.eigvalsh(kernel / trace if trace > 0 else kernel)
    values = np.maximum(values, 1e-12)
    values = values / values.sum()
    values = values[values > 1e-12]
    return float(-(values * np.log(values)).sum())


def kernel_of(vectors: np.ndarray, kind: str) -> np.ndarray:
    """rbf, exp(-d2 / (2 * scale)) with the median positive squared distance as scale (1 if there's none), or cosine shifted to [0, 1]."""
    if kind == "rbf":
        gram = vectors @ vectors.T
        norm = np.diag(gram)
        d2 = np.maximum(norm[:, None] + norm[None, :] - 2 * gram, 0)
        upper = d2[np.triu_indices(len(vectors), 1)]
        scale = np.median(upper[upper > 0]) if (upper > 0).any() else 1.0
        return np.exp(-d2 / (2 * scale))
    if kind == "cosine":
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = vectors / np.where(length == 0, 1, length)
        return (unit @ unit.T + 1) / 2
    raise ValueError(f"unknown kernel {kind!r}")


def kle(kind: str = "rbf"):
    """A vectorised function: array of vectors -> kernel language entropy (0 for a single answer)."""

    @F.pandas_udf("double")
    def run(matrices: pd.Series) -> pd.Series:
        return matrices.map(lambda m: 0.0 if len(m) < 2 else von_neumann_entropy(kernel_of(np.array([np.asarray(v, float) for v in m]), kind)))

    return run


def weighted_auroc(scores: np.ndarray, positive: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """AUROC of each row of weights (draws x records), ties a half; NaN where a class has no weight."""
    order = np.argsort(scores, kind="stable")
    ranked = scores[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    held = weights[:, order]
    p = np.add.reduceat(held * positive[order], starts, axis=1).astype(float)
    n = np.add.reduceat(held, starts, axis=1) - p
    below = np.cumsum(n, axis=1) - n / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        return (p * below).sum(axis=1) / (p.sum(axis=1) * n.sum(axis=1))
