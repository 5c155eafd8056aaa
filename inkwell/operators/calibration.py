"""Logistic fits: a reader's verdicts by plain gradient descent, and large tables by Newton steps over sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Newest verdicts that a calibration reads; fewer than the least, or of one kind only, give none.
VERDICTS, LEAST = 5000, 50
SHIFT = 0.05


def descent(x: np.ndarray, y: np.ndarray, iterations: int = 400, rate: float = 0.5, ridge: float = 0.001) -> np.ndarray:
    """Weights, the bias first, by full-batch gradient descent on the mean log loss; the bias has no ridge."""
    full = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(full.shape[1])
    keep = np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(iterations):
        w = w - rate * (full.T @ (1 / (1 + np.exp(-(full @ w))) - y) / len(y) + keep * w)
    return w


def calibrated(verdicts: DataFrame, features: list[str], label: str, at: str) -> np.ndarray | None:
    """Weights fitted to the newest VERDICTS of a reader, a bounded sample by a documented parameter; None without both kinds or LEAST of them."""
    rows = verdicts.select(at, *features, label).orderBy(F.desc(at), *features).limit(VERDICTS).collect()
    y = np.array([float(r[label]) for r in rows])
    if len(rows) < LEAST or y.min() == y.max():
        return None
    return descent(np.array([[float(r[f]) for f in features] for r in rows]), y)


def shifted(base: float, weights: np.ndarray, features: list[str]):
    """The cutoff of a pair: the base moved by SHIFT at most, down where the verdicts call pairs like it one event."""
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features, strict=True):
        z = z + float(w) * F.col(f)
    return F.lit(base) - SHIFT * (2 / (1 + F.exp(-z)) - 1)


def newton(df: DataFrame, features: list[str], label: str, ridge: float = 1.0, steps: int = 25, close: float = 1e-9) -> np.ndarray:
    """Weights, the bias first, of an L2 logistic regression over a whole table.

    Each step is one aggregation of the gradient's and the Hessian's sums, so the rows stay where they are; the driver solves a
    system of the number of features. Raises if it has not settled after ``steps``.
    """
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    n = len(x)
    w = np.zeros(n)
    keep = np.r_[0.0, np.full(n - 1, ridge)]
    for _ in range(steps):
        z = sum((float(w[i]) * x[i] for i in range(n)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        sums = [F.sum((p - F.col(label).cast("double")) * x[i]).alias(f"g{i}") for i in range(n)]
        sums += [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]
        got = df.agg(*sums).first()
        gradient = np.array([got[f"g{i}"] or 0.0 for i in range(n)]) + keep * w
        hessian = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)]) + np.diag(keep + 1e-12)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < close:
            return w
    raise RuntimeError(f"the fit is not settled after {steps} steps")


def threshold_for(df: DataFrame, weights: np.ndarray, features: list[str]) -> DataFrame:
    """``df`` with ``probability`` under the weights."""
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features, strict=True):
        z = z + float(w) * F.col(f).cast("double")
    return df.withColumn("probability", 1 / (1 + F.exp(-z)))
