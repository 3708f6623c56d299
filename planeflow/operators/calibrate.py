"""Calibration of the cost model by least squares over timing tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(frame: DataFrame, terms: list[str], target: str):
    """The sums that normal equations need, in one aggregation."""
    cols = ["_one", *terms, target]
    data = frame.withColumn("_one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = data.agg(*(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs))).first()
    m = np.zeros((len(cols), len(cols)))
    for i, (a, b) in enumerate(pairs):
        m[cols.index(a), cols.index(b)] = m[cols.index(b), cols.index(a)] = row[f"s{i}"] or 0.0
    return m


def fit(frame: DataFrame, terms: list[str], target: str) -> dict:
    """Coefficients (the first is the constant), R squared and the number of rows."""
    m = moments(frame, terms, target)
    k = len(terms) + 1
    weights = np.linalg.lstsq(m[:k, :k], m[:k, k], rcond=None)[0]
    n, total = m[0, 0], m[k, k] - m[0, k] ** 2 / max(m[0, 0], 1)
    rest = m[k, k] - 2 * weights @ m[:k, k] + weights @ m[:k, :k] @ weights
    return {"weights": weights.tolist(), "r2": 1 - rest / total if total > 0 else 1.0, "rows": int(n)}


def residuals(frame: DataFrame, terms: list[str], target: str, weights: list[float], order: str) -> DataFrame:
    """The largest absolute residual and its row."""
    model = sum((F.col(t) * w for t, w in zip(terms, weights[1:], strict=True)), F.lit(weights[0]))
    miss = F.abs(F.col(target) - model)
    return frame.agg(F.max(miss).alias("worst"), F.max_by(F.col(order), F.struct(miss, -F.col(order))).alias("at"))


def measured(timing: DataFrame, stats: DataFrame) -> DataFrame:
    """Timing rows with their delta's statistics; packets that were not measured have 0 and drop out."""
    return timing.filter("cck > 0").join(stats, "n").withColumn("cycles", F.col("cck") * 2)
