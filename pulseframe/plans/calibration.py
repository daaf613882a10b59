"""Calibration: weights of the sub-scores from how days felt, and drift of the reference."""

from __future__ import annotations

import json
import os
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regression

FEATURES = ("hrv", "sleeping_hr", "sleep", "resp", "temp", "hrv_cv")


def read_days(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """date and numbers of a CSV; blanks are null."""
    return spark.read.option("header", True).csv(path).select(F.to_date("date").alias("date"), *(F.col(c).cast("double").alias(c) for c in columns))


def aligned(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Days that have all features and a label."""
    return features.join(labels, "date").dropna(subset=[*names, "perceived_readiness"]).dropDuplicates(["date"])


def ridge(days: DataFrame, names: list[str], label: str, penalty: float) -> np.ndarray:
    """Coefficients and intercept, which isn't penalised. One aggregate of (p + 1)(p + 3) / 2 sums reaches the driver."""
    columns = [F.col(n) for n in names] + [F.lit(1.0)]
    sums = [F.sum(a * b) for i, a in enumerate(columns) for b in columns[i:]] + [F.sum(a * F.col(label)) for a in columns]
    row = list(days.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first())
    p = len(columns)
    left = np.zeros((p, p))
    left[np.triu_indices(p)] = row[: -p]
    left = left + np.triu(left, 1).T
    left[range(p - 1), range(p - 1)] += penalty
    return np.linalg.lstsq(left, np.array(row[-p:], dtype=float), rcond=1e-12)[0]


def fit(features: DataFrame, labels: DataFrame, penalty: float = 1.0) -> dict:
    """Suggested weights (negative coefficients count as 0, the rest sums to 1) and correlations."""
    names = [n for n in FEATURES if n in features.columns]
    days = aligned(features, labels, names)
    n = days.count()
    out: dict = {"n_days": n, "features": names, "correlations": {}, "suggested_weights": {}, "coefficients": {}}
    if n < max(3, len(names) + 1):
        return out | {"note": "too few days have all values"}
    found = ridge(days, names, "perceived_readiness", penalty)[:-1]
    cut = np.maximum(found, 0)
    r = days.agg(*(F.corr(c, "perceived_readiness").alias(c) for c in names)).first()
    for name, coefficient, weight in zip(names, found, cut / (cut.sum() or 1.0), strict=True):
        out["coefficients"][name] = round(float(coefficient), 4)
        out["suggested_weights"][name] = round(float(weight), 3)
        out["correlations"][name] = None if r[name] is None or r[name] != r[name] else round(r[name], 3)
    return out


def fit_by(days: DataFrame, by: list[str], names: list[str], label: str = "perceived_readiness", penalty: float = 1.0) -> DataFrame:
    """``fit`` for each athlete: (by, n, coefficients, intercept, weight_ and r_ of each name), of those with enough days."""
    known = days.dropna(subset=[*names, label])
    fitted = regression.weights(regression.ridge_by(known, by, names, label, penalty), by, names)
    alike = lambda n: F.try_divide(F.covar_samp(n, label), F.nullif(F.stddev_samp(n) * F.stddev_samp(label), F.lit(0.0)))  # noqa: E731  null where either is constant
    felt = known.groupBy(*by).agg(*(alike(n).alias(f"r_{n}") for n in names))
    same = reduce(and_, [fitted[c].eqNullSafe(felt[c]) for c in by])
    return fitted.join(felt, same).drop(*(felt[c] for c in by)).filter(F.col("n") >= max(3, len(names) + 1))


def agreement(records: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """(by, r, n): Pearson's correlation of two metrics' daily means, over days that have both."""
    own = records.filter(F.col("type").isin(first, second)).groupBy(*by, F.to_date("start_ts").alias("d"))
    days = own.agg(*(F.avg(F.when(F.col("type") == m, F.col("value"))).alias(c) for c, m in (("a", first), ("b", second)))).filter("a IS NOT NULL AND b IS NOT NULL")
    return days.groupBy(*by).agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n"))


def reference_stats(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, spread, robust spread and smallest worthwhile change of log HRV over the whole history."""
    by = by or []
    logs = history.filter("hrv > 0").select(*by, F.log("hrv").alias("x"))
    middle = logs.groupBy(*by).agg(F.percentile("x", F.lit(0.5)).alias("m"))
    away = logs.join(middle, by) if by else logs.crossJoin(F.broadcast(middle))  # one row
    return away.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 5).alias("hrv_ln_mean"), F.round(F.stddev_samp("x"), 5).alias("hrv_ln_sd"),
        F.round(1.4826 * F.percentile(F.abs(F.col("x") - F.col("m")), F.lit(0.5)), 5).alias("hrv_ln_mad_scale"),
        F.round(0.5 * F.stddev_samp("x"), 5).alias("hrv_swc_edge"), F.round(F.first("m"), 5).alias("hrv_ln_median"),
    ).filter("n >= 2")


CHECKED = ("hrv_ln_mean", "hrv_ln_sd", "hrv_ln_mad_scale", "hrv_swc_edge")


def drift(history: DataFrame, reference: str, tolerance: float = 0.1) -> dict:
    """Relative drift of each figure against the stored reference, which is written if there is none."""
    row = reference_stats(history).first()
    if row is None:
        return {"state": "too little history", "drift": {}}
    current = {k: row[k] for k in ("n", *CHECKED)}
    if not os.path.exists(reference):
        with open(reference, "w", encoding="utf-8") as file:
            json.dump(current, file, indent=2)
        return {"state": "reference written", "drift": {}}
    with open(reference, encoding="utf-8") as file:
        stored = json.load(file)
    moved = {k: abs(current[k] - stored[k]) / abs(stored[k]) for k in CHECKED if stored.get(k) and current[k] is not None}
    return {"state": "drifted" if any(v > tolerance for v in moved.values()) else "within tolerance", "drift": moved}
