"""Ridge regression for every group at once, solved in the engine.

A group becomes one row of moment sums (partial sums first, so a group may be any size). The normal
equations of all groups are then factorised side by side: Cholesky's columns, forward and back
substitution are expressions over those sums, a stage for each feature.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ridge_by(rows: DataFrame, by: list[str], names: list[str], label: str, penalty: float = 1.0) -> DataFrame:
    """(by, n, a coefficient for each name, intercept); the intercept isn't penalised.

    Rows that lack a feature or the label don't count. A feature that the others determine (only
    without penalty) gets 0. Null keys are a group.
    """
    p = len(names)
    known = rows.dropna(subset=[*names, label])
    x = [*(F.col(n).cast("double") for n in names), F.lit(1.0)]
    sums = {f"_a{i}_{j}": F.sum(x[i] * x[j]) for i in range(p + 1) for j in range(i + 1)} | {f"_b{i}": F.sum(x[i] * F.col(label).cast("double")) for i in range(p + 1)}
    held = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(s.alias(c) for c, s in sums.items()))
    held = held.withColumns({f"_a{i}_{i}": F.col(f"_a{i}_{i}") + float(penalty) for i in range(p)})
    total = lambda terms: reduce(add, terms) if terms else F.lit(0.0)
    share = lambda above, below: F.when(below > 0, above / below).otherwise(0.0)
    c: dict[tuple[int, int], Column] = {(i, j): F.col(f"_l{i}_{j}") for i in range(p + 1) for j in range(i + 1)}
    for j in range(p + 1):
        rest = F.col(f"_a{j}_{j}") - total([c[j, k] * c[j, k] for k in range(j)])
        # a pivot that is nothing but rounding counts as none
        held = held.withColumn(f"_l{j}_{j}", F.when(rest > F.abs(F.col(f"_a{j}_{j}")) * 1e-12, F.sqrt(rest)).otherwise(0.0))
        held = held.withColumns({f"_l{i}_{j}": share(F.col(f"_a{i}_{j}") - total([c[i, k] * c[j, k] for k in range(j)]), c[j, j]) for i in range(j + 1, p + 1)})
    for i in range(p + 1):
        held = held.withColumn(f"_z{i}", share(F.col(f"_b{i}") - total([c[i, k] * F.col(f"_z{k}") for k in range(i)]), c[i, i]))
    for i in reversed(range(p + 1)):
        held = held.withColumn(f"_x{i}", share(F.col(f"_z{i}") - total([c[k, i] * F.col(f"_x{k}") for k in range(i + 1, p + 1)]), c[i, i]))
    return held.select(*by, "n", *(F.col(f"_x{i}").alias(n) for i, n in enumerate(names)), F.col(f"_x{p}").alias("intercept"))


def weights(fitted: DataFrame, by: list[str], names: list[str], prefix: str = "weight_") -> DataFrame:
    """``fitted`` with a weight for each name: negative coefficients count as 0, the rest sums to 1 (or all are 0)."""
    cut = [F.greatest(F.col(n), F.lit(0.0)) for n in names]
    every = reduce(add, cut)
    return fitted.withColumns({f"{prefix}{n}": F.when(every > 0, x / every).otherwise(0.0) for n, x in zip(names, cut, strict=True)})
