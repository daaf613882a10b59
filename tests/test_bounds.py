"""Regression for every group at once, and the bounds of guarded SQL."""

import time

import numpy as np
import pytest

from pulseframe.operators import regression
from pulseframe.plans import calibration, sqlguard


def normal_equations(x, y, penalty):
    x = np.column_stack([x, np.ones(len(x))])
    left = x.T @ x
    left[range(x.shape[1] - 1), range(x.shape[1] - 1)] += penalty
    return np.linalg.solve(left, x.T @ y)


@pytest.mark.parametrize(("features", "penalty"), [(1, 0.0), (3, 1.0), (6, 0.25)])
def test_ridge_of_every_group(spark, features, penalty):
    draw = np.random.default_rng(features)
    names, groups = [f"f{i}" for i in range(features)], {}
    for k in ("a", "b", None):
        x = draw.normal(size=(40, features))
        groups[k] = x, x @ draw.normal(size=features) + 3 + draw.normal(size=40) / 10
    rows = [(k, *map(float, r), float(v)) for k, (x, y) in groups.items() for r, v in zip(x, y, strict=True)] + [("a", *[None] * features, 1.0)]
    df = spark.createDataFrame(rows, f"k string, {', '.join(f'{n} double' for n in names)}, y double").repartition(5)
    got = {r.k: r for r in regression.ridge_by(df, ["k"], names, "y", penalty).collect()}
    for k, (x, y) in groups.items():
        assert got[k].n == 40 and np.allclose([*(got[k][n] for n in names), got[k].intercept], normal_equations(x, y, penalty), atol=1e-9)


def test_features_without_say_and_weights(spark):
    rows = [("same", 2.0, 2.0, float(i)) for i in range(6)] + [("down", float(i), 0.0, -2.0 * i) for i in range(6)] + [("few", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, q double, y double")
    got = {r.k: r for r in regression.weights(regression.ridge_by(df, ["k"], ["p", "q"], "y", 0.0), ["k"], ["p", "q"]).collect()}
    assert got["down"].p == pytest.approx(-2) and (got["down"].q, got["down"].weight_p, got["down"].weight_q) == (0, 0, 0)
    assert got["same"].q == 0 and got["same"].p * 2 + got["same"].intercept == pytest.approx(2.5)
    found = {r.k: r for r in calibration.fit_by(df, ["k"], ["p", "q"], "y", 1.0).collect()}
    assert set(found) == {"same", "down"} and found["down"].r_p == pytest.approx(-1) and found["down"].r_q is None and found["same"].r_p is None
    assert regression.ridge_by(df.limit(0), ["k"], ["p"], "y").collect() == []


def test_queries_that_are_too_large_are_refused(spark):
    spark.range(100).createOrReplaceTempView("hundred")
    big = "SELECT count(*) FROM range(1000000000) a, range(1000000000) b"
    assert sqlguard.fault(spark, big, []) is None
    with pytest.raises(ValueError, match="pairs"):
        sqlguard.run_sql(spark, big, views=[])
    with pytest.raises(ValueError, match="pairs"):
        sqlguard.run_sql(spark, "SELECT * FROM hundred h WHERE h.id IN (SELECT a.id FROM range(10000000) a JOIN range(10000000) b ON a.id < b.id)", views=["hundred"])
    with pytest.raises(ValueError, match="rows"):
        sqlguard.run_sql(spark, "SELECT sum(id) FROM range(9000000000000000)", views=[])
    assert sqlguard.run_sql(spark, "SELECT count(*) AS n FROM hundred a JOIN hundred b ON a.id < b.id", views=["hundred"]).first().n == 4950
    equal = sqlguard.run_sql(spark, "SELECT count(*) AS n FROM range(1000000) a JOIN range(1000000) b ON a.id = b.id", views=[])
    assert equal.first().n == 1_000_000


def test_a_slow_query_is_ended_in_time(spark):
    slow = "SELECT count(*) AS n FROM range(4000000000) WHERE sha2(CAST(id AS STRING), 512) LIKE '%abcdefabcdef%'"
    begin = time.monotonic()
    with pytest.raises(TimeoutError):
        sqlguard.answer(spark, slow, views=[], seconds=1.5)
    assert time.monotonic() - begin < 30
    assert [r.n for r in sqlguard.answer(spark, "SELECT count(*) AS n FROM range(10)", views=[], seconds=60)] == [10]
    with pytest.raises(ValueError, match="no view"):
        sqlguard.answer(spark, "SELECT * FROM elsewhere", views=[])
    assert not any(t.startswith("answer-") for t in spark.sparkContext.getJobTags())
