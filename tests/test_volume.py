"""Operators over long histories: range joins of any lengths, block scans, exact quantiles by selection."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.catalog import QUERIES
from pulseframe.operators import intervals, rolling, scans
from pulseframe.operators.quantiles import exact_quantiles

T0 = dt.datetime(2020, 1, 1)


def moment(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("days", [0.001, 1, 30, 365, 3653, 36525])
def test_an_interval_of_any_length_is_few_rows(spark, days):
    spans = spark.createDataFrame([(1, T0, moment(int(days * 86400)))], "k int, a timestamp, b timestamp")
    assert intervals.laid_out(spans, "a", "b").count() < 40


def test_points_in_intervals_of_all_lengths(spark):
    draw = random.Random(3)
    spans = [(draw.randrange(3), i, a := draw.randrange(10**6), a + draw.choice([0, 1, 50, 3600, 10**4, 10**5, 10**6])) for i in range(60)] + [(1, 60, 500, 400), (None, 61, 0, 10**6)]
    points = [(draw.randrange(3), i, draw.choice([s[2] for s in spans] + [draw.randrange(10**6)])) for i in range(300)] + [(None, 300, 5)]
    wide = spark.createDataFrame([(k, i, moment(a), moment(b)) for k, i, a, b in spans], "k int, span int, a timestamp, b timestamp")
    dots = spark.createDataFrame([(k, i, moment(t)) for k, i, t in points], "k int, point int, at timestamp")
    for closed in (True, False):
        got = sorted((r.point, r.span) for r in intervals.points_in(dots, wide, ["k"], "at", "a", "b", closed).collect())
        assert got == sorted((i, s) for k, i, t in points for k2, s, a, b in spans if k is not None and k == k2 and a <= t and (t <= b if closed else t < b))
    none = intervals.points_in(dots, wide.limit(0), ["k"], "at", "a", "b", True)
    assert none.collect() == []


def test_points_carry_a_block_for_each_size_in_use(spark):
    short = spark.createDataFrame([(1, T0, moment(3600))], "k int, a timestamp, b timestamp")
    sizes = lambda s: intervals.laid_out(s, "a", "b").select("_size").distinct().count()
    assert sizes(short) == 1 and sizes(short.union(spark.createDataFrame([(1, T0, moment(10**8))], short.schema))) == 2


def some_intervals(seed):
    draw = random.Random(seed)
    return [(draw.choice([1, 2, None]), a := draw.randrange(4 * 10**6), a + draw.choice([0, 10, 5000, 60_000, 2 * 10**6 if i % 40 == 0 else 7])) for i in range(250)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_islands_by_blocks_are_those_of_one_sort(spark, seed):
    spans = spark.createDataFrame([(k, moment(a), moment(b)) for k, a, b in some_intervals(seed)], "k int, a timestamp, b timestamp")
    rows = lambda df: sorted(map(tuple, df.select("k", "island_start", "island_end").collect()), key=repr)
    for block in (F.date_trunc("day", "a"), F.date_trunc("month", "a"), F.lit(1)):
        assert rows(intervals.islands(spans, ["k"], "a", "b", block)) == rows(intervals.islands(spans, ["k"], "a", "b"))


def test_running_values_by_blocks(spark):
    draw = random.Random(5)
    rows = [(draw.choice([1, None]), i, draw.choice([None, 0.5, 2.0, -1.0, 8.0]), draw.choice([None, "x", "y"])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at int, v double, s string").repartition(5)
    runs = {"total": scans.Scan("sum", F.col("v")), "top": scans.Scan("max", F.col("v"), before=True), "newest": scans.Scan("last", F.col("s")), "earlier": scans.Scan("last", F.col("s"), before=True)}
    got = {(r.k, r["at"]): r for r in scans.running(df, ["k"], ["at"], F.floor(F.col("at") / 16), runs).collect()}
    held = {}
    for k, at, v, s in rows:
        total, top, newest = held.get(k, (None, None, None))
        row = got[k, at]
        assert (row.top, row.earlier) == (top, newest)
        total = total if v is None else v + (total or 0)
        top, newest = top if v is None else max(v, top if top is not None else v), s or newest
        assert (row.total, row.newest) == (total, newest)
        held[k] = (total, top, newest)
    assert scans.running(df.limit(0), ["k"], ["at"], F.col("at"), runs).collect() == []


def test_as_of_by_blocks(spark):
    draw = random.Random(6)
    facts = spark.createDataFrame([(draw.choice([1, 2]), T0.date() + dt.timedelta(draw.randrange(300)), draw.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)], "k int, d date, v double")
    probes = spark.createDataFrame([(i, draw.choice([1, 2, 3]), T0.date() + dt.timedelta(draw.randrange(300))) for i in range(90)], "id int, k int, d date")
    rows = lambda **more: sorted(map(tuple, rolling.as_of(probes, facts, ["k"], "d", "v", **more).collect()), key=repr)
    assert rows(block=F.date_trunc("month", "d")) == rows() and rows(block=F.col("d"), default=9.0) == rows(default=9.0)


def test_no_window_by_the_single_key_alone(spark):
    for name in ("one_key_islands", "one_key_running", "one_key_as_of"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        windows = re.findall(r"windowspecdefinition\(([^)]*)\)", plan) or re.findall(r"Window \[.*", plan)
        assert windows and all("_blk" in w or "_in" in w for w in windows), name
        assert "SinglePartition" not in plan


def numbers_of(kind, n, draw):
    return {
        "even": lambda: [draw.random() for _ in range(n)],
        "ties": lambda: [draw.choice([1.0, 2.0, 2.0, 5.0]) for _ in range(n)],
        "spread": lambda: [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(n)],
        "one": lambda: [4.25] * n,
        "far": lambda: [0.0] * (n - 1) + [1e308],
        "close": lambda: [1 + draw.randrange(9) * 2**-52 for _ in range(n)],
        "ends": lambda: [draw.choice([-1e308, 1e308]) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("kind", ["even", "ties", "spread", "one", "far", "close", "ends"])
def test_quantiles_are_those_of_sorting(spark, kind):
    draw = random.Random(kind)
    values = {"a": numbers_of(kind, 3000, draw), "b": numbers_of(kind, 7, draw), None: numbers_of(kind, 400, draw), "c": [3.5]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = {"least": 0.0, "low": 0.05, "middle": 0.5, "high": 0.95, "most": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", shares, small=50).collect()}
    assert set(got) == set(values)
    for k, own in values.items():
        ordered = sorted(own)
        for name, share in shares.items():
            at = (len(own) - 1) * share
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert got[k][name] == low + (high - low) * (at - np.floor(at)) and got[k].n == len(own)


def test_quantiles_of_whole_numbers_and_nothing(spark):
    df = spark.range(1, 1002).withColumn("k", F.lit(1))
    row = exact_quantiles(df, ["k"], "id", {"q": 0.25}, small=10).first()
    assert (row.n, row.q) == (1001, 251.0)
    assert exact_quantiles(df.limit(0), ["k"], "id", {"q": 0.25}).collect() == []
