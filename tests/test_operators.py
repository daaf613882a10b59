"""Operators on small histories with known answers."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import training as tr
from pulseframe.operators import baselines, dedup, intervals, load, rolling, workouts, zones
from pulseframe.plans import calibration, recovery


def at(text):
    return dt.datetime.fromisoformat(text)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SEGMENTS = "subject_id string, night string, start_ts timestamp, end_ts timestamp"


@pytest.mark.parametrize(
    ("spans", "hours"),
    [
        ([("22:00", 8), ("22:00", 8)], 8.0), ([("22:00", 6), ("23:00", 7)], 8.0), ([("22:00", 3), ("02:00", 4)], 7.0), ([("22:00", 8), ("23:00", 1)], 8.0), ([("22:00", 4), ("02:00", 4)], 8.0),
    ],
)
def test_union_counts_each_minute_once(spark, spans, hours):
    rows = []
    for clock, length in spans:
        start = at(f"2024-01-{'15' if clock < '12' else '14'} {clock}:00")
        rows.append(("a", "n", start, start + dt.timedelta(hours=length)))
    got = intervals.union_hours(frame(spark, rows, SEGMENTS), ["subject_id", "night"]).collect()
    assert [r.hours for r in got] == [hours]


def test_gap_weights_and_zones(spark):
    rows = [("a", str(i), at("2024-01-01 08:00:00") + dt.timedelta(seconds=30 * i), float(v)) for i, v in enumerate([140, 160, 170, 182, 190, 190])]
    samples = frame(spark, rows, "subject_id string, row_hash string, start_ts timestamp, value double")
    models = {"training": tr.named_bounds(), "percent": tr.percent_bounds(209.0)}
    got = {(r.model, r.zone): r for r in zones.time_in_zones(samples, ["subject_id"], models).collect()}
    assert len(got) == 10 and sum(r.seconds for k, r in got.items() if k[0] == "training") == 150
    assert [got["training", z].minutes for z, _ in tr.named_bounds()] == [0.5] * 5
    assert got["percent", "Z4"].minutes == 1.0 and got["percent", "Z1"].seconds == 0


def test_range_joins_equal_nested_loops(spark):
    draw = random.Random(3)
    base = at("2024-01-01 00:00:00")
    points = [(draw.choice("ab"), i, base + dt.timedelta(seconds=draw.randrange(20_000)), draw.random()) for i in range(200)]
    spans = []
    for i in range(30):
        start = base + dt.timedelta(seconds=draw.randrange(20_000))
        spans.append((draw.choice("abc"), i, start, start + dt.timedelta(seconds=draw.choice([-5, 0, 60, 4000, 9000]))))
    p = frame(spark, points, "k string, pid int, ts timestamp, v double")
    s = frame(spark, spans, "k string, sid int, a timestamp, b timestamp")
    inside = lambda closed: {(q[1], r[1]) for q in points for r in spans if q[0] == r[0] and r[2] <= q[2] and (q[2] <= r[3] if closed else q[2] < r[3])}
    for closed in (True, False):
        got = intervals.points_in(p, s, ["k"], "ts", "a", "b", closed, bucket=700)
        assert sorted((r.pid, r.sid) for r in got.collect()) == sorted(inside(closed))
    covered = intervals.points_covered(p, s, ["k"], "ts", "a", "b", bucket=700)
    assert sorted(r.pid for r in covered.collect()) == sorted({pid for pid, _ in inside(True)})
    means = {r.sid: r for r in intervals.averages_within(s, p, ["k"], ["sid"], "ts", "v", "a", "b", 700).collect()}
    assert len(means) == 30 and all(means[r[1]].samples == sum(sid == r[1] for _, sid in inside(True)) for r in spans)


def test_as_of(spark):
    facts = frame(spark, [("a", dt.date(2024, 1, 2), 5.0), ("a", dt.date(2024, 1, 4), None), ("a", dt.date(2024, 1, 5), 7.0)], "k string, d date, v double")
    probes = frame(spark, [("a", dt.date(2024, 1, n), n) for n in (1, 2, 4, 5, 9)] + [("b", dt.date(2024, 1, 9), 0)], "k string, d date, id int")
    got = {(r.k, r.id): r.v for r in rolling.as_of(probes, facts, ["k"], "d", "v", 72.0).collect()}
    assert got == {("a", 1): 72.0, ("a", 2): 5.0, ("a", 4): 5.0, ("a", 5): 7.0, ("a", 9): 7.0, ("b", 0): 72.0}


def test_steady_load_has_ratio_one(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=n) for n in range(51)]
    records = frame(spark, [("a", "active_energy", 700.0, dt.datetime.combine(d, dt.time(12))) for d in days], "subject_id string, type string, value double, start_ts timestamp")
    none = frame(spark, [], "subject_id string, type string, start_ts timestamp, end_ts timestamp, duration double, distance double, avg_hr double, max_hr double, energy double")
    anchors = frame(spark, [("a", 190.0, 60.0)], "subject_id string, hr_max double, resting_hr double")
    daily = load.daily_load(none, records, anchors, ["subject_id"])
    assert {r.load for r in daily.collect()} == {57.0}
    series = rolling.acwr(rolling.all_days(daily, ["subject_id"], "day", ["load"]), ["subject_id"], since=load.data_start(none, records, ["subject_id"])).orderBy("day").collect()
    assert (series[-1].acwr, series[-1].flag, series[-1].chronic_28d_weekly) == (1.0, "sweet_spot", 399.0)
    assert series[0].flag == "insufficient_history"


def test_exponential_recursion(spark):
    loads = [random.Random(n).random() * 100 for n in range(60)]
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=n), x) for n, x in enumerate(loads)]
    got = rolling.exponential_load(frame(spark, rows, "k string, day date, load double"), ["k"]).orderBy("day").collect()
    a = c = 0.0
    for r, x in zip(got, loads, strict=True):
        a, c = a + (x - a) / 7, c + (x - c) / 42
        assert r.atl == pytest.approx(a, abs=0.051) and r.tsb == pytest.approx(c - a, abs=0.051)


def test_splits_of_a_run(spark):
    rows = [("w", at("2024-01-01 08:00:00") + dt.timedelta(seconds=30 * i), 0.1, at("2024-01-01 08:12:30")) for i in range(25)]
    got = workouts.kilometre_splits(frame(spark, rows, "w string, start_ts timestamp, value double, end timestamp"), ["w"], "end").orderBy("km").collect()
    assert [r.km for r in got] == [1, 2, 3] and got[-1].partial and got[-1].distance_km == 0.5 and got[0].pace_min_per_km == 5.0


def test_roles_of_steps(spark):
    steps = [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 1, 0), (4, 1, 1), (5, 2, 0)]
    got = workouts.roles(frame(spark, [("w", *s) for s in steps], "w string, step_index int, step_block int, step_slot int"), ["w"]).orderBy("step_index").collect()
    assert [r.role for r in got] == ["warmup", "work", "recovery", "work", "recovery", "cooldown"]
    alone = workouts.roles(frame(spark, [("w", 0, 0, 0), ("w", 1, 0, 1)], "w string, step_index int, step_block int, step_slot int"), ["w"]).orderBy("step_index").collect()
    assert [r.role for r in alone] == ["work", "recovery"]


def test_functional_maximum_of_real_runs(spark):
    rows = [("a", f"{i}{copy}", "running", at("2024-01-01 08:00:00") + dt.timedelta(days=i, seconds=10 * copy), 190.0 + 5 * i) for i in range(5) for copy in range(3)]
    table = frame(spark, rows, "subject_id string, row_hash string, type string, start_ts timestamp, max_hr double")
    assert dedup.real_workouts(table).count() == 5
    assert zones.functional_max(table, ["subject_id"]).first().hr_max == 209.0
    assert zones.functional_max(table.filter("max_hr < 205"), ["subject_id"]).first().hr_max == 200.0


def plain_quantile(values, weights, q):
    pairs = sorted(zip(values, weights, strict=True))
    total, done, before = sum(weights), 0.0, None
    for v, w in pairs:
        place = (done + w / 2) / total
        if q <= place:
            return v if before is None else before[1] + (q - before[0]) / (place - before[0]) * (v - before[1])
        done, before = done + w, (place, v)
    return pairs[-1][0]


def plain_baseline(values):
    n = len(values)
    weights = [0.5 ** ((n - 1 - i) / 14) for i in range(n)]
    mid = lambda x: (sorted(x)[(len(x) - 1) // 2] + sorted(x)[len(x) // 2]) / 2
    spread = 1.4826 * mid([abs(v - mid(values)) for v in values])
    work = [min(mid(values) + 3 * spread, max(mid(values) - 3 * spread, v)) for v in values] if n > 1 and spread > 0 else values
    center = plain_quantile(work, weights, 0.5)
    return center, 1.4826 * plain_quantile([abs(v - center) for v in work], weights, 0.5)


def test_baselines_equal_a_plain_version(spark):
    draw = random.Random(8)
    lists = [[round(draw.gauss(50, 8), 1) for _ in range(n)] for n in (1, 2, 3, 5, 10, 28)] + [[50.0] * 5 + [900.0], [40.0, 60.0] * 4]
    got = baselines.with_baseline(frame(spark, [(i, x) for i, x in enumerate(lists)], "i int, x array<double>"), "x", "b").orderBy("i").collect()
    for r in got:
        center, scale = plain_baseline(lists[r.i])
        assert r.b_center == pytest.approx(center) and r.b_scale == pytest.approx(scale, abs=1e-9) and r.b_n == len(lists[r.i])
    empty = baselines.with_baseline(frame(spark, [([],)], "x array<double>"), "x", "b").first()
    assert (empty.b_center, empty.b_scale, empty.b_n) == (None, 0.0, 0)


NIGHTS = 40


def history(spark, subject="a"):
    """Nights 23:30 to 06:30 with heart rate every three minutes, and one HRV, respiration and temperature value each."""
    draw, sleep, records = random.Random(2), [], []
    hrv = [round(math.exp(draw.gauss(4, 0.2)), 1) for _ in range(NIGHTS)]
    for n in range(NIGHTS):
        bed = at("2024-01-01 23:30:00") + dt.timedelta(days=n, minutes=draw.randrange(30))
        for k, stage in enumerate(("core", "deep", "rem", "core", "awake", "core", "rem")):
            sleep.append((subject, stage, bed + dt.timedelta(hours=k), bed + dt.timedelta(hours=k + 1)))
        records += [(subject, "heart_rate", 50.0 + draw.random() * 6 + (n == 35) * 9, bed + dt.timedelta(minutes=3 * m)) for m in range(140)]
        records += [(subject, "heart_rate", 35.0, bed + dt.timedelta(hours=4, minutes=m)) for m in range(0, 50, 3)]  # awake
        for kind, value in (("hrv", hrv[n]), ("respiratory_rate", 14 + draw.random()), ("sleeping_wrist_temperature", 35 + draw.random() / 2)):
            records.append((subject, kind, value, bed + dt.timedelta(hours=2)))
    return hrv, frame(spark, sleep, "subject_id string, stage string, start_ts timestamp, end_ts timestamp"), frame(spark, records, "subject_id string, type string, value double, start_ts timestamp")


def test_recovery_of_all_nights(spark):
    hrv, sleep, records = history(spark)
    _, more_sleep, more_records = history(spark, "b")
    scores = recovery.recovery(sleep.unionByName(more_sleep), records.unionByName(more_records), ["subject_id"])
    rows = scores.orderBy("subject_id", "night").collect()
    assert len(rows) == 2 * NIGHTS
    first, second = rows[:NIGHTS], rows[NIGHTS:]
    assert [r.score for r in first] == [r.score for r in second]
    assert first[3].state == "calibrating" and first[-1].state == "ok" and first[-1].hours_asleep == 6.0
    for n in (20, 35, 39):
        logs = [math.log(v) for v in hrv]
        center, scale = plain_baseline(logs[max(0, n - 28) : n])
        recent = logs[max(0, n - 6) : n + 1]
        assert first[n].hrv_z == pytest.approx((sum(recent) / len(recent) - center) / scale)
        assert first[n].hrv_score == pytest.approx(min(100, max(0, 50 + 16.6 * first[n].hrv_z)))
    assert all(r.sleeping_hr > 49 for r in first) and first[35].sleeping_hr_z > 3
    told = recovery.contributions(frame(spark, [tuple(r) for r in first[-2:]], scores.schema), ["subject_id", "night"]).collect()
    parts = [p for p in told if p.night == first[-1].night]
    assert sum(p["weight"] for p in parts) == pytest.approx(1, abs=0.003) and sum(p["contribution"] for p in parts) == pytest.approx(first[-1].score, abs=0.4)
    assert [p.metric for p in sorted(parts, key=lambda p: p.place)][:2] == ["hrv", "sleep"]


def test_readiness(spark):
    _, sleep, records = history(spark)
    table = frame(spark, [("a", "running", at("2024-02-09 18:00:00"), at("2024-02-09 20:00:00"), 120.0, 20.0, 180.0, 195.0, 1500.0)], "subject_id string, type string, start_ts timestamp, end_ts timestamp, duration double, distance double, avg_hr double, max_hr double, energy double")
    anchors = frame(spark, [("a", 200.0, 50.0)], "subject_id string, hr_max double, resting_hr double")
    rows = recovery.readiness(recovery.recovery(sleep, records, ["subject_id"]), table, records, anchors, ["subject_id"]).orderBy("night").collect()
    by_night = {str(r.night): r for r in rows}
    after = by_night["2024-02-10"]
    assert after.owed_h == pytest.approx(48 - 12, abs=0.1) and after.penalty == pytest.approx(0.6 * 36, abs=0.1)
    assert after.readiness == pytest.approx(max(0, after.score - after.penalty), abs=0.11)
    assert by_night["2024-02-05"].owed_h == 0.0 and by_night["2024-02-05"].readiness <= by_night["2024-02-05"].score


def test_short_and_generic_nights(spark):
    start = at("2024-01-02 00:00:00")
    sleep = frame(spark, [("a", "core", start, start + dt.timedelta(hours=1)), ("a", "asleep", start + dt.timedelta(days=1), start + dt.timedelta(days=1, hours=5))], "subject_id string, stage string, start_ts timestamp, end_ts timestamp")
    records = frame(spark, [("a", "heart_rate", 56.0, start + dt.timedelta(days=d, minutes=3 * m)) for d in (0, 1) for m in range(90)], "subject_id string, type string, value double, start_ts timestamp")
    got = {str(r.night): (r.value, r.source) for r in recovery.sleeping_rate(sleep, records, ["subject_id"]).collect()}
    assert got == {"2024-01-02": (None, "stage_restricted"), "2024-01-03": (56.0, "p5_fallback")}


def test_calibration(spark, tmp_path):
    draw = random.Random(5)
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=n)).isoformat() for n in range(30)]
    rows = [(d, draw.uniform(30, 70), draw.uniform(30, 70), draw.uniform(30, 70)) for d in days]
    (tmp_path / "scores.csv").write_text("date,hrv,sleep,resp\n" + "\n".join(f"{d},{a},{b},{c}" for d, a, b, c in rows) + "\n2024-03-01,,1,2\n")
    (tmp_path / "labels.csv").write_text("date,perceived_readiness\n" + "\n".join(f"{d},{2 * a + b - c}" for d, a, b, c in rows) + "\n2024-03-01,5\n2024-03-02,\n")
    found = calibration.fit(calibration.read_days(spark, str(tmp_path / "scores.csv"), "hrv", "sleep", "resp"), calibration.read_days(spark, str(tmp_path / "labels.csv"), "perceived_readiness"), 0.0)
    assert found["n_days"] == 30 and found["coefficients"] == pytest.approx({"hrv": 2, "sleep": 1, "resp": -1}, abs=1e-3)
    assert found["suggested_weights"] == pytest.approx({"hrv": 0.667, "sleep": 0.333, "resp": 0.0}, abs=1e-3) and found["correlations"]["hrv"] > 0.5
    (tmp_path / "hrv.csv").write_text("date,hrv\n" + "\n".join(f"{d},{a}" for d, a, *_ in rows))
    read = calibration.read_days(spark, str(tmp_path / "hrv.csv"), "hrv")
    reference = str(tmp_path / "reference.json")
    assert calibration.drift(read, reference)["state"] == "reference written" and calibration.drift(read, reference)["state"] == "within tolerance"
    assert calibration.drift(read.withColumn("hrv", F.col("hrv") * 3), reference)["state"] == "drifted"


def test_gaps_reach_over_midnight(spark):
    rows = [("a", 1, "2024-01-01 23:59:50"), ("a", 2, "2024-01-02 00:00:05"), ("a", 3, "2024-01-02 00:00:05"), ("a", 4, "2024-01-09 10:00:00"), ("b", 5, "2024-01-01 08:00:00")]
    samples = spark.createDataFrame(rows, "subject_id string, row_hash int, t string").selectExpr("subject_id", "row_hash", "CAST(t AS TIMESTAMP) AS start_ts")
    assert {r.row_hash: r.seconds for r in zones.gap_weights(samples, ["subject_id"]).collect()} == {1: 15, 2: 0, 3: 60, 4: 0, 5: 0}


def test_fatigue_and_fitness_follow_the_recursion(spark):
    draw, first = random.Random(2), dt.date(2021, 11, 3)
    loads = {who: [draw.choice([0.0, 0.0, 55.5, 120.0]) for _ in range(n)] for who, n in (("a", 400), ("b", 3))}
    rows = [(who, first + dt.timedelta(days=i), x) for who, own in loads.items() for i, x in enumerate(own)]
    daily = spark.createDataFrame(rows, "subject_id string, day date, load double")
    got = {(r.subject_id, r.day): (r.atl, r.ctl) for r in rolling.exponential_load(daily, ["subject_id"]).collect()}
    for who, own in loads.items():
        a = c = 0.0
        for i, x in enumerate(own):
            a, c = a + (x - a) / 7, c + (x - c) / 42
            found = got[who, first + dt.timedelta(days=i)]
            assert abs(found[0] - a) < 0.051 and abs(found[1] - c) < 0.051
    assert len(got) == len(rows)


def test_days_between_rows_are_filled(spark):
    rows = [("a", "2024-01-01", 2.0), ("a", "2024-01-04", None), ("b", "2024-02-28", 1.0)]
    df = spark.createDataFrame(rows, "k string, d string, v double").selectExpr("k", "CAST(d AS DATE) AS d", "v")
    full = rolling.all_days(df, ["k"], "d", ["v"], last=F.lit("2024-03-01").cast("date"))
    got = sorted((r.k, r.d.isoformat(), r.v) for r in full.collect())
    assert [g for g in got if g[0] == "b"] == [("b", "2024-02-28", 1.0), ("b", "2024-02-29", 0.0), ("b", "2024-03-01", 0.0)]
    assert len(got) == 61 + 3 and got[0][2] == 2.0 and sum(g[2] for g in got) == 3.0
    assert rolling.all_days(df, ["k"], "d", ["v"]).count() == 5
