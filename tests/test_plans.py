"""Tools, guard, plans and dashboard over a small store."""

import datetime as dt
import json
import random

import pytest

from pulseframe.plans import dashboard, sqlguard, tools, weekly
from pulseframe.sources.sink import Store, hashed


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    draw = random.Random(4)
    start = dt.datetime(2024, 3, 1, 8)
    records, sleep, workouts = [], [], []
    for n in range(60):
        day = start + dt.timedelta(days=n)
        for kind, value in (("resting_heart_rate", 55 - n / 20), ("hrv", 60 + draw.random() * 9), ("vo2max", 45 + n / 60), ("heart_rate_recovery", 30 + n / 10), ("active_energy", 650.0)):
            records.append((kind, "Watch", "u", float(value), day, day, 30))
        for source, steps in (("Watch", 9000.0), ("Phone", 7000.0 + n)):
            records.append(("step_count", source, "count", steps, day, day + dt.timedelta(minutes=n), 30 if source == "Watch" else 20))
        bed = day + dt.timedelta(hours=15)
        sleep += [("Watch", s, bed + dt.timedelta(hours=2 * k), bed + dt.timedelta(hours=2 * k + 2)) for k, s in enumerate(("core", "deep", "rem", "core"))]
        sleep.append(("Phone", "asleep", bed, bed + dt.timedelta(hours=8)))
        if n % 3 == 0:
            for copy in range(3):
                begin = day + dt.timedelta(hours=9, seconds=copy * 5)
                workouts.append(("running", f"Watch {copy}", 50.0, 10.0, 700.0, 160.0, 180.0 + n / 10, begin, begin + dt.timedelta(minutes=50)))
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    frames = {
        "records": spark.createDataFrame(records, "type string, source_name string, unit string, value double, start_ts timestamp, end_ts timestamp, source_priority int").selectExpr("*", "type AS raw_type", "NULL AS source_version", "NULL AS device", "NULL AS value_str", "NULL AS created_ts"),
        "sleep": spark.createDataFrame(sleep, "source_name string, stage string, start_ts timestamp, end_ts timestamp").selectExpr("*", "NULL AS device", "stage AS raw_value"),
        "workouts": spark.createDataFrame(workouts, "type string, source_name string, duration double, distance double, energy double, avg_hr double, max_hr double, start_ts timestamp, end_ts timestamp").selectExpr("*", "type AS raw_type", "NULL AS device", "'min' AS duration_unit", "'km' AS distance_unit", "'kcal' AS energy_unit"),
    }
    for name, frame in frames.items():
        store.add(name, hashed(name, frame))
    return store.views()


def test_dashboard(views, tmp_path):
    path = str(tmp_path / "page.html")
    assert dashboard.build(views, path) == {"path": path, "generated": "2024-04-30", "runs": 20, "workouts": 20}
    found = dashboard.collected(views)
    assert found["dupes"] == 40 and found["steps_raw"][-1] == ["2024-04-29", 9000.0]
    assert {round(v, 2) for _, v in found["sleep_h_raw"]} == {8.0} and {v for _, v in found["deep_h_raw"]} == {2.0}
    assert found["kpi"]["weeks_run_q3"] == found["kpi"]["weeks_q3"] and found["kpi"]["longest"]["km"] == 10.0 and found["kpi"]["dupes"] == 40
    assert found["month"]["rhr"]["d"] < 0 and len(found["month"]["board"]) == 8 and found["month"]["n30"] == 9
    assert found["load"]["ctl"][-1][1] > 0 and len(found["load"]["atl"]) == 61
    page = open(path, encoding="utf-8").read()
    assert page.count("</script>") == 1 and "2024-04-30" in page
    assert "</b" not in dashboard.render(found | {"note": "</b>"}).split("const data")[1].split("\n")[0]
    slices = dashboard.narrative_slices(found, goal=4.5)
    assert set(slices) >= {"month.hero", "perf.tenk", "load.intro"} and all(slices.values())
    best = slices["perf.tenk"]["fastest_10k_efforts"]
    assert len(best) == 5 and best[0]["time"] == 50.0 and best[0]["gap"] == 0.5 and best[0]["effort"] == round(best[0]["hr"] / found["hrmax"] * 100)
    month = found["month"]
    assert (month["w1"], month["h_mid"], month["hrr_b_d"]) == ("2024-04-30", "2024-04-16", "2024-04-29") and month["hrr_n"] == len(slices["month.hero"]["hrr_series_in_block"])
    assert found["kpi"]["hrr_blockstart"] == month["hrr_a"] and len(dashboard.clipped(found["steps"], "2024-04-30", 10)) == 10
    assert dashboard.pauses([{"d": "2024-01-01"}, {"d": "2024-03-16"}, {"d": "2024-03-20"}]) == [75]


def test_narratives_and_plan_of_the_page(tmp_path):
    told, plan = tmp_path / "told.json", tmp_path / "plan.json"
    told.write_text(json.dumps({"generated_for": "2024-04-30", "blocks": {"month.hero": "up"}}))
    assert dashboard.narratives(str(told), "2024-04-30")["blocks"] and dashboard.narratives(str(told), "2024-05-01") is None and dashboard.narratives(str(plan), "2024-04-30") is None
    plan.write_text(json.dumps({"week_of": "2024-04-22", "planned": [{"id": "a"}]}))
    assert dashboard.current_plan(str(plan), "2024-04-30") and dashboard.current_plan(str(plan), "2024-05-20") is None and dashboard.current_plan(str(told), "2024-04-30") is None


def test_block_start_walks_over_full_weeks():
    weeks = [{"w": f"2024-01-{d:02d}", "n": n} for d, n in ((1, 2), (8, 0), (15, 1), (22, 3), (29, 0))]
    assert dashboard.block_start(weeks, "2024-01-30") == "2024-01-15"
    assert dashboard.block_start([], "2024-01-30") == "2024-01-30"


def test_sql_guard_lets_queries_pass(spark, views):
    run = lambda *a, **b: sqlguard.run_sql(spark, *a, **b)
    assert run("SELECT type, count(*) AS n FROM records_dedup GROUP BY type -- all of them;").count() == 6
    assert run("with x as (select 1 as a), y as (select a + 1 as b from x) select * from x join y on b > a;").count() == 1
    assert run("SELECT * FROM range(5000)").count() == 1000
    assert run("SELECT * FROM sleep WHERE stage = ?", args=["deep"]).count() == 60
    assert run("SELECT 'please update' AS said, reload FROM (VALUES (1)) AS t(reload)").count() == 1
    query = """SELECT w.type, row_number() OVER (PARTITION BY w.type ORDER BY w.start_ts) AS n, explode(array(1, 2)) AS e
      FROM Workouts w LEFT JOIN (SELECT DISTINCT source_name FROM sleep UNION ALL SELECT 'x') s USING (source_name)
      WHERE w.avg_hr > (SELECT avg(value) FROM records WHERE type = 'hrv') AND EXISTS (SELECT 1 FROM sleep) QUALIFY n < 3"""
    assert sqlguard.fault(spark, query.replace("QUALIFY n < 3", "ORDER BY n LIMIT 3")) is None
    assert sqlguard.fault(spark, "SELECT * FROM records", views=["sleep"]) and sqlguard.fault(spark, "SELECT * FROM sleep", views=["sleep"]) is None


@pytest.mark.parametrize(
    "query",
    [
        "", "-- nothing", "selection", "SELECT 1; SELECT 2", "DROP TABLE records", "/* SELECT */ DELETE FROM records", "DESCRIBE records", "SHOW TABLES", "SET x = 1", "EXPLAIN SELECT 1", "CACHE TABLE sleep",
        "INSERT INTO sleep SELECT * FROM sleep", "WITH x AS (SELECT 1) INSERT INTO sleep SELECT * FROM x", "CREATE TABLE t AS SELECT 1", "FROM sleep INSERT INTO sleep SELECT *",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'getenv')", "SELECT try_reflect('java.lang.Math', 'abs', 1)", "SELECT system.builtin.reflect('java.lang.System', 'getenv')",
        "SELECT 1 WHERE EXISTS (SELECT 1 FROM (SELECT java_method('java.lang.System', 'exit', 0)))", "SELECT * FROM sleep ORDER BY java_method('java.lang.System', 'getenv')", "SELECT transform(array(1), x -> reflect('java.lang.Math', 'abs', x))",
        "SELECT value FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM `csv`.`/etc/passwd`", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "WITH x AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM x",
        "SELECT * FROM default.sleep", "SELECT * FROM nowhere", "SELECT * FROM x JOIN (WITH x AS (SELECT 1) SELECT * FROM x) y", "SELECT * FROM IDENTIFIER('sl' || 'eep')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv')", "TABLE nowhere",
        "SELECT TRANSFORM(stage) USING 'cat' FROM sleep", "SELECT input_file_name() FROM sleep", "SELECT * FROM sql_keywords()", "SELECT current_user()",
    ],
)
def test_sql_guard_refuses(spark, views, query):
    with pytest.raises(ValueError, match="."):
        sqlguard.run_sql(spark, query)


def test_tools(views):
    catalogue = {r.type: r.records for r in tools.metric_catalogue(views["records"]).collect()}
    assert catalogue["step_count"] == 120 and len(catalogue) == 6
    rows, more = tools.readings(views["records_dedup"], "hrv", limit=10)
    assert len(rows) == 10 and more
    assert tools.daily(views["records_dedup"], "step_count", first="2024-03-05", last="2024-03-06").count() == 2
    assert tools.workout_list(views["workouts"], kind="RUN", first="2024-04-01").count() == 27
    nights = tools.sleep_nights(views["sleep"]).collect()
    assert {r.hours_asleep for r in nights} == {16.0} and nights[0].stages["core"] == 4.0
    status = tools.sync_status(views)
    assert status["counts"].first().workouts == 60 and status["latest"].count() == 6
    assert tools.sections("zones, reps") == ("zones", "reps") and tools.sections(None) == tools.SECTIONS
    with pytest.raises(ValueError, match="tempo"):
        tools.sections(["tempo"])
    rate = views["records_dedup"].limit(1).selectExpr("subject_id", "'heart_rate' AS type", "explode(sequence(0, 9)) AS n").selectExpr("subject_id", "type", "CAST(n AS STRING) AS row_hash", "100D + 10 * n AS value", "timestamp'2024-03-01 17:00:00' + make_dt_interval(0, 0, 0, 20 * n) AS start_ts")
    spent = {(r.model, r.zone): r.seconds for r in tools.hr_zones(rate, views["workouts"], 190.0).collect()}
    assert sum(v for (m, _), v in spent.items() if m == "percent") == 180 and spent["percent", "Z5"] == 20 and spent["training", "vo2max"] == 0
    details = tools.workout_details(views["workouts"].filter("source_name = 'Watch 0'"), rate, views["workout_events"], include="zones, series, splits, reps")
    assert set(details) == {"zones", "series", "splits", "reps", "work"} and details["zones"].select("workout").distinct().count() == 1 and details["splits"].count() == 0
    assert details["series"].agg({"hr": "avg"}).first()[0] > 100 and details["reps"].count() == 0
    known = views["workouts"].select("subject_id").distinct().selectExpr("*", "190D AS hr_max", "60D AS resting_hr")
    loads = tools.training_load(views["workouts"], views["records_dedup"], known, "2024-04-01", "2024-04-10")
    assert loads["daily"].count() == 10 and loads["acwr"].filter("acwr IS NOT NULL").count() == 10


def test_weekly_plans(tmp_path):
    plan = {"schema_version": 1, "week_of": "2024-01-01", "planned": [{"id": "a", "constraints": {"km": 5}, "day": "monday"}]}
    path = str(tmp_path / "plans" / "plan.json")
    saved = weekly.save(plan, path)
    assert weekly.load(path) == saved and json.load(open(path))["plan_id"] == weekly.save(saved, path)["plan_id"]
    wrong = {"schema_version": True, "week_of": "2024-1-1", "plan_id": "x", "planned": [{"id": "a"}, {"id": "a", "constraints": {}, "day": "someday"}, 3]}
    assert len(weekly.faults(wrong)) == 7 and weekly.faults([]) and weekly.load(str(tmp_path / "none.json")) is None
    with pytest.raises(ValueError, match="week_of"):
        weekly.save(wrong, path)
