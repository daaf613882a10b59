"""More of the library as queries: the tools that answer for one workout or span of days, anchors, guarded SQL, and small formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ADAPTERS, PERCENT_CASE, SQL, Tables, query, rd, text, zone_sql
from .functions import identifiers as ids
from .functions import scores as sc
from .functions import times as tm
from .functions import training as tr
from .operators import dedup, zones


@query("guarded_sql", "SELECT subject_id, type, count(*) AS n, round(avg(value), 6) AS mean FROM rec WHERE type <> 'hrv' AND start_ts >= TIMESTAMP '2024-01-05' GROUP BY ALL HAVING count(*) > 3")
def guarded_sql(t: Tables) -> DataFrame:
    """TL-16, SQL-01, FIL-16, FIL-19, SO-05, FIL-08: a query with parameters that passes the guard."""
    from .plans.sqlguard import run_sql

    t.rec.createOrReplaceTempView("pulseframe_readings")
    asked = "WITH own AS (SELECT * FROM pulseframe_readings WHERE type <> ? AND start_ts >= to_timestamp(?)) SELECT subject_id, type, count(*) AS n, round(avg(value), 6) AS mean FROM own GROUP BY subject_id, type HAVING count(*) > 3"
    return run_sql(t.spark, asked, args=["hrv", "2024-01-05"], views=["pulseframe_readings"])


@query("capped_series", "SELECT subject_id, CAST(start_ts::DATE AS VARCHAR) AS day, round(sum(value), 4) AS value, count(*) AS samples FROM rec WHERE type = 'step_count' GROUP BY subject_id, start_ts::DATE ORDER BY start_ts::DATE, subject_id LIMIT 5000")
def capped_series(t: Tables) -> DataFrame:
    """SO-04: a tool's series in order of days, as much as it shows."""
    from .plans.tools import daily, first_days

    out = first_days(daily(t.rec, "step_count", ["subject_id"]), ["subject_id"])
    return text(out.select("subject_id", "day", F.round("value", 4).alias("value"), "samples"), "day")


def detail(t: Tables, section: str) -> DataFrame:
    from .plans.tools import workout_details

    return workout_details(t.wk.filter("source_name = 'Watch'"), t.rec, t.seg, include=section)[section]


_ZONES_OF_WORKOUTS = zone_sql().replace(
    "hr AS (SELECT * FROM rec WHERE type = 'heart_rate' )",
    "hr AS (SELECT one.row_hash AS subject_id, rec.row_hash, rec.start_ts, rec.value FROM rec JOIN one ON rec.subject_id = one.subject_id AND rec.start_ts BETWEEN one.start_ts AND one.end_ts WHERE rec.type = 'heart_rate')",
)


@query("workout_zones", _ZONES_OF_WORKOUTS.replace("SELECT subject_id, model, zone, seconds, round", "SELECT subject_id AS workout, model, zone, seconds, round"))
def workout_zones(t: Tables) -> DataFrame:
    """TL-11, FIL-15, TL-12: zones inside every workout at once."""
    return detail(t, "zones")


@query("workout_splits", """, s AS (SELECT one.row_hash AS workout, one.end_ts AS we, rec.start_ts, value AS v FROM rec JOIN one ON rec.subject_id = one.subject_id AND rec.start_ts BETWEEN one.start_ts AND one.end_ts WHERE rec.type = 'distance_walking_running'),
c AS (SELECT *, sum(v) OVER (PARTITION BY workout ORDER BY start_ts) AS cum FROM s), k AS (SELECT workout, CAST(ceil(round(cum, 6)) AS INT) AS km, min(start_ts) AS a, sum(v) AS dist, max(we) AS we FROM c WHERE cum > 0 GROUP BY ALL),
n AS (SELECT *, lead(a) OVER (PARTITION BY workout ORDER BY km) AS nxt FROM k)
SELECT workout, km, round(CAST(date_diff('second', a, coalesce(nxt, we)) AS DOUBLE), 1) AS duration_sec, """ + rd("dist", 3) + """ AS distance_km, nxt IS NULL AND dist < 0.95 AS partial FROM n""")
def workout_splits(t: Tables) -> DataFrame:
    """TL-11: the splits of every workout."""
    return detail(t, "splits").select("workout", "km", "duration_sec", "distance_km", "partial")


def known(t: Tables) -> DataFrame:
    return t.rec.select("subject_id").distinct().withColumns({"hr_max": F.lit(190.0), "resting_hr": F.lit(60.0)})


@query("training_load", SQL["acwr"].removeprefix(ADAPTERS) + " WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def training_load(t: Tables) -> DataFrame:
    """TL-13: some days of the workload ratio, which looks back before them."""
    from .plans.tools import training_load as loads

    return text(loads(t.wk, t.rec, known(t), "2024-01-10", "2024-01-20", ["subject_id"])["acwr"], "day")


@query("training_days", SQL["daily_load"].removeprefix(ADAPTERS) + " WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def training_days(t: Tables) -> DataFrame:
    """TL-13: the same days' loads."""
    from .plans.tools import training_load as loads

    return text(loads(t.wk, t.rec, known(t), "2024-01-10", "2024-01-20", ["subject_id"])["daily"], "day")


@query("anchors", """, r AS (SELECT subject_id, max_hr FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, type, date_trunc('minute', start_ts) ORDER BY start_ts, row_hash) AS rn FROM wk WHERE type = 'running' AND max_hr IS NOT NULL) WHERE rn = 1 AND max_hr <> 0),
f AS (SELECT subject_id, quantile_cont(max_hr, 0.95) AS p, count(*) AS n FROM r GROUP BY ALL), tp AS (SELECT subject_id, round(max(max_hr)) AS top FROM wk GROUP BY ALL), nw AS (SELECT subject_id, max(start_ts) AS m FROM rec WHERE type = 'hrv' GROUP BY ALL),
q AS (SELECT rec.subject_id, round(quantile_cont(value, 0.10)) AS rest FROM rec JOIN nw USING (subject_id) WHERE type = 'hrv' AND start_ts >= m - INTERVAL 90 DAY GROUP BY ALL), s AS (SELECT subject_id FROM rec UNION SELECT subject_id FROM wk)
SELECT s.subject_id, round(coalesce(CASE WHEN f.n >= 4 THEN p ELSE coalesce(nullif(top, 0), 190.0) END, 190.0), 6) AS hr_max, coalesce(rest, 60.0) AS resting_hr FROM s LEFT JOIN tp USING (subject_id) LEFT JOIN f USING (subject_id) LEFT JOIN q USING (subject_id)""")
def anchors(t: Tables) -> DataFrame:
    """AG-09, AG-10, FIL-18: what zones and loads are measured by, found in the data where nothing is given."""
    rest = t.rec.filter("type = 'hrv'").withColumn("type", F.lit("resting_heart_rate"))
    found = zones.anchors(t.wk, rest.unionByName(t.rec.filter("type <> 'hrv'")), ["subject_id"])
    return found.select("subject_id", F.round("hr_max", 6).alias("hr_max"), "resting_hr")


@query("zones_of_bins", f"SELECT subject_id, {PERCENT_CASE} AS zone, CAST(30 * count(*) AS BIGINT) AS seconds FROM rec WHERE type = 'heart_rate' AND value IS NOT NULL GROUP BY ALL")
def zones_of_bins(t: Tables) -> DataFrame:
    """SC-59: zones from bins of a known width."""
    bins = t.rec.filter("type = 'heart_rate'").select("subject_id", F.col("value").alias("bpm"), F.lit(30).cast("long").alias("seconds"))
    return zones.zones_of_pairs(bins, ["subject_id"], tr.percent_bounds(190.0))


@query("repetitions", """, ev AS (SELECT subject_id, row_hash, start_ts::DATE AS ws, row_hash % 3 AS kind, row_hash % 4 AS step_index, CAST(row_hash % 5 AS VARCHAR) AS uuid, CAST(row_hash % 7 AS VARCHAR) AS src FROM seg)
SELECT row_hash, step_index FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, ws, uuid, step_index ORDER BY src, row_hash) AS rn FROM ev WHERE kind = 0) WHERE rn = 1""")
def repetitions(t: Tables) -> DataFrame:
    """WN-05: one activity for each uuid and index of a session."""
    n = F.col("row_hash")
    events = t.seg.select(
        "subject_id", "row_hash", F.to_date("start_ts").alias("workout_start_ts"), F.when(n % 3 == 0, "activity").otherwise("event").alias("event_kind"), (n % 4).alias("step_index"),
        (n % 5).cast("string").alias("activity_uuid"), (n % 7).cast("string").alias("workout_source_name"),
    )
    return dedup.repetitions(events).select("row_hash", "step_index")


@query("worthwhile_change", "SELECT row_hash, 15.0::DOUBLE AS swc, abs((value - 60) / 30) >= 0.5 AS meaningful, abs((value - 60) / 30) >= 1 AS significant FROM rec WHERE type = 'hrv'")
def worthwhile_change(t: Tables) -> DataFrame:
    """SR-18."""
    found = sc.change((F.col("value") - 60) / 30, F.lit(30.0))
    return t.rec.filter("type = 'hrv'").select("row_hash", *(c.alias(n) for n, c in found.items()))


@query("wording", """SELECT row_hash, CASE WHEN abs(value - 50) < 0.05 THEN 'flat' WHEN value > 50 THEN 'improved' ELSE 'slipped' END AS more, CASE WHEN abs(value - 50) < 0.05 THEN 'flat' WHEN value < 50 THEN 'improved' ELSE 'slipped' END AS less,
  CASE WHEN value - 50 > 5 THEN 'fresh' WHEN value - 50 > -10 THEN 'balanced' ELSE 'loaded' END AS form, printf('%d:%02d', CAST(round(value * 60) AS BIGINT) // 60, CAST(round(value * 60) AS BIGINT) % 60) AS clock FROM rec WHERE type = 'hrv'""")
def wording(t: Tables) -> DataFrame:
    """PR-02, PR-03, SC-14: what figures are called."""
    from .plans.dashboard import direction, form

    away = F.col("value") - 50
    return t.rec.filter("type = 'hrv'").select("row_hash", direction(away).alias("more"), direction(away, False).alias("less"), form(away).alias("form"), tr.clock(F.col("value")).alias("clock"))


@query("small_forms", """SELECT row_hash, regexp_replace('up/' || type || ' #' || row_hash, '[^A-Za-z0-9_.-]', '_', 'g')[:80] AS batch, value AS number, CASE WHEN row_hash % 2 = 0 THEN CAST(row_hash % 90 AS DOUBLE) END AS climbed, 'cm' AS climbed_unit,
  round(CASE WHEN hour(start_ts) + minute(start_ts) / 60 > 18 THEN hour(start_ts) + minute(start_ts) / 60 - 24 ELSE hour(start_ts) + minute(start_ts) / 60 END, 6) AS bed,
  CAST(CASE WHEN hour(start_ts) < 18 THEN start_ts::DATE ELSE start_ts::DATE + 1 END AS VARCHAR) AS night, round(value * 0.001, 9) AS km, round(value / 60, 9) AS minutes FROM rec WHERE start_ts::DATE = DATE '2024-01-12'""")
def small_forms(t: Tables) -> DataFrame:
    """SC-05, SC-11, SC-30, SC-40, SC-51, FIL-05, FIL-13: texts and numbers, for one local day."""
    n, start = F.col("row_hash"), F.col("start_ts")
    climbed, unit = ids.quantity(F.concat(F.when(n % 2 == 0, (n % 90).cast("string")).otherwise("many"), F.lit(" cm")))
    own = t.rec.filter(F.to_date(start) == F.lit("2024-01-12").cast("date"))
    return own.select(
        "row_hash", ids.batch_id(F.concat(F.lit("up/"), "type", F.lit(" #"), n.cast("string"))).alias("batch"), ids.number(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).alias("number"),
        climbed.alias("climbed"), unit.alias("climbed_unit"), F.round(tm.bed_hours(start), 6).alias("bed"), tm.onset_night(start).cast("string").alias("night"),
        F.round(ids.step_km(F.col("value"), F.lit(" M ")), 9).alias("km"), F.round(ids.step_minutes(F.col("value"), F.lit("Sec"), start, start), 9).alias("minutes"),
    )


@query("raw_impulse", f"""SELECT row_hash, {rd("duration * greatest(0, least(1, (avg_hr - 60) / 130)) * 0.64 * exp(1.92 * greatest(0, least(1, (avg_hr - 60) / 130)))", 6)} AS load FROM wk WHERE duration <> 0""")
def raw_impulse(t: Tables) -> DataFrame:
    """SC-46: an impulse before it is rounded."""
    load = tr.raw_trimp(F.col("duration"), F.col("avg_hr"), F.lit(60.0), F.lit(190.0))
    return t.wk.filter("duration <> 0").select("row_hash", F.round(load, 6).alias("load"))


@query("ridge_weights", """, x AS (SELECT start_ts::DATE AS d, avg(value) FILTER (WHERE type = 'hrv') AS a, avg(value) FILTER (WHERE type = 'heart_rate') AS b FROM rec GROUP BY ALL), y AS (SELECT a, b FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n_days, round(covar_pop(a, b) * count(*) / (var_pop(a) * count(*) + 1), 4) AS coefficient, round(corr(a, b), 3) AS correlation, CASE WHEN covar_pop(a, b) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM y""")
def ridge_weights(t: Tables) -> DataFrame:
    """AG-29, AG-30, JN-13: how days felt, from one feature; with one, ridge has a closed form."""
    from .plans.calibration import fit

    mean = lambda kind, name: t.rec.filter(F.col("type") == kind).groupBy(F.to_date("start_ts").alias("date")).agg(F.avg("value").alias(name))
    found = fit(mean("hrv", "hrv"), mean("heart_rate", "perceived_readiness"))
    row = (found["n_days"], found["coefficients"]["hrv"], found["correlations"]["hrv"], found["suggested_weights"]["hrv"])
    return t.spark.createDataFrame([row], "n_days long, coefficient double, correlation double, weight double")


FIT_SQL = """, x AS (SELECT subject_id, start_ts::DATE AS d, avg(value) FILTER (WHERE type = 'hrv') / 100 AS a, avg(value) FILTER (WHERE type = 'step_count') / 100 AS b, avg(value) FILTER (WHERE type = 'active_energy') / 100 AS c, avg(value) FILTER (WHERE type = 'heart_rate') / 100 AS y FROM rec GROUP BY ALL),
k AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND y IS NOT NULL),
m AS (SELECT subject_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, corr(a, y) AS ra, corr(b, y) AS rb, corr(c, y) AS rc FROM k GROUP BY ALL),
q AS (SELECT subject_id, n, ma, mb, mc, my, ra, rb, rc, sum((a - ma) * (a - ma)) + 0.5 AS aa, sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (c - mc)) AS ac, sum((b - mb) * (b - mb)) + 0.5 AS bb, sum((b - mb) * (c - mc)) AS bc, sum((c - mc) * (c - mc)) + 0.5 AS cc,
  sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS bv, sum((c - mc) * (y - my)) AS cy FROM k JOIN m USING (subject_id) GROUP BY ALL),
t AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM q),
s AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (bv * cc - bc * cy) + ac * (bv * bc - bb * cy)) / det AS pa, (aa * (bv * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - bv * ac)) / det AS pb, (aa * (bb * cy - bv * bc) - ab * (ab * cy - bv * ac) + ay * (ab * bc - bb * ac)) / det AS pc FROM t),
w AS (SELECT *, greatest(pa, 0) + greatest(pb, 0) + greatest(pc, 0) AS every FROM s)
SELECT subject_id, n, round(pa, 6) AS a, round(pb, 6) AS b, round(pc, 6) AS c, round(my - pa * ma - pb * mb - pc * mc, 6) AS intercept,
  round(CASE WHEN every > 0 THEN greatest(pa, 0) / every ELSE 0 END, 6) AS weight_a, round(CASE WHEN every > 0 THEN greatest(pb, 0) / every ELSE 0 END, 6) AS weight_b, round(CASE WHEN every > 0 THEN greatest(pc, 0) / every ELSE 0 END, 6) AS weight_c,
  round(ra, 6) AS r_a, round(rb, 6) AS r_b, round(rc, 6) AS r_c FROM w WHERE n >= 4"""


@query("athletes_weights", FIT_SQL)
def athletes_weights(t: Tables) -> DataFrame:
    """AG-29, AG-30: weights of three features for every athlete at once; in SQL the normal equations by determinants."""
    from .plans.calibration import fit_by

    of = lambda kind: F.avg(F.when(F.col("type") == kind, F.col("value"))) / 100
    days = t.rec.groupBy("subject_id", F.to_date("start_ts").alias("d")).agg(of("hrv").alias("a"), of("step_count").alias("b"), of("active_energy").alias("c"), of("heart_rate").alias("y"))
    out = fit_by(days, ["subject_id"], ["a", "b", "c"], "y", 0.5)
    return out.select("subject_id", "n", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("subject_id", "n")))
