"""Recovery and readiness of all nights as queries, and the same in SQL, where arrays of trailing values are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ADAPTERS, LOAD_SQL, SQL, Tables, quantile_cte, query, rd, text
from .functions import identifiers as ids
from .functions import scores as sc
from .functions import times as tm

#: What the adapters' metrics stand for here.
KINDS = {"heart_rate": "heart_rate", "hrv": "hrv", "step_count": "respiratory_rate", "active_energy": "sleeping_wrist_temperature"}
NIGHT = "(start_ts + INTERVAL 6 HOUR)::DATE"
ASLEEP = "('asleep', 'core', 'deep', 'rem')"
LENGTH = "sum(date_diff('second', start_ts, end_ts))"

NIGHTS_SQL = f""", ni AS (SELECT subject_id, {NIGHT} AS night, {LENGTH} FILTER (WHERE stage IN {ASLEEP}) / 3600.0 AS hours, {LENGTH} FILTER (WHERE stage IN ('deep', 'rem')) / 3600.0 AS deep_rem,
  count(*) FILTER (WHERE stage = 'awake') AS awakenings, min(start_ts) AS bed FROM seg GROUP BY ALL),
bt AS (SELECT subject_id, night, CAST((hour(bed) * 60 + minute(bed) - 1080 + 1440) % 1440 AS DOUBLE) AS x FROM ni),
rg AS (SELECT a.subject_id, a.night, CASE WHEN count(*) >= 2 THEN stddev_samp(c.x) END AS reg FROM bt a JOIN bt c ON c.subject_id = a.subject_id AND c.night BETWEEN a.night - 14 AND a.night GROUP BY a.subject_id, a.night),
nw AS (SELECT subject_id, {NIGHT} AS night, min(start_ts) AS a, max(end_ts) AS b FROM seg WHERE stage IN ('asleep', 'core', 'deep', 'rem', 'in_bed') GROUP BY ALL),
nm AS (SELECT nw.subject_id, night, type, avg(value) AS v FROM nw JOIN rec ON rec.subject_id = nw.subject_id AND start_ts BETWEEN a AND b WHERE type IN ('hrv', 'step_count', 'active_energy') GROUP BY ALL),
sg AS (SELECT subject_id, {NIGHT} AS night, start_ts AS a, end_ts AS b, stage FROM seg WHERE stage IN ('core', 'deep', 'rem')),
sh AS (SELECT subject_id, night, sum(date_diff('second', a, b)) / 3600.0 AS asleep FROM sg GROUP BY ALL),
sx AS (SELECT sg.subject_id, night, start_ts, value FROM rec JOIN sg ON rec.subject_id = sg.subject_id AND start_ts >= a AND start_ts < b WHERE type = 'heart_rate'),
sw AS (SELECT subject_id, night, avg(value) OVER w AS m, count(*) OVER w AS n FROM sx WINDOW w AS (PARTITION BY subject_id, night ORDER BY start_ts RANGE BETWEEN CURRENT ROW AND INTERVAL 5 MINUTE FOLLOWING)),
sl AS (SELECT subject_id, night, min(m) AS low, count(*) AS windows FROM sw WHERE n >= 2 GROUP BY ALL),
fg AS (SELECT subject_id, {NIGHT} AS night, start_ts AS a, end_ts AS b FROM seg WHERE stage = 'asleep' AND (subject_id, {NIGHT}) NOT IN (SELECT subject_id, night FROM sg)),
fh AS (SELECT subject_id, night, sum(date_diff('second', a, b)) / 3600.0 AS asleep FROM fg GROUP BY ALL),
fp AS (SELECT fg.subject_id, night, quantile_cont(value, 0.05) AS low FROM rec JOIN fg ON rec.subject_id = fg.subject_id AND start_ts >= a AND start_ts < b WHERE type = 'heart_rate' GROUP BY ALL),
mt AS (SELECT subject_id, night, CASE type WHEN 'hrv' THEN 'hrv' WHEN 'step_count' THEN 'resp' ELSE 'temp' END AS m, v FROM nm UNION ALL
  SELECT subject_id, night, 'sleeping_hr', low FROM sh JOIN sl USING (subject_id, night) WHERE asleep >= 3 AND windows >= 5 UNION ALL
  SELECT subject_id, night, 'sleeping_hr', low FROM fh JOIN fp USING (subject_id, night) WHERE asleep >= 3 UNION ALL
  SELECT subject_id, night, 'hours', hours FROM ni WHERE hours IS NOT NULL),
bs AS (SELECT ni.subject_id, ni.night, m, mt.night AS dd, v FROM ni JOIN mt ON mt.subject_id = ni.subject_id AND mt.night BETWEEN ni.night - 28 AND ni.night - 1),
lg AS (SELECT subject_id, night, dd, ln(v) AS x FROM bs WHERE m = 'hrv' AND v > 0),
l7 AS (SELECT *, row_number() OVER w AS k, stddev_samp(x) OVER (w ROWS 6 PRECEDING) AS sd, avg(x) OVER (w ROWS 6 PRECEDING) AS mu FROM lg WINDOW w AS (PARTITION BY subject_id, night ORDER BY dd)),
cv AS (SELECT subject_id, night, 'hrv_cv' AS m, dd, sd / abs(mu) AS v FROM l7 WHERE k >= 7 AND mu <> 0),
al AS (SELECT subject_id, night, 'hrv' AS m, dd, x AS v FROM lg UNION ALL SELECT * FROM cv UNION ALL SELECT * FROM bs WHERE m IN ('sleeping_hr', 'resp', 'temp')),
tv AS (SELECT subject_id, night || ':' || m AS d, v, row_number() OVER (PARTITION BY subject_id, night, m ORDER BY dd) - 1 AS i, count(*) OVER (PARTITION BY subject_id, night, m) AS n FROM al),
m0 AS (SELECT subject_id, d, quantile_cont(v, 0.5) AS m FROM tv GROUP BY ALL),
d0 AS (SELECT subject_id, d, any_value(m) AS m, 1.4826 * quantile_cont(abs(v - m), 0.5) AS s FROM tv JOIN m0 USING (subject_id, d) GROUP BY ALL),
wv AS (SELECT subject_id, d, pow(pow(0.5, 1 / 14.0), n - 1 - i) AS w, CASE WHEN n >= 2 AND s > 0 THEN least(m + 3 * s, greatest(m - 3 * s, v)) ELSE v END AS v FROM tv JOIN d0 USING (subject_id, d)),
{quantile_cte("wv", "v", "ce")},
av AS (SELECT wv.subject_id, wv.d, w, abs(v - q) AS v FROM wv JOIN ce USING (subject_id, d)),
{quantile_cte("av", "v", "sa")},
rc AS (SELECT ni.subject_id, ni.night, avg(ln(v)) AS x, CASE WHEN count(*) >= 2 THEN stddev_samp(ln(v)) / nullif(abs(avg(ln(v))), 0) END AS c FROM ni JOIN mt ON mt.subject_id = ni.subject_id AND mt.night BETWEEN ni.night - 6 AND ni.night WHERE m = 'hrv' AND v > 0 GROUP BY ALL),
tz AS (SELECT subject_id, night, 'hrv' AS m, x FROM rc UNION ALL SELECT subject_id, night, 'hrv_cv', c FROM rc UNION ALL SELECT subject_id, night, m, v FROM mt WHERE m IN ('sleeping_hr', 'resp', 'temp')),
zs AS (SELECT tz.subject_id, night, m, (x - ce.q) / nullif(1.4826 * sa.q, 0) AS z FROM tz JOIN ce ON ce.subject_id = tz.subject_id AND ce.d = night || ':' || m JOIN sa ON sa.subject_id = tz.subject_id AND sa.d = night || ':' || m),
zw AS (SELECT subject_id, night, max(z) FILTER (WHERE m = 'hrv') AS hrv, max(z) FILTER (WHERE m = 'sleeping_hr') AS hr, max(z) FILTER (WHERE m = 'resp') AS resp, max(z) FILTER (WHERE m = 'temp') AS temp, max(z) FILTER (WHERE m = 'hrv_cv') AS cv FROM zs GROUP BY ALL),
sz AS (SELECT subject_id, night, count(*) FILTER (WHERE m = 'hrv') AS n_hrv, count(*) FILTER (WHERE m = 'sleeping_hr') AS n_hr, count(*) FILTER (WHERE m = 'resp') AS n_resp, count(*) FILTER (WHERE m = 'temp') AS n_temp, count(*) FILTER (WHERE m = 'hours') AS n_hours,
  quantile_cont(v, 0.5) FILTER (WHERE m = 'hours') AS typical FROM bs GROUP BY ALL),
cn AS (SELECT subject_id, night, count(*) AS n_cv FROM cv GROUP BY ALL),
sc AS (SELECT ni.*, reg, CASE WHEN n_hours >= 5 THEN greatest(6.5, least(9.0, typical)) ELSE 8.0 END AS need, zw.hrv AS z_hrv, hr AS z_hr, resp AS z_resp, temp AS z_temp,
  CASE WHEN zw.hrv IS NOT NULL THEN greatest(0, least(100, 50 + 16.6 * zw.hrv)) END AS s1, CASE WHEN hr IS NOT NULL THEN greatest(0, least(100, 50 - 18 * hr)) END AS s2,
  CASE WHEN resp IS NOT NULL THEN greatest(0, least(100, 50 - 18 * resp)) END AS s4, CASE WHEN temp IS NOT NULL THEN greatest(0, least(100, 100 - 36 * (greatest(temp, 0) + 0.5 * greatest(-temp, 0)))) END AS s5,
  CASE WHEN zw.cv IS NOT NULL THEN greatest(0, least(100, 50 + 18 * zw.cv)) END AS s6,
  least(1, coalesce(n_hrv, 0) / 10.0) AS c1, least(1, coalesce(n_hr, 0) / 10.0) AS c2, least(1, coalesce(n_hours, 0) / 10.0) AS c3, least(1, coalesce(n_resp, 0) / 10.0) AS c4, least(1, coalesce(n_temp, 0) / 10.0) AS c5, least(1, coalesce(n_cv, 0) / 10.0) AS c6
  FROM ni LEFT JOIN rg USING (subject_id, night) LEFT JOIN zw USING (subject_id, night) LEFT JOIN sz USING (subject_id, night) LEFT JOIN cn USING (subject_id, night)),
pt AS (SELECT *, CASE WHEN hours IS NOT NULL THEN greatest(0, least(100, CASE WHEN hours <= need THEN 100 - 20 * (need - hours) ELSE 100 - 10 * (hours - need) END)) END AS p1, CASE WHEN hours <> 0 AND deep_rem IS NOT NULL THEN greatest(0, least(100, 100 * (deep_rem / hours) / 0.45)) END AS p2,
  greatest(0, least(100, 100 - 8 * awakenings)) AS p3, CASE WHEN reg IS NOT NULL THEN greatest(0, least(100, 100 * (1 - reg / 90))) END AS p4 FROM sc),
s3 AS (SELECT *, {rd("(coalesce(p1 * 0.6, 0) + coalesce(p2 * 0.15, 0) + p3 * 0.15 + coalesce(p4 * 0.1, 0)) / (0.15 + CASE WHEN p1 IS NULL THEN 0 ELSE 0.6 END + CASE WHEN p2 IS NULL THEN 0 ELSE 0.15 END + CASE WHEN p4 IS NULL THEN 0 ELSE 0.1 END)", 1)} AS s3 FROM pt),
sv AS (SELECT s3.subject_id, s3.night, x.s, x.c, x.w FROM s3, LATERAL (VALUES (s1, c1, 0.40), (s2, c2, 0.20), (s3.s3, c3, 0.25), (s4, c4, 0.10), (s5, c5, 0.05), (s6, c6, 0.05)) x(s, c, w) WHERE x.s IS NOT NULL),
rv AS (SELECT subject_id, night, coalesce(sum(s * w * c) / nullif(sum(w * c), 0), sum(s * w) / sum(w)) AS score, sum(c * w) / sum(w) AS sure FROM sv GROUP BY ALL),
rr AS (SELECT s3.subject_id, s3.night, {rd("score", 1)} AS score, {rd("sure", 3)} AS confidence, {rd("(1 - sure) * 15", 1)} AS ci, z_hrv, z_hr, z_resp, z_temp, date_diff('day', min(s3.night) OVER (PARTITION BY s3.subject_id), s3.night) AS history FROM s3 LEFT JOIN rv ON rv.subject_id = s3.subject_id AND rv.night = s3.night)
"""
BAND = "CASE WHEN {0} >= 67 THEN 'green' WHEN {0} >= 34 THEN 'yellow' WHEN {0} IS NOT NULL THEN 'red' END"


def nights(t: Tables) -> DataFrame:
    from .plans.recovery import recovery

    return recovery(t.seg, t.rec.withColumn("type", ids.lookup(KINDS, F.col("type"))), ["subject_id"])


@query("recovery", NIGHTS_SQL + f"""SELECT subject_id, CAST(night AS VARCHAR) AS night, CASE WHEN score IS NULL THEN 'insufficient_data' WHEN history < 14 OR confidence < 0.8 THEN 'calibrating' ELSE 'ok' END AS state, score, {BAND.format("score")} AS band, confidence, ci,
  {rd("z_hrv", 3)} AS hrv_z, {rd("z_hr", 3)} AS sleeping_hr_z FROM rr""")
def recovery(t: Tables) -> DataFrame:
    """TL-14, SR-02..12: every night of every athlete at once."""
    z = [sc.settled(F.col(f"{m}_z"), 3).alias(f"{m}_z") for m in ("hrv", "sleeping_hr")]
    return text(nights(t).select("subject_id", "night", "state", "score", "band", "confidence", "ci", *z), "night")


READY_SQL = LOAD_SQL + NIGHTS_SQL + f""", cd AS (SELECT subject_id, day, sum(load) AS load FROM (SELECT subject_id, day, load FROM dl UNION ALL SELECT subject_id, night, 0.0 FROM ni) GROUP BY ALL),
ce2 AS (SELECT subject_id, min(day) AS a, max(day) AS b FROM cd GROUP BY ALL),
cg AS (SELECT subject_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ce2),
cf AS (SELECT cg.subject_id, cg.day, coalesce(load, 0) AS load FROM cg LEFT JOIN cd USING (subject_id, day)),
ra AS (SELECT *, sum(load) OVER (PARTITION BY subject_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ac, coalesce(sum(load) OVER (PARTITION BY subject_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND 7 PRECEDING) / 3.0, 0) AS ch FROM cf),
rb AS (SELECT subject_id, day, CASE WHEN ch > 0 THEN round(ac / ch, 2) END AS acwr FROM ra),
wl AS (SELECT subject_id, end_ts, coalesce(CASE WHEN duration <> 0 THEN round(duration * greatest(0, least(1, (avg_hr - 60) / 130)) * 0.64 * exp(1.92 * greatest(0, least(1, (avg_hr - 60) / 130))), 1) END, energy * 0.19) AS load FROM wk),
la AS (SELECT rr.subject_id, rr.night, max_by(load, (end_ts, load)) AS load, max(end_ts) AS ended FROM rr JOIN wl ON wl.subject_id = rr.subject_id AND end_ts <= CAST(rr.night + 1 AS TIMESTAMP) GROUP BY ALL),
ow AS (SELECT rr.*, acwr, CASE WHEN ended IS NULL THEN 0 ELSE greatest(0, least(48.0, load * 0.25) - greatest(0, epoch(CAST(rr.night AS TIMESTAMP) + INTERVAL 8 HOUR - ended) / 3600.0)) END AS owed,
  (coalesce({rd("z_temp", 2)}, 0) > 1)::INT + (coalesce({rd("z_resp", 2)}, 0) > 1)::INT + (coalesce({rd("z_hr", 2)}, 0) > 1)::INT + (coalesce({rd("z_hrv", 2)}, 0) < -1)::INT >= 2 AS ill
  FROM rr LEFT JOIN rb ON rb.subject_id = rr.subject_id AND rb.day = rr.night LEFT JOIN la ON la.subject_id = rr.subject_id AND la.night = rr.night),
pe AS (SELECT *, CASE WHEN score IS NOT NULL THEN least(CASE WHEN acwr IS NULL OR acwr <= 1.3 THEN 0 WHEN acwr <= 1.5 THEN (acwr - 1.3) * 30 ELSE (1.5 - 1.3) * 30 + (acwr - 1.5) * 40 END + owed * 0.6, 40.0) END AS pen FROM ow),
re AS (SELECT *, {rd("greatest(0, least(100, score - pen))", 1)} AS plain FROM pe),
rz AS (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN ill THEN least(plain, 66.0) ELSE plain END AS ready FROM re)
SELECT subject_id, CAST(night AS VARCHAR) AS night, ready AS readiness, {BAND.format("ready")} AS readiness_band, acwr, {rd("pen", 1)} AS penalty, {rd("owed", 1)} AS owed_h,
  CASE WHEN ready >= 67 THEN 'Ready for a hard session.' WHEN ready >= 34 THEN 'Moderate — keep it aerobic, hold off on a big effort.' WHEN ready IS NOT NULL THEN 'Prioritize rest and easy recovery.' ELSE 'Insufficient data to assess readiness.' END
  || CASE WHEN acwr > 1.5 THEN printf(' Training load is elevated (ACWR %.2f) — injury risk up.', acwr) ELSE '' END || CASE WHEN ill AND score IS NOT NULL THEN ' Elevated illness signals — RHR/temp/resp up, HRV down.' ELSE '' END AS recommendation FROM rz"""


@query("readiness", READY_SQL)
def readiness(t: Tables) -> DataFrame:
    """TL-15, SR-13, SR-15..17, SC-55."""
    from .plans.recovery import readiness as score

    known = t.rec.select("subject_id").distinct().withColumns({"hr_max": F.lit(190.0), "resting_hr": F.lit(60.0)})
    slept = t.seg.select("subject_id", tm.wake_day(F.col("start_ts")).alias("night")).distinct()
    out = score(nights(t), t.wk, t.rec, known, ["subject_id"], known_nights=slept)
    return text(out.select("subject_id", "night", "readiness", "readiness_band", "acwr", "penalty", "owed_h", "recommendation"), "night")


@query("streamed_recovery", SQL["recovery"].removeprefix(ADAPTERS))
def streamed_recovery(t: Tables) -> DataFrame:
    """SR-12, 2.12: the same nights scored as they come, in three batches of which the last is late."""
    from .plans.recovery import night_inputs
    from .sources.workspace import workspace
    from .streaming import nights as stream

    spark, folder = t.spark, workspace(t.spark, "nights")
    rows = stream.prepared(night_inputs(t.seg, t.rec.withColumn("type", ids.lookup(KINDS, F.col("type"))), ["subject_id"]), "subject_id")
    rows.write.parquet(f"{folder}/nights")
    rows, late = spark.read.parquet(f"{folder}/nights"), (F.col("day") % 9 == 4) & (F.col("athlete") < "5")
    middle = F.lit(19737)  # 15 January 2024
    for part in (~late & (F.col("day") < middle), ~late & (F.col("day") >= middle), late):
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        stream.start(spark, f"{folder}/landing", f"{folder}/scores", f"{folder}/checkpoint", "subject_id", t.seg.schema["subject_id"].dataType).awaitTermination()
    z = [sc.settled(F.col(f"{m}_z"), 3).alias(f"{m}_z") for m in ("hrv", "sleeping_hr")]
    return text(stream.scores(spark, f"{folder}/scores", "subject_id").select("subject_id", "night", "state", "score", "band", "confidence", "ci", *z), "night")
