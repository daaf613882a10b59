"""The store's commits, compaction, retries and rebuilds as queries over the driver's events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import LOAD_SQL, Tables, identity_sql, query, text
from .catalog_imports import METRICS, joined, wire
from .functions import identifiers as ids
from .plans import maintenance
from .plans.maintained import Maintained, changed_days
from .sources.commits import Conflict
from .sources.sink import Store, verify
from .sources.workspace import workspace
from .streaming import delta


def readings(t: Tables) -> DataFrame:
    """Events as records come from a source, with the event's number."""
    start = F.col("start_ts").cast("timestamp")
    null = [F.lit(None).cast("string").alias(c) for c in ("source_version", "device", "value_str")]
    return t.rec.select(
        F.col("row_hash").alias("event"), "type", joined(ids.QUANTITY, ids.lookup(METRICS, F.col("type"))).alias("raw_type"), "source_name", "unit", "value", *null,
        start.alias("start_ts"), start.alias("end_ts"), start.alias("created_ts"), "source_priority",
    )


@query("twenty_deltas", f""", d AS (SELECT type, {identity_sql()} AS h FROM rec) SELECT type, count(DISTINCT h) AS n, CAST(20 AS BIGINT) AS imports, CAST(1 AS BIGINT) AS folders, (SELECT count(DISTINCT h) FROM d) AS last_total, CAST(0 AS BIGINT) AS wrong FROM d GROUP BY type""")
def twenty_deltas(t: Tables) -> DataFrame:
    """SNK-01, SNK-03, SNK-05: twenty overlapping imports, one commit each; then their folders are merged and the old ones removed."""
    store, rows = Store(t.spark, f"{workspace(t.spark, 'twenty')}/store"), readings(t)
    for i in range(20):
        part = F.col("event") % 20
        store.ingest({"records": rows.filter((part == i) | (part == (i + 1) % 20)).drop("event")}, f"delta-{i}")
    store.compact(most=4)
    store.vacuum()
    state = store.state()
    told = store.read("import_runs", state).agg(F.count(F.lit(1)).alias("imports"), F.max("records_total").alias("last_total")).first()
    wrong = sum(verify(store.read("records", state), "records").values())
    return store.read("records", state).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(
        "type", "n", F.lit(told["imports"]).cast("long").alias("imports"), F.lit(len(store.files.names(store.path("records")))).cast("long").alias("folders"), F.lit(told["last_total"]).cast("long").alias("last_total"), F.lit(wrong).cast("long").alias("wrong")
    )


@query("retried_batches", f""", d AS (SELECT DISTINCT {identity_sql()} AS h, type, row_hash % 3 AS part FROM rec)
SELECT type AS what, count(DISTINCT h) AS n FROM d GROUP BY type UNION ALL SELECT 'before the retry', count(DISTINCT h) FROM d WHERE part != 1 UNION ALL SELECT 'failed', 0 UNION ALL SELECT 'retried', 1 UNION ALL SELECT 'tries', 2 UNION ALL SELECT 'added again', 0""")
def retried_batches(t: Tables) -> DataFrame:
    """SNK-06, TL-22: of three batches in order of arrival the second is refused, kept, taken up again, and each row counts once."""
    spark, folder = t.spark, workspace(t.spark, "retries")
    store, start = Store(spark, f"{folder}/store"), wire(F.col("start_ts").cast("timestamp"))
    line = F.to_json(F.struct(F.lit("record").alias("kind"), joined(ids.QUANTITY, ids.lookup(METRICS, F.col("type"))).alias("raw_type"), "source_name", "unit", "value", start.alias("start"), start.alias("end")))

    def refuse(frame: DataFrame, number: int) -> None:
        if number == 1:
            raise ValueError("not in order")

    for part in range(3):  # however many files a part is, they are one batch
        t.rec.filter(F.col("row_hash") % 3 == part).select(line.alias("value")).write.mode("append").option("compression", "gzip").text(f"{folder}/landing")
        delta.start(spark, f"{folder}/landing", store, f"{folder}/checkpoint", accept=refuse, files=100_000).awaitTermination()
    before = store.rows("records")
    delta.retry_failed(store)
    again = delta.retry_failed(store)
    states = {r["state"]: r for r in delta.batch_states(store).collect()}
    told = [("before the retry", before), ("failed", int("failed" in states)), ("retried", int("retried" in states)), ("tries", states["retried"]["tries"]), ("added again", sum(sum(a.values()) for a in again.values()))]
    counted = store.read("records").groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(spark.createDataFrame(told, "what string, n long"))


@query("rebuilt_store", f""", d AS (SELECT DISTINCT {identity_sql()} AS h FROM rec), x AS (SELECT count(*) AS n FROM d)
SELECT 'sound' AS what, true AS swapped, n AS before, n AS after FROM x UNION ALL SELECT 'collapsing', false, 2 * n, n FROM x UNION ALL SELECT 'changed meanwhile', false, 2 * n, n FROM x UNION ALL SELECT 'allowed', true, 2 * n + 1, n + 1 FROM x""")
def rebuilt_store(t: Tables) -> DataFrame:
    """MG-01, MG-03: a rebuild that passes its gates, one whose rows collapse, one whose table changed, and one that is let pass."""
    spark = t.spark
    store, rows, out = Store(spark, f"{workspace(spark, 'rebuild')}/store"), readings(t).drop("event"), []
    store.ingest({"records": rows}, "export")
    told = lambda what, r: out.append((what, r["swapped"], r["before"], r["after"]))
    told("sound", maintenance.rebuild(store, "records"))
    store.add("records", store.read("records").withColumn("row_hash", F.md5("row_hash")))  # every reading again, under hashes of another make
    told("collapsing", maintenance.rebuild(store, "records"))
    more, swap = rows.limit(1).withColumns({"source_name": F.lit("Another"), "source_priority": F.lit(5)}), store.replace

    def late(*args) -> None:
        Store(spark, store.root).ingest({"records": more}, "meanwhile")
        swap(*args)

    store.replace = late
    try:
        told("changed meanwhile", maintenance.rebuild(store, "records", max_collapse=0.6))
    finally:
        del store.replace
    told("allowed", maintenance.rebuild(store, "records", max_collapse=0.6))
    assert not sum(verify(store.read("records"), "records").values())
    return spark.createDataFrame(out, "what string, swapped boolean, before long, after long")


@query("all_or_nothing", """SELECT 'torn' AS what, CAST(0 AS BIGINT) AS records, CAST(0 AS BIGINT) AS sleep, CAST(0 AS BIGINT) AS version UNION ALL
SELECT 'whole', (SELECT count(DISTINCT """ + identity_sql() + """) FROM rec), (SELECT count(DISTINCT (start_ts, end_ts, stage)) FROM seg), 1 UNION ALL
SELECT 'of the first commit', (SELECT count(DISTINCT """ + identity_sql() + """) FROM rec), (SELECT count(DISTINCT (start_ts, end_ts, stage)) FROM seg), 1""")
def all_or_nothing(t: Tables) -> DataFrame:
    """SNK-03: an import that breaks in its second table shows none of its first; a reader keeps the commit that it opened."""
    spark = t.spark
    store, rows = Store(spark, f"{workspace(spark, 'commit')}/store"), readings(t).drop("event")
    stamp = {c: F.col(c).cast("timestamp") for c in ("start_ts", "end_ts")}
    sleep = t.seg.select(F.lit("Watch").alias("source_name"), F.lit(None).cast("string").alias("device"), "stage", F.col("stage").alias("raw_value"), *(c.alias(n) for n, c in stamp.items()))
    out = []
    told = lambda what, state: out.append((what, store.read("records", state).count(), store.read("sleep", state).count(), state["version"]))
    try:
        store.ingest({"records": rows, "sleep": sleep.withColumn("stage", F.raise_error(F.lit("torn")).cast("string"))}, "torn")
    except Conflict:
        raise
    except Exception as why:
        assert "torn" in str(why), why
    told("torn", store.state())
    store.ingest({"records": rows, "sleep": sleep}, "whole")
    first = store.state()
    told("whole", first)
    store.ingest({"records": rows.withColumn("source_name", F.lit("Another"))}, "more")
    told("of the first commit", first)
    return spark.createDataFrame(out, "what string, records long, sleep long, version long")


SERIES_SQL = LOAD_SQL + """, st AS (SELECT subject_id, min(start_ts)::DATE AS start FROM (SELECT subject_id, start_ts FROM rec WHERE type = 'active_energy' UNION ALL SELECT subject_id, start_ts FROM wk) GROUP BY ALL),
ra AS (SELECT *, sum(load) OVER (PARTITION BY subject_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ac, coalesce(sum(load) OVER (PARTITION BY subject_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND 7 PRECEDING) / 3.0, 0) AS ch FROM fl),
rb AS (SELECT ra.*, CASE WHEN ch > 0 THEN round(ac / ch, 2) END AS r, date_diff('day', start, day) >= 27 AS enough FROM ra JOIN st USING (subject_id)),
nb AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY day) AS i FROM fl),
wt AS (SELECT b.subject_id, b.day, a.load, pow(6.0 / 7, b.i - a.i) / 7 AS wa, pow(41.0 / 42, b.i - a.i) / 42 AS wc FROM nb b JOIN nb a ON a.subject_id = b.subject_id AND a.i <= b.i),
ff AS (SELECT subject_id, day, round(sum(load * wa), 1) AS atl, round(sum(load * wc), 1) AS ctl, round(sum(load * wc) - sum(load * wa), 1) AS tsb FROM wt GROUP BY ALL)
SELECT subject_id, CAST(day AS VARCHAR) AS day, round(ac, 1) AS acute_7d, round(ch, 1) AS chronic_28d_weekly, r AS acwr, CASE WHEN NOT enough THEN 'insufficient_history' WHEN r IS NULL THEN 'no_load' WHEN r > 1.5 THEN 'elevated' WHEN r < 0.8 THEN 'low' WHEN r <= 1.3 THEN 'sweet_spot' ELSE 'moderate' END AS flag, atl, ctl, tsb
FROM rb JOIN ff USING (subject_id, day)"""


def late_rows():
    """Some athletes' rows of a few days, which come after all others."""
    return (F.col("row_hash") % 1_000_000_000 % 7 == 3) & (F.col("subject_id") < 3) & F.to_date("start_ts").between("2024-01-09", "2024-01-11")


@query("late_delta", SERIES_SQL)
def late_delta(t: Tables) -> DataFrame:
    """2.12 late data: load, workload ratio and fitness after a delta that came late, of which only the touched parts were computed again."""
    known = t.rec.select("subject_id").distinct().withColumns({"hr_max": F.lit(190.0), "resting_hr": F.lit(60.0)})
    kept = Maintained(t.spark, f"{workspace(t.spark, 'late')}/kept", ["subject_id"], block=8, shards=4)
    kept.update(t.wk.filter(~late_rows()), t.rec.filter(~late_rows()), known)
    kept.update(t.wk, t.rec, known, changed_days(t.wk.filter(late_rows()), t.rec.filter(late_rows()), ["subject_id"]))
    return text(kept.series(), "day")
