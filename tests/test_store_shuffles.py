"""What the store shuffles: a row once when it is compared, nothing of the table for a small batch, short hashes in a rebuild."""

import datetime as dt

from pyspark.sql import functions as F

from pulseframe.plans import maintenance
from pulseframe.sources import sink
from pulseframe.sources.sink import Store, hashed

T0 = dt.datetime(2024, 3, 1)


def readings(spark, rows):
    """(number, device) rows as records; the device isn't part of their hash."""
    schema = "n int, device string"
    null = [F.lit(None).cast("string").alias(c) for c in ("source_version", "value_str")]
    start = F.lit(T0) + F.make_dt_interval(mins=F.col("n"))
    return spark.createDataFrame(rows, schema).select(
        F.lit("hrv").alias("type"), F.lit("HRV").alias("raw_type"), F.lit("Watch").alias("source_name"), "device", F.lit("ms").alias("unit"), F.col("n").cast("double").alias("value"), *null,
        start.alias("start_ts"), start.alias("end_ts"), start.alias("created_ts"), F.lit(30).alias("source_priority"),
    )


def test_rows_and_known_keys_meet_in_one_shuffle(spark):
    table = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, n int, t string")
    batch = spark.createDataFrame([("a", 0, "z"), (None, 0, "z"), ("b", 3, None), ("b", None, "w"), ("c", None, None)], table.schema)
    got = sink.new_rows(batch, table, ["k"])
    assert sorted(map(tuple, got.collect())) == [("b", None, "w"), ("c", None, None)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_small_batch_meets_its_own_keys_only(spark, tmp_path, monkeypatch):
    store, seen, whole = Store(spark, f"file://{tmp_path}/store"), [], sink.new_rows
    store.ingest({"records": readings(spark, [(n, "d") for n in range(50)])})
    monkeypatch.setattr(sink, "new_rows", lambda batch, table, keys: seen.append(table.count()) or whole(batch, table, keys))
    assert store.ingest({"records": readings(spark, [(7, "d"), (60, "d")])}) == {"records": 1}
    monkeypatch.setattr(sink, "FEW_ROWS", 0)
    assert store.ingest({"records": readings(spark, [(8, "d"), (61, "d")])}) == {"records": 1}
    assert seen == [1, 51] and store.read("records").count() == 52


def test_a_rebuild_keeps_the_row_of_the_smallest_old_hash(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}/store"), [(n, d) for n in range(6) for d in ("one", "two")]
    made = hashed("records", readings(spark, rows))
    old = F.when(F.col("device") == "one", F.col("row_hash")).otherwise(F.concat(F.when(F.col("value") < 3, "!").otherwise("~"), F.col("value").cast("string")))
    store.add("records", made.withColumn("row_hash", old))
    assert maintenance.rebuild(store, "records", max_collapse=0.5) | {"against": []} == {"before": 12, "after": 6, "swapped": True, "against": []}
    left = store.read("records")
    assert {r.value: r.device for r in left.collect()} == {float(n): "two" if n < 3 else "one" for n in range(6)}
    assert sum(sink.verify(left, "records").values()) == 0
