"""Delta batches as a stream: files land in a folder, each is imported once, all is idempotent.

There is no watermark: late samples are never dropped, since every analysis starts from
the tables. What makes a redelivered batch harmless is the row hash, not the stream's
memory; the checkpoint only saves reading files again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ndjson import LINE, delta_frames, options, rejected
from ..sources.sink import Store


#: Faults of a batch's own rows, which another try doesn't mend; anything else (a full disk, a lost store) stops the stream.
DATA_FAULTS = (ValueError, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, SparkRuntimeException)


def import_batch(store: Store, lines: DataFrame, batch_id: int, subject: str = "", run: str = "") -> dict[str, int]:
    """One micro-batch: good lines to the tables in one commit, bad ones to ``rejected``.

    ``run`` names the stream; a batch that the stream repeats adds nothing and replaces what it set aside.
    """
    # a gzip file is read by one task; what is done with its lines is dealt out
    held = lines.repartition(2 * lines.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        bad = rejected(held)
        if bad.limit(1).count():
            bad.write.mode("overwrite" if run else "append").parquet(f"{store.path('rejected')}/run={run}-{batch_id}")
        return store.ingest(delta_frames(held), f"delta-{batch_id}", subject, (run, batch_id) if run else None)
    finally:
        held.unpersist()


def start(spark: SparkSession, landing: str, store: Store, checkpoint: str, subject: str = "", archive: str | None = None, once: bool = True, accept: Callable[[DataFrame, int], None] | None = None, files: int = 64) -> StreamingQuery:
    """Imports what is in ``landing``, oldest files first; with ``once`` it ends when that is done, else it goes on.

    A batch whose rows can't be imported, or that ``accept`` refuses with a ValueError, is kept whole in ``failed`` with
    the reason, and the rest goes on; ``retry_failed`` takes it up again. Other errors stop the stream, which repeats the batch.
    """
    reader = options(spark.readStream.format("json")).option("maxFilesPerTrigger", files)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = reader.load(landing)

    def each(frame: DataFrame, number: int) -> None:
        query = frame.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run = query or checkpoint.rstrip("/").rpartition("/")[2]
        try:
            if accept is not None:
                accept(frame, number)
            import_batch(store, frame, number, subject, run)
        except DATA_FAULTS as why:
            set_aside(store, frame, f"{run}-{number}", why)

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def set_aside(store: Store, lines: DataFrame, run: str, why: Exception) -> None:
    """Keeps a batch whole in ``failed``."""
    lines.write.mode("overwrite").parquet(f"{store.path('failed')}/run={run}")
    note_attempt(store, run, why)


def note_attempt(store: Store, run: str, why: Exception | None = None) -> None:
    row = store.spark.createDataFrame([(run, f"{type(why).__name__}: {why}"[:500] if why else None)], "batch string, failure string")
    row.withColumn("tried_at", F.current_timestamp()).write.mode("append").parquet(store.path("attempts"))


def kept_batches(store: Store, state: str) -> list[str]:
    """Names of batches in ``failed`` or ``retried``, in the order in which they came."""
    names = [n.removeprefix("run=") for n in store.files.names(store.path(state)) if n.startswith("run=")]
    return sorted(names, key=lambda n: (n.rpartition("-")[0], int(n.rpartition("-")[2])))


def retry_failed(store: Store, subject: str = "", accept: Callable[[DataFrame, int], None] | None = None) -> dict[str, dict[str, int]]:
    """Takes up the batches in ``failed`` once more, oldest first; rows added, by batch and table.

    One that succeeds moves to ``retried``, one that fails again stays; either way the attempt is noted. Rows are
    known by their hash, so what of a batch has come in otherwise meanwhile isn't added twice.
    """
    done: dict[str, dict[str, int]] = {}
    for run in kept_batches(store, "failed"):
        folder, number = f"{store.path('failed')}/run={run}", int(run.rpartition("-")[2])
        lines = store.spark.read.schema(LINE).parquet(folder)
        try:
            if accept is not None:
                accept(lines, number)
            done[run] = import_batch(store, lines, number, subject, f"{run}-again")
        except DATA_FAULTS as why:
            note_attempt(store, run, why)
            continue
        note_attempt(store, run)
        store.files.rename(folder, f"{store.path('retried')}/run={run}")
    return done


def batch_states(store: Store) -> DataFrame:
    """(batch, state, tries, failure) of every batch that ever failed: failed or retried, and its newest reason."""
    schema = "batch string, state string"
    rows = [(run, state) for state in ("failed", "retried") for run in kept_batches(store, state)]
    states = store.spark.createDataFrame(rows, schema)
    if not rows:
        return states.selectExpr("batch", "state", "0L AS tries", "CAST(NULL AS STRING) AS failure")
    tried = store.spark.read.parquet(store.path("attempts")).groupBy("batch").agg(F.count(F.lit(1)).alias("tries"), F.max_by("failure", F.when(F.col("failure").isNotNull(), F.col("tried_at"))).alias("failure"))
    return states.join(tried, "batch").select("batch", "state", "tries", "failure")


def import_pending(spark: SparkSession, landing: str, store: Store, checkpoint: str, wait_seconds: float = 0.0, poll: float = 2.0, most: float = 300.0, subject: str = "") -> dict:
    """Imports what has landed; if nothing has, looks again every ``poll`` seconds, for ``wait_seconds`` at most.

    Rows that came and batches that failed, of this call. An import that takes longer than ``most`` seconds goes on by itself.
    """
    deadline = time.monotonic() + max(0.0, wait_seconds)
    before = failed_batches(store)
    while True:
        query = start(spark, landing, store, checkpoint, subject)
        if not query.awaitTermination(most):
            return {"state": "still importing", "rows": 0, "failed": 0}
        rows = sum(p["numInputRows"] for p in query.recentProgress)
        if rows or time.monotonic() >= deadline:
            return {"state": "imported" if rows else "nothing has arrived", "rows": rows, "failed": failed_batches(store) - before}
        time.sleep(min(poll, max(0.0, deadline - time.monotonic())))


def failed_batches(store: Store) -> int:
    return len(kept_batches(store, "failed"))


def diagnostics(store: Store) -> dict:
    """What was set aside: bad lines by reason, failed batches with theirs, and what to do about it."""
    out: dict = {"rejected": {}, "failed": {}, "notes": []}
    if store._exists("rejected"):
        out["rejected"] = {r["reason"]: r["n"] for r in store.spark.read.parquet(store.path("rejected")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    out["failed"] = {r["batch"]: r["failure"] for r in batch_states(store).filter("state = 'failed'").collect()}
    if out["rejected"]:
        out["notes"].append(f"{sum(out['rejected'].values())} lines could not be taken")
    if out["failed"]:
        out["notes"].append(f"{len(out['failed'])} batches failed and are kept in {store.path('failed')}; retry_failed takes them up again")
    if not store.read("import_runs").filter(F.col("archive_name").startswith("delta")).limit(1).count():
        out["notes"].append("no delta has been imported yet")
    return out
