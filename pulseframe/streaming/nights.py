"""Recovery as nights come: an athlete's last nights are state, so a new night is scored without reading its history.

A stream of nights (``recovery.night_inputs``) is grouped by athlete. State holds each athlete's
nights of twice the baseline's window and the first night ever seen. A night that arrives gets its
windows from there; one that comes late, or again, also gives those up to a window after it their windows
anew. Scoring itself is the batch operator's (``recovery.scored_nights``), on the rows of a micro-batch.
Nights that come later than state reaches back are left to a batch run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scores as sc
from ..functions.times import minutes_past_18
from ..plans import recovery

#: A night's numbers in the order in which state keeps them.
NUMBERS = ("bed", *recovery.METRICS, "hours_asleep", "deep_rem_h", "awakenings")
BED_DAYS = 14


def prepared(nights: DataFrame, by: str) -> DataFrame:
    """Nights as the stream takes them: the athlete as text, days as numbers."""
    return nights.select(F.col(by).cast("string").alias("athlete"), F.unix_date("night").alias("day"), minutes_past_18(F.col("bed_start")).cast("double").alias("bed"), *(F.col(n).cast("double").alias(n) for n in NUMBERS[1:]))


SCHEMA = T.StructType([T.StructField("athlete", T.StringType()), T.StructField("day", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in NUMBERS)])
_MANY = T.ArrayType(T.DoubleType())
OUT = T.StructType([*SCHEMA.fields, T.StructField("regularity", T.DoubleType()), *(T.StructField(f"{n}_base", _MANY) for n in (*recovery.METRICS, "hours")), T.StructField("hrv_recent", _MANY), T.StructField("history_days", T.IntegerType())])
STATE = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("days", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.ArrayType(_MANY))])


def windows(day: int, held: dict[int, list], first: int, cfg: sc.Scoring) -> dict:
    """What the nights held give to the night of ``day``."""
    at = {n: i for i, n in enumerate(NUMBERS)}

    def values(name: str, begin: int, end: int) -> list[float]:
        own = (held[d][at[name]] for d in sorted(held) if day + begin <= d <= day + end)
        return [v for v in own if v is not None]

    beds = values("bed", -BED_DAYS, 0)
    out = {f"{n}_base": values(n, -cfg.window_days, -1) for n in recovery.METRICS} | {"hours_base": values("hours_asleep", -cfg.window_days, -1)}
    return out | {"hrv_recent": values("hrv", 1 - max(cfg.smoothing_days, 1), 0), "regularity": float(np.std(beds, ddof=1)) if len(beds) >= 2 else None, "history_days": day - first}


def with_state(stream: DataFrame, cfg: sc.Scoring = sc.DEFAULT) -> DataFrame:
    """The nights that arrive, and those that they touch, with their windows."""

    def one(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, days, numbers = state.get if state.exists else (None, [], [])
        held, fresh, reach = dict(zip(days, map(list, numbers), strict=True)), set(), cfg.window_days
        # what was let go lies before this day; nothing was if the first night is later
        gone = max(days) - 2 * reach if days and first < max(days) - 2 * reach else None
        for frame in frames:
            for row in frame.itertuples(index=False):
                held[int(row.day)] = [None if pd.isna(v := getattr(row, n)) else float(v) for n in NUMBERS]
                fresh.add(int(row.day))
        first = min(fresh) if first is None else min(first, *fresh)
        horizon = max(held) - 2 * reach
        touched = [d for d in sorted(held) if any(0 <= d - f <= reach for f in fresh) and (gone is None or d - reach >= gone)]
        rows = [{"athlete": key[0], "day": d, **dict(zip(NUMBERS, held[d], strict=True)), **windows(d, held, first, cfg)} for d in touched]
        kept = [d for d in sorted(held) if d >= horizon]
        state.update((first, kept, [held[d] for d in kept]))
        yield pd.DataFrame(rows, columns=OUT.names)

    return stream.groupBy("athlete").applyInPandasWithState(one, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, landing: str, target: str, checkpoint: str, by: str, kind: T.DataType, cfg: sc.Scoring = sc.DEFAULT, files: int = 64) -> StreamingQuery:
    """Scores the nights in ``landing`` (Parquet, as ``prepared``) into ``target``, a folder for each micro-batch, and ends."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(landing)

    def each(rows: DataFrame, number: int) -> None:
        named = rows.select(F.col("athlete").cast(kind).alias(by), F.date_from_unix_date("day").alias("night"), *OUT.names[3:])
        named = named.withColumn("awakenings", F.col("awakenings").cast("long"))
        scored = recovery.scored_nights(named, [by], cfg)
        scored.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return with_state(stream, cfg).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores(spark: SparkSession, target: str, by: str) -> DataFrame:
    """Every night's newest score."""
    rows = spark.read.parquet(target)
    last = F.row_number().over(Window.partitionBy(by, "night").orderBy(F.desc("batch")))
    return rows.withColumn("_last", last).filter("_last = 1").drop("_last", "batch")
