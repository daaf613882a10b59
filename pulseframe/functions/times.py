"""Time: instants to days, nights, buckets and texts. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970; differences count second boundaries."""
    return F.unix_seconds(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def wake_day(ts: Column) -> Column:
    """The day one wakes on: days run from 18:00 to 18:00. Filter and group by this same expression."""
    return F.to_date(ts + F.expr("INTERVAL 6 HOURS"))


def onset_night(ts: Column) -> Column:
    """The same day told from the hour of onset; differs from wake_day only where clocks change."""
    return F.when(F.hour(ts) < 18, F.to_date(ts)).otherwise(F.date_add(F.to_date(ts), 1))


def week(day: Column) -> Column:
    """Monday of the day's week."""
    return F.to_date(F.date_trunc("week", day))


def in_days(ts: Column, first: str | None = None, last: str | None = None) -> Column:
    """From the first day's start to before the day after the last; either may be open."""
    out = F.lit(True)
    if first is not None:
        out = out & (ts >= F.to_timestamp(F.lit(first)))
    if last is not None:
        out = out & (ts < F.to_timestamp(F.lit(last)) + F.expr("INTERVAL 1 DAY"))
    return out


def bucket_offset(ts: Column, origin: Column, width: int) -> Column:
    """Seconds from ``origin`` to the start of the bucket of ``width`` seconds that holds ``ts``."""
    width = max(1, int(width))
    return (F.floor((micros(ts) - micros(origin)) / F.lit(width * 1e6)) * width).cast("long")


def utc_second(ts: Column) -> Column:
    """An instant as UTC text to the second, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def exported(text: Column) -> Column:
    """An instant from ``YYYY-MM-DD HH:MM:SS +HHMM`` or ISO 8601 text, else null."""
    dated = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), text)  # no "yesterday"
    return F.coalesce(F.try_to_timestamp(dated, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(dated))


def wired(text: Column) -> Column:
    """An instant with a stated offset, to the second; without offset null."""
    return F.date_trunc("second", F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$"), exported(text)))


def bed_hours(ts: Column) -> Column:
    """Clock time of going to bed in hours, evening before midnight as negative."""
    t = F.hour(ts) + F.minute(ts) / 60
    return F.when(t > 18, t - 24).otherwise(t)


def minutes_past_18(ts: Column) -> Column:
    return F.pmod(F.hour(ts) * 60 + F.minute(ts) - 1080, F.lit(1440))


def midpoint(start: Column, end: Column) -> Column:
    return F.timestamp_micros(((micros(start) + micros(end)) / 2).cast("long"))
