"""Training formulas: pace, load, zones, drift. All are Column expressions."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Load for a kcal, and kcal of a day without training.
ENERGY_LOAD = 0.19
RESTING_KCAL = 400.0
# Shares of maximum heart rate where zones begin.
PERCENT_ZONES = (("Z1", 0.0), ("Z2", 0.6), ("Z3", 0.7), ("Z4", 0.8), ("Z5", 0.9))
# Named zones where the athlete has set none, and bpm where they begin.
NAMED_ZONES = (("recovery", 0.0), ("easy", 150.0), ("grey", 166.0), ("threshold", 178.0), ("vo2max", 187.0))
# What heart rates are believed from a calibration file, and defaults.
HR_MAX_RANGE, RESTING_RANGE = (120.0, 250.0), (25.0, 120.0)
HR_MAX, RESTING_HR = 190.0, 60.0


def settled(x: Column, digits: int) -> Column:
    """Rounded twice, so that the order of a sum doesn't decide about a half."""
    return F.round(F.round(x, 9), digits)


def scaled(x: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: the scaled number is, so most means that miss a half by an ulp go up with it."""
    return F.round(x * 10.0**digits) / 10.0**digits


def pace(speed_kmh: Column) -> Column:
    """Minutes a kilometre."""
    return F.when(speed_kmh > 0, scaled(60 / speed_kmh, 2))


def cadence(speed_kmh: Column, stride_m: Column) -> Column:
    """Steps a minute."""
    return F.when((speed_kmh != 0) & (stride_m > 0), scaled(speed_kmh * 1000 / 60 / stride_m, 1))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """``x`` within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def reserve(avg_hr: Column, rest: Column, hr_max: Column) -> Column:
    """Share of the heart-rate reserve, 0 to 1; null without a reserve."""
    return F.when(hr_max > rest, clamp((avg_hr - rest) / (hr_max - rest), 0.0, 1.0))


def raw_trimp(minutes: Column, avg_hr: Column, rest: Column, hr_max: Column) -> Column:
    x = reserve(avg_hr, rest, hr_max)
    return F.when(minutes != 0, minutes * x * 0.64 * F.exp(1.92 * x))


def trimp(minutes: Column, avg_hr: Column, rest: Column, hr_max: Column) -> Column:
    """Banister's training impulse; null where heart rate, reserve or duration is missing."""
    return F.round(raw_trimp(minutes, avg_hr, rest, hr_max), 1)


def drift(first: Column, second: Column) -> Column:
    """Percent by which the second half's ratio is above the first's."""
    return F.when(first != 0, settled((second - first) / first * 100, 1))


def percent_bounds(hr_max: float) -> list[tuple[str, float]]:
    return [(zone, hr_max * share) for zone, share in PERCENT_ZONES]


def named_bounds(path: str | None = None) -> list[tuple[str, float]]:
    """Zones and where they begin, from the athlete's JSON file if there is one.

    Bands are whole bpm, both ends included, in order and without gaps; the first is
    open below and the last above. Anything else raises ValueError.
    """
    if path is None:
        return list(NAMED_ZONES)
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except FileNotFoundError:
        return list(NAMED_ZONES)
    zones = found.get("zones") if isinstance(found, dict) else found
    if not isinstance(zones, list) or len(zones) < 2:
        raise ValueError(f"{path}: at least two zones are needed")
    out, before = [], None
    for at, zone in enumerate(zones):
        name, low, high = zone.get("name"), zone.get("min_bpm"), zone.get("max_bpm")
        if not isinstance(name, str) or not name.isidentifier() or not name.isascii() or name.startswith("_"):
            raise ValueError(f"{path}: a zone's name is a letter, then letters, digits and underscores")
        if (low is None) != (at == 0) or (high is None) != (at == len(zones) - 1):
            raise ValueError(f"{path}: the first zone has no min_bpm and the last no max_bpm")
        if any(x is not None and (isinstance(x, bool) or not isinstance(x, int)) for x in (low, high)):
            raise ValueError(f"{path}: bounds are whole numbers")
        if (at and low != before + 1) or (low is not None and high is not None and high < low) or name in [n for n, _ in out]:
            raise ValueError(f"{path}: zones must follow one another without gap or overlap")
        before = high
        out.append((name, 0.0 if low is None else float(low)))
    return out


def zone_of(bpm: Column, bounds: list[tuple[str, float]]) -> Column:
    """The zone that holds a heart rate; below all bounds the lowest."""
    ordered = sorted(bounds, key=lambda b: b[1])
    out = F.lit(ordered[0][0])
    for zone, begin in ordered[1:]:
        out = F.when(bpm >= begin, F.lit(zone)).otherwise(out)
    return F.when(bpm.isNotNull(), out)


def run_zone(avg_hr: Column) -> Column:
    """1 recovery to 5 maximum, by a run's average heart rate."""
    return F.when(avg_hr <= 149, 1).when(avg_hr <= 165, 2).when(avg_hr <= 177, 3).when(avg_hr <= 186, 4).otherwise(5)


def efficiency(metres_a_minute: Column, avg_hr: Column, rest: Column) -> Column:
    """Metres a minute for each beat above rest, times ten."""
    return F.try_divide(metres_a_minute, avg_hr - rest) * 10


def acwr_flag(ratio: Column, enough: Column) -> Column:
    return (
        F.when(~enough, "insufficient_history").when(ratio.isNull(), "no_load").when(ratio > 1.5, "elevated")
        .when(ratio < 0.8, "low").when(ratio <= 1.3, "sweet_spot").otherwise("moderate")
    )


def calibrated(reference: dict, keys: tuple[str, ...], bounds: tuple[float, float]) -> float | None:
    """The first plausible number under one of the keys."""
    for key in keys:
        value = reference.get(key)
        if not isinstance(value, bool) and isinstance(value, int | float) and math.isfinite(value) and bounds[0] <= value <= bounds[1]:
            return float(value)
    return None


def clock(minutes: Column) -> Column:
    """Minutes as m:ss."""
    whole = F.round(minutes * 60).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))
