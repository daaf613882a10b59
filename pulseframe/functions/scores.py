"""Recovery and readiness scores. All are Column expressions over one night's values.

A missing input gives a missing score; means are taken over the scores that are there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .training import clamp, settled


@dataclass(frozen=True)
class Scoring:
    """Points, weights, windows and switches."""

    k: float = 18.0
    k_hrv: float = 16.6
    weights: dict = field(default_factory=lambda: {"hrv": 0.40, "sleeping_hr": 0.20, "sleep": 0.25, "resp": 0.10, "temp": 0.05, "hrv_cv": 0.05})
    green: float = 67.0
    yellow: float = 34.0
    warm: float = 1.0
    cool: float = 0.5
    luteal_shift: float = 1.0
    need: float = 8.0
    need_min: float = 6.5
    need_max: float = 9.0
    need_samples: int = 5
    deep_rem_target: float = 0.45
    awakening: float = 8.0
    regularity_zero: float = 90.0
    sleep_weights: dict = field(default_factory=lambda: {"duration": 0.60, "deep_rem": 0.15, "awakenings": 0.15, "regularity": 0.10})
    duration_curve: bool = True
    under: float = 20.0
    over: float = 10.0
    sweet: float = 1.3
    elevated: float = 1.5
    ramp: float = 30.0
    steep: float = 40.0
    owed: float = 0.6
    penalty_cap: float = 40.0
    window_days: int = 28
    min_samples: int = 10
    min_history: int = 14
    ci_max: float = 15.0
    confident: float = 0.8
    robust: bool = True
    ewma: bool = True
    half_life: float = 14.0
    winsorize: bool = True
    winsor_k: float = 3.0
    smoothing_days: int = 7
    worthwhile: float = 0.5
    taper: bool = False
    taper_z: float = 2.0
    taper_factor: float = 0.5
    illness_z: float = 1.0
    illness_signals: int = 2
    illness_cap: float = 66.0


DEFAULT = Scoring()


def z_score(x: Column, center: Column, scale: Column) -> Column:
    return F.try_divide(x - center, F.nullif(scale, F.lit(0.0)))


def hrv_score(z: Column, cfg: Scoring = DEFAULT) -> Column:
    plain = 50 + cfg.k_hrv * z
    if not cfg.taper:
        return clamp(plain)
    return clamp(F.when(z > cfg.taper_z, 50 + cfg.k_hrv * (cfg.taper_z + (z - cfg.taper_z) * cfg.taper_factor)).otherwise(plain))


def higher_is_worse(z: Column, cfg: Scoring = DEFAULT) -> Column:
    """Sleeping heart rate and respiration."""
    return clamp(50 - cfg.k * z)


def higher_is_better(z: Column, cfg: Scoring = DEFAULT) -> Column:
    """Variability of heart-rate variability."""
    return clamp(50 + cfg.k * z)


def temperature_score(z: Column, luteal: Column | None = None, cfg: Scoring = DEFAULT) -> Column:
    if luteal is not None:
        z = z - F.when(luteal, cfg.luteal_shift).otherwise(0.0)
    return F.when(z.isNotNull(), clamp(100 - 2 * cfg.k * (cfg.warm * F.greatest(z, F.lit(0.0)) + cfg.cool * F.greatest(-z, F.lit(0.0)))))


def duration_score(hours: Column, need: Column, cfg: Scoring = DEFAULT) -> Column:
    if not cfg.duration_curve:
        return clamp(100 * hours / need)
    return clamp(F.when(hours <= need, 100 - cfg.under * (need - hours)).otherwise(100 - cfg.over * (hours - need)))


def sleep_need(median: Column, n: Column, cfg: Scoring = DEFAULT) -> Column:
    return F.when((n < cfg.need_samples) | median.isNull(), F.lit(cfg.need)).otherwise(F.greatest(F.lit(cfg.need_min), F.least(F.lit(cfg.need_max), median)))


def weighted_mean(scores: dict[str, Column], weights: dict[str, Column | float]) -> Column:
    """Over the scores that are not null; null if none is."""
    total = sum((F.when(s.isNotNull(), s * weights[k]).otherwise(0.0) for k, s in scores.items()), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), F.lit(1.0) * weights[k]).otherwise(0.0) for k, s in scores.items()), F.lit(0.0))
    return F.try_divide(total, F.nullif(weight, F.lit(0.0)))


def sleep_score(hours: Column, need: Column, deep_rem: Column, awakenings: Column, regularity: Column, cfg: Scoring = DEFAULT) -> Column:
    parts = {
        "duration": duration_score(hours, need, cfg),
        "deep_rem": clamp(100 * deep_rem / cfg.deep_rem_target),
        "awakenings": clamp(100 - awakenings * cfg.awakening),
        "regularity": clamp(100 * (1 - regularity / cfg.regularity_zero)),
    }
    return settled(weighted_mean(parts, cfg.sleep_weights), 1)


def band(score: Column, cfg: Scoring = DEFAULT) -> Column:
    return F.when(score >= cfg.green, "green").when(score >= cfg.yellow, "yellow").when(score.isNotNull(), "red")


def confidence(n: Column, cfg: Scoring = DEFAULT) -> Column:
    return F.least(F.lit(1.0), n / cfg.min_samples)


def recovery(scores: dict[str, Column], confidences: dict[str, Column], cfg: Scoring = DEFAULT) -> dict[str, Column]:
    """score, confidence and ci; weights shrink with confidence, unless all confidence is 0."""
    trusted = weighted_mean(scores, {k: cfg.weights[k] * confidences[k] for k in scores})
    score = settled(F.coalesce(trusted, weighted_mean(scores, cfg.weights)), 1)
    sure = weighted_mean({k: F.when(s.isNotNull(), confidences[k]) for k, s in scores.items()}, cfg.weights)
    return {"score": score, "confidence": settled(sure, 3), "ci": settled((1 - sure) * cfg.ci_max, 1)}


def load_penalty(acwr: Column, owed_hours: Column, cfg: Scoring = DEFAULT) -> Column:
    from_load = (
        F.when(acwr.isNull() | (acwr <= cfg.sweet), 0.0)
        .when(acwr <= cfg.elevated, (acwr - cfg.sweet) * cfg.ramp)
        .otherwise((cfg.elevated - cfg.sweet) * cfg.ramp + (acwr - cfg.elevated) * cfg.steep)
    )
    return F.least(from_load + F.coalesce(owed_hours, F.lit(0.0)) * cfg.owed, F.lit(cfg.penalty_cap))


# Signals of illness, and which way is worse.
ILLNESS = (("temp", 1), ("resp", 1), ("sleeping_hr", 1), ("hrv", -1))


def illness(z: dict[str, Column], cfg: Scoring = DEFAULT) -> dict[str, Column]:
    excess = {k: F.greatest(F.coalesce(sign * z[k] - cfg.illness_z, F.lit(0.0)), F.lit(0.0)) for k, sign in ILLNESS if k in z}
    count = sum(((e > 0).cast("int") for e in excess.values()), F.lit(0))
    fired = F.filter(F.array(*(F.when(e > 0, F.lit(k)) for k, e in excess.items())), lambda x: x.isNotNull())
    return {"count": count, "pressure": F.round(sum(excess.values(), F.lit(0.0)), 4), "triggered": count >= cfg.illness_signals, "signals": fired}


def readiness(score: Column, penalty: Column, triggered: Column, cfg: Scoring = DEFAULT) -> Column:
    plain = settled(clamp(score - penalty), 1)
    return F.when(triggered, F.least(plain, F.lit(cfg.illness_cap))).otherwise(plain)


def recommendation(of_band: Column, acwr: Column, triggered: Column, cfg: Scoring = DEFAULT) -> Column:
    # What is said to each band, to a high load and to signs of illness.
    text = (
        F.when(of_band == "green", "Ready for a hard session.")
        .when(of_band == "yellow", "Moderate — keep it aerobic, hold off on a big effort.")
        .when(of_band == "red", "Prioritize rest and easy recovery.")
        .otherwise("Insufficient data to assess readiness.")
    )
    high = F.when(acwr > cfg.elevated, F.format_string(" Training load is elevated (ACWR %.2f) — injury risk up.", acwr)).otherwise("")
    ill = F.when(triggered, " Elevated illness signals — RHR/temp/resp up, HRV down.").otherwise("")
    return F.concat(text, high, ill)


def change(z: Column, scale: Column, cfg: Scoring = DEFAULT) -> dict[str, Column]:
    """Smallest worthwhile change, and whether a day's is meaningful or significant."""
    known = z.isNotNull() & (scale != 0)
    return {
        "swc": F.when(known, cfg.worthwhile * scale),
        "meaningful": F.coalesce(known & (F.abs(z) >= cfg.worthwhile), F.lit(False)),
        "significant": F.coalesce(known & (F.abs(z) >= 1), F.lit(False)),
    }
