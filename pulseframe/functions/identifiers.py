"""Names: metric types, sleep stages, sources, quantities. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTITY = "HKQuantityTypeIdentifier"
CATEGORY = "HKCategoryTypeIdentifier"
STAGE = "HKCategoryValueSleepAnalysis"
EVENT = "HKWorkoutEventType"

# The names that metrics have in the tables, by the exporter's identifier.
QUANTITIES = {
    "HKQuantityTypeIdentifierStepCount": "step_count",
    "HKQuantityTypeIdentifierHeartRate": "heart_rate",
    "HKQuantityTypeIdentifierRestingHeartRate": "resting_heart_rate",
    "HKQuantityTypeIdentifierWalkingHeartRateAverage": "walking_heart_rate_average",
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN": "hrv",
    "HKQuantityTypeIdentifierHeartRateRecoveryOneMinute": "heart_rate_recovery",
    "HKQuantityTypeIdentifierBodyMass": "weight",
    "HKQuantityTypeIdentifierBodyMassIndex": "bmi",
    "HKQuantityTypeIdentifierBodyFatPercentage": "body_fat_percentage",
    "HKQuantityTypeIdentifierLeanBodyMass": "lean_body_mass",
    "HKQuantityTypeIdentifierHeight": "height",
    "HKQuantityTypeIdentifierVO2Max": "vo2max",
    "HKQuantityTypeIdentifierActiveEnergyBurned": "active_energy",
    "HKQuantityTypeIdentifierBasalEnergyBurned": "basal_energy",
    "HKQuantityTypeIdentifierDistanceWalkingRunning": "distance_walking_running",
    "HKQuantityTypeIdentifierDistanceCycling": "distance_cycling",
    "HKQuantityTypeIdentifierDistanceSwimming": "distance_swimming",
    "HKQuantityTypeIdentifierFlightsClimbed": "flights_climbed",
    "HKQuantityTypeIdentifierAppleExerciseTime": "exercise_time",
    "HKQuantityTypeIdentifierAppleStandTime": "stand_time",
    "HKQuantityTypeIdentifierAppleWalkingSteadiness": "walking_steadiness",
    "HKQuantityTypeIdentifierRespiratoryRate": "respiratory_rate",
    "HKQuantityTypeIdentifierOxygenSaturation": "oxygen_saturation",
    "HKQuantityTypeIdentifierBloodPressureSystolic": "blood_pressure_systolic",
    "HKQuantityTypeIdentifierBloodPressureDiastolic": "blood_pressure_diastolic",
    "HKQuantityTypeIdentifierBloodGlucose": "blood_glucose",
    "HKQuantityTypeIdentifierBodyTemperature": "body_temperature",
    "HKQuantityTypeIdentifierAppleSleepingWristTemperature": "sleeping_wrist_temperature",
    "HKQuantityTypeIdentifierDietaryEnergyConsumed": "dietary_energy",
    "HKQuantityTypeIdentifierDietaryWater": "water",
}
CATEGORIES = {
    "HKCategoryTypeIdentifierSleepAnalysis": "sleep_analysis",
    "HKCategoryTypeIdentifierMindfulSession": "mindful_session",
    "HKCategoryTypeIdentifierAppleStandHour": "stand_hour",
}
# Prefixes that are stripped from other identifiers, the first that fits.
PREFIXES = (
    "HKQuantityTypeIdentifier",
    "HKCategoryTypeIdentifier",
    "HKDataTypeIdentifier",
    "HKCorrelationTypeIdentifier",
    "HKCharacteristicTypeIdentifier",
    "HKClinicalTypeIdentifier",
    "HKWorkoutActivityType",
)
# Sleep stages.
STAGES = {
    "HKCategoryValueSleepAnalysisInBed": "in_bed",
    "HKCategoryValueSleepAnalysisAsleep": "asleep",
    "HKCategoryValueSleepAnalysisAsleepUnspecified": "asleep",
    "HKCategoryValueSleepAnalysisAsleepCore": "core",
    "HKCategoryValueSleepAnalysisAsleepDeep": "deep",
    "HKCategoryValueSleepAnalysisAsleepREM": "rem",
    "HKCategoryValueSleepAnalysisAwake": "awake",
}
# Metrics that are summed over a period; others are averaged.
SUMMED = (
    "step_count", "active_energy", "basal_energy", "flights_climbed", "exercise_time", "stand_time", "dietary_energy", "water",
    "distance_walking_running", "distance_cycling", "distance_swimming",
)
# Minutes and kilometres in a unit.
MINUTES = {"min": 1.0, "mins": 1.0, "minute": 1.0, "minutes": 1.0} | dict.fromkeys(("s", "sec", "secs", "second", "seconds"), 1 / 60) | dict.fromkeys(("h", "hr", "hour", "hours"), 60.0)
KILOMETRES = {"km": 1.0, "m": 0.001, "mi": 1.609344, "ft": 0.0003048, "yd": 0.0009144}


def lookup(pairs: dict, key: Column) -> Column:
    """The value that ``pairs`` has for the key, else null."""
    literal = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    return F.try_element_at(literal, key)


def snake(name: Column) -> Column:
    """CamelCase to snake_case."""
    split = F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(split, "([a-z0-9])([A-Z])", "$1_$2"))


def metric_type(raw: Column) -> Column:
    aliases = QUANTITIES | CATEGORIES
    rest = F.regexp_replace(raw, f"^(?:{'|'.join(PREFIXES)})", "")
    plain = snake(F.when(rest == "", raw).otherwise(rest))
    return F.when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise(F.coalesce(lookup(aliases, raw), plain))


def sleep_stage(raw: Column) -> Column:
    plain = F.nullif(snake(F.replace(raw, F.lit(STAGE), F.lit(""))), F.lit(""))
    known = lookup(STAGES, raw)
    return F.when(F.coalesce(raw, F.lit("")) == "", "unknown").otherwise(F.coalesce(known, plain, F.lit("unknown")))


def event_type(raw: Column) -> Column:
    return F.nullif(snake(F.regexp_replace(raw, f"^{EVENT}", "")), F.lit(""))


def source_priority(source: Column) -> Column:
    """Higher wins where several devices report one window: watch, phone, tablet, the rest."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.when(low.contains("watch"), 30).when(low.contains("phone"), 20).when(low.contains("ipad"), 10).otherwise(5)


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?([Nn][Aa][Nn]|[Ii]nf(inity)?)\s*$"


def number(text: Column) -> Column:
    """A number, or null for anything else."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def quantity(text: Column) -> tuple[Column, Column]:
    """Number and unit of "262 cm"."""
    parts = F.split(F.trim(text), r"\s+", 2)
    return number(F.get(parts, F.lit(0))), F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))


def key_path(path: Column, at: int) -> Column:
    """A part of "block.repeat.slot" as an integer; junk is null."""
    return F.get(F.split(path, r"\."), F.lit(at)).try_cast("int")


def success(flag: Column) -> Column:
    return F.lower(F.trim(flag)).isin("1", "true", "yes")


def step_minutes(duration: Column, unit: Column, start: Column, end: Column) -> Column:
    """A step's minutes from its own quantity, else from its timestamps."""
    from .times import micros

    own = duration * lookup(MINUTES, F.lower(F.trim(F.coalesce(unit, F.lit("min")))))
    return F.coalesce(own, (micros(end) - micros(start)) / 6e7)


def step_km(distance: Column, unit: Column) -> Column:
    return distance * lookup(KILOMETRES, F.lower(F.trim(F.coalesce(unit, F.lit("km")))))


def batch_id(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_"), 1, 80)


def sorted_json(values: Column) -> Column:
    """A map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))
