"""Per-machine baselines and the three anomaly rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.schemas import MISSING_READING


def above_offset(reading: Column, baseline: Column, offset: Column) -> Column:
    return reading > baseline + offset


def above_threshold(reading: Column, threshold: Column) -> Column:
    return reading > threshold


def deviates(reading: Column, baseline: Column, share: Column) -> Column:
    """Relative deviation over ``share``; never for a baseline of 0."""
    relative = F.abs(reading - baseline) / F.when(baseline != 0, baseline)
    return F.coalesce(relative > share, F.lit(False))


def flag_readings(readings: DataFrame, baselines: DataFrame, strict_missing: bool = False) -> DataFrame:
    """Add ``is_temperature``, ``is_vibration`` and ``is_current``.

    A missing reading counts as -1, which deviates from any usual current; with
    ``strict_missing`` it never flags. Rows of a machine without a baseline never flag. The
    baseline table has one row per machine; Spark broadcasts it while its size allows and
    otherwise joins by shuffle.
    """
    joined = readings.join(baselines, "machine_id", "left")

    def value(name: str) -> Column:
        return F.col(name) if strict_missing else F.coalesce(F.col(name), F.lit(MISSING_READING))

    flags = {
        "is_temperature": above_offset(
            value("temperature_c"), F.col("baseline_temperature_c"), F.col("cascade_temperature_offset_c")
        ),
        "is_vibration": above_threshold(
            value("vibration_rms_mm_s"), F.col("cascade_vibration_threshold_mm_s")
        ),
        "is_current": deviates(
            value("current_a"), F.col("baseline_current_a"), F.col("cascade_current_deviation_pct")
        ),
    }
    return joined.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}).select(
        *readings.columns, *flags
    )
