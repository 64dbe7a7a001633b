"""Records to matches: the three detectors over bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schemas as S
from tracewell.operators import matches as M
from tracewell.operators.baselines import flag_readings
from tracewell.operators.gaps import signal_gaps
from tracewell.operators.orderflow import flow_violations
from tracewell.operators.sequence import match_sequence
from tracewell.sources.ingest import accepted, parse_heartbeats, parse_order_events, parse_telemetry

CASCADE_STEPS = ["temperature", "vibration", "current"]


def flagged_readings(records: DataFrame, baselines: DataFrame, strict_missing: bool) -> DataFrame:
    """Accepted telemetry with its anomaly flags; ``strict_missing`` leaves an absent reading unflagged."""
    readings = accepted(parse_telemetry(records))
    if strict_missing:
        known = ["temperature_c", "vibration_rms_mm_s", "current_a"]
        readings = readings.withColumns({c: F.col("sensors")[c] for c in known})
    return flag_readings(readings, baselines, strict_missing)


def cascades(
    records: DataFrame,
    baselines: DataFrame,
    within_ms: int = S.CASCADE_WITHIN_MS,
    strict_missing: bool = False,
    **options,
) -> DataFrame:
    """Temperature, then vibration, then current anomaly on one machine within ten minutes."""
    flagged = flagged_readings(records, baselines, strict_missing).withColumn("event_json", M.telemetry_json())
    sequences = match_sequence(
        flagged,
        ["machine_id"],
        ["event_ms", "offset"],
        [(s, F.col(f"is_{s}")) for s in CASCADE_STEPS],
        within_ms,
        carry=["event_time", "event_json"],
        **options,
    )
    return M.cascade_matches(sequences, CASCADE_STEPS)


def missing_heartbeats(
    records: DataFrame, threshold_seconds: int = S.HEARTBEAT_GAP_SECONDS, order_by: str = "arrival", **options
) -> DataFrame:
    """Gaps in arrival order, or in event-time order."""
    beats = accepted(parse_heartbeats(records)).withColumn("event_json", M.heartbeat_json())
    order = {"arrival": ["offset"], "event_time": ["event_ms", "offset"]}[order_by]
    gaps = signal_gaps(
        beats, ["machine_id"], order, "event_ms", threshold_seconds, carry=["event_json"], **options
    )
    return M.heartbeat_matches(gaps)


def order_violations(
    records: DataFrame,
    window_ms: int = S.ORDER_WINDOW_MS,
    as_of: Column | int | None = None,
    order_by: str = "event_time",
    **options,
) -> DataFrame:
    """Broken order flows, the events of an order taken by event time or as they arrived.

    Deadlines are measured in event time either way.
    """
    order = {"arrival": ["offset"], "event_time": ["event_ms", "offset"]}[order_by]
    events = accepted(parse_order_events(records)).withColumn("event_json", M.order_event_json())
    found = flow_violations(
        events,
        ["order_id"],
        order,
        "event_type",
        window_ms,
        as_of,
        carry=["event_time", "event_json"],
        clock="event_ms",
        **options,
    )
    return M.order_flow_matches(found)
