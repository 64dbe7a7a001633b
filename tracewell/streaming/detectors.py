"""The three detectors over streaming records, giving the same match rows as in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schemas as S
from tracewell.operators import matches as M
from tracewell.plans.detection import CASCADE_STEPS, flagged_readings
from tracewell.sources.ingest import accepted, parse_heartbeats, parse_order_events
from tracewell.streaming.processors import OUTPUT, ArrivalFlowProcessor, DeadlineProcessor, GapProcessor, OrderFlowProcessor, SequenceProcessor

OUT_OF_ORDER = f"{S.OUT_OF_ORDER_MS // 1000} seconds"


def _machine_rows(rows: DataFrame, key: str, kind: Column, event_json: Column, delay: str | None, late: bool = False) -> DataFrame:
    shaped = rows.select(
        key,
        F.timestamp_millis("event_ms").alias("ts"),
        F.col("event_ms").alias("ms"),
        F.col("offset").alias("seq"),
        kind.alias("kind"),
        "event_time",
        event_json.alias("event_json"),
    )
    if delay is None:
        return shaped
    # Rows of no interest still move the watermark: this test uses the time column and therefore
    # stays above the watermark node instead of being pushed below it.
    held = shaped.withWatermark("ts", delay).filter(F.when(F.col("kind") != "", F.col("ts")).isNotNull())
    # Spark drops late rows by the time column; without it all of them reach the state machine.
    return held.drop("ts") if late else held


def _detect(rows: DataFrame, key: str, processor, time_mode: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"{key} string, {OUTPUT}",
        outputMode="Append",
        timeMode=time_mode,
    )


def stream_cascades(
    records: DataFrame,
    baselines: DataFrame,
    within_ms: int = S.CASCADE_WITHIN_MS,
    delay: str = OUT_OF_ORDER,
    strict_missing: bool = False,
) -> DataFrame:
    flagged = flagged_readings(records, baselines, strict_missing)
    kinds = F.concat_ws(",", *[F.when(F.col(f"is_{s}"), F.lit(s)) for s in CASCADE_STEPS])
    rows = _machine_rows(flagged, "machine_id", kinds, M.telemetry_json(), delay)
    processor = SequenceProcessor(["machine_id"], CASCADE_STEPS, within_ms)
    return _matches(_detect(rows, "machine_id", processor, "EventTime"), S.CASCADE, F.col("machine_id"))


def stream_missing_heartbeats(records: DataFrame, threshold_seconds: int = S.HEARTBEAT_GAP_SECONDS) -> DataFrame:
    beats = accepted(parse_heartbeats(records))
    rows = _machine_rows(beats, "machine_id", F.lit("beat"), M.heartbeat_json(), None)
    found = _detect(rows, "machine_id", GapProcessor(["machine_id"], threshold_seconds), "None")
    return _matches(found, S.HEARTBEAT, F.col("machine_id"))


def stream_order_violations(
    records: DataFrame,
    window_ms: int = S.ORDER_WINDOW_MS,
    delay: str = OUT_OF_ORDER,
    retain_ms: int | None = None,
    order_by: str = "event_time",
) -> DataFrame:
    """Broken order flows, the events of an order taken by event time or as they arrived (by offset).

    By arrival no row is too late; an order that nothing answers is unfulfilled once the watermark has passed
    its deadline. ``retain_ms`` forgets an order that long after its last event; by default never.
    """
    kinds = {"event_time": OrderFlowProcessor, "arrival": ArrivalFlowProcessor}
    events = accepted(parse_order_events(records))
    rows = _machine_rows(events, "order_id", F.col("event_type"), M.order_event_json(), delay, order_by == "arrival")
    processor = kinds[order_by](["order_id"], window_ms, retain_ms)
    found = _detect(rows, "order_id", processor, "EventTime")
    return _matches(found, S.ORDER_FLOW, F.lit(S.ORDER_FLOW_MACHINE))


def stream_step_deadlines(rows: DataFrame, key: str, deadlines: list[tuple[str, str, int]], delay: str = OUT_OF_ORDER) -> DataFrame:
    """Missed steps of ``rows`` (key, event_ms, offset, event_type, event_time, event_json): key, event_time, event_json, step
    and missing_step. Limits are in milliseconds."""
    wanted = sorted({name for step, following, _ in deadlines for name in (step, following)})
    kind = F.when(F.col("event_type").isin(wanted), F.col("event_type")).otherwise("")
    shaped = _machine_rows(rows, key, kind, F.col("event_json"), delay)
    found = _detect(shaped, key, DeadlineProcessor([key], deadlines), "EventTime")
    names = F.split("violation_type", ":")
    return found.select(
        key,
        F.col("detected_at").alias("event_time"),
        F.col("source_json")[0].alias("event_json"),
        names[0].alias("step"),
        names[1].alias("missing_step"),
    )


def _matches(found: DataFrame, pattern: str, machine: Column) -> DataFrame:
    return found.select(
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit(pattern).alias("pattern_name"),
        machine.alias("machine_id"),
        "detected_at",
        F.lit(S.DEFAULT_SEVERITY[pattern]).alias("severity"),
        "violation_type",
        "source_json",
    )


def distinct_stream(matches: DataFrame, within: str) -> DataFrame:
    """Matches that carry ``match_id`` and ``detected_ts``, repeats within the given time dropped."""
    return matches.withWatermark("detected_ts", within).dropDuplicatesWithinWatermark(["match_id"])
