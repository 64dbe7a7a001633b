"""Pattern matches in their common form.

A match row has ``schema_version, pattern_name, machine_id, detected_at, severity,
violation_type`` and ``source_json``, the source events as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schemas as S
from tracewell.functions.text import identity, sentence


def _match(pattern: str, machine: Column, detected_at: Column, events: Column, violation: Column | None = None):
    return [
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.lit(pattern).alias("pattern_name"),
        machine.alias("machine_id"),
        detected_at.alias("detected_at"),
        F.lit(S.DEFAULT_SEVERITY[pattern]).alias("severity"),
        (F.lit(None).cast("string") if violation is None else violation).alias("violation_type"),
        events.alias("source_json"),
    ]


def telemetry_json() -> Column:
    """The event as it came, or rebuilt from the typed columns where the text is not JSON."""
    rebuilt = F.to_json(
        F.struct(
            "machine_id",
            "event_time",
            F.struct("temperature_c", "vibration_rms_mm_s", "current_a").alias("sensors"),
        )
    )
    return F.when(F.try_parse_json("raw_json").isNotNull(), F.col("raw_json")).otherwise(rebuilt)


def heartbeat_json() -> Column:
    rebuilt = F.to_json(
        F.struct("machine_id", "event_time", F.lit("heartbeat").alias("event_type"), "sequence")
    )
    return F.when(F.try_parse_json("raw_json").isNotNull(), F.col("raw_json")).otherwise(rebuilt)


def order_event_json() -> Column:
    """The order-flow event with its payload as an object, or as text where it is not JSON."""
    payload = F.coalesce(F.try_parse_json("payload"), F.col("payload").cast("variant"))
    return F.to_json(F.struct("event_id", "event_type", "order_id", "event_time", payload.alias("payload")))


def cascade_matches(sequences: DataFrame, steps: list[str]) -> DataFrame:
    """Sequence matches whose steps carry ``event_time`` and ``event_json``."""
    return sequences.select(
        *_match(
            S.CASCADE,
            F.col("machine_id"),
            F.col(f"{steps[-1]}.event_time"),
            F.array(*[F.col(f"{s}.event_json") for s in steps]),
        )
    )


def heartbeat_matches(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        *_match(S.HEARTBEAT, F.col("machine_id"), F.col("event_time"), F.array("previous.event_json"))
    )


def order_flow_matches(violations: DataFrame) -> DataFrame:
    """Dated by the last event of the evidence; all belong to one system, not to a machine."""
    return violations.select(
        *_match(
            S.ORDER_FLOW,
            F.lit(S.ORDER_FLOW_MACHINE),
            F.element_at("evidence", -1)["event_time"],
            F.transform("evidence", lambda e: e["event_json"]),
            F.col("violation_type"),
        )
    )


def raw_events() -> Column:
    """The source events with every field they came with."""
    return F.transform("source_json", lambda e: F.coalesce(F.try_parse_json(e), e.cast("variant")))


def match_value() -> Column:
    """The match as one JSON document with its source events nested."""
    events = raw_events()
    return F.to_json(
        F.struct(
            "schema_version",
            "pattern_name",
            "machine_id",
            "detected_at",
            "severity",
            "violation_type",
            events.alias("source_events"),
        )
    )


def match_messages(matches: DataFrame, prefix: str) -> DataFrame:
    """Messages for the pattern topic of the machine (order flow has its own topic)."""
    target = F.when(F.col("pattern_name") == S.ORDER_FLOW, F.lit("edi")).otherwise(F.lower("machine_id"))
    return matches.select(
        sentence(f"{prefix}.patterns.", target).alias("topic"),
        F.col("machine_id").alias("key"),
        match_value().alias("value"),
    )


def match_key() -> list[Column]:
    """What makes two matches the same occurrence.

    Machine and time would not do: two order-flow violations can share both, and without an order id
    only their events tell them apart.
    """

    def listed(field: str) -> Column:
        return F.to_json(F.array_distinct(F.transform("source_events", lambda e: F.coalesce(e[field], F.lit("")))))

    return [
        F.col("pattern_name"),
        F.col("machine_id"),
        F.unix_millis(F.col("detected_ts")).cast("string"),
        F.coalesce("violation_type", F.lit("")),
        listed("order_id"),
        listed("event_id"),
    ]


def with_match_id(matches: DataFrame) -> DataFrame:
    """Add ``match_id``, the same for every delivery of the same match."""
    return matches.withColumn("match_id", identity(*match_key()))


def distinct_matches(matches: DataFrame) -> DataFrame:
    return matches.dropDuplicates(["match_id"])
