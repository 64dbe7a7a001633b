"""JSON records to typed rows. Bad records get a ``reject_reason`` instead of stopping the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.times import iso_millis, iso_timestamp
from tracewell.schemas import MATCH_FIELDS, MISSING_READING

NOT_JSON = "not a JSON object"
BAD_TIME = "event_time missing or not ISO-8601"

# Everything is read as text first, so that a wrongly typed field does not lose the record.
_TELEMETRY_TEXT = (
    "machine_id string, machine_type string, event_time string, event_type string, "
    "sensors map<string,string>, meta struct<sim_seed:int,injected_fault:string>, _bad string"
)
_HEARTBEAT_TEXT = "machine_id string, event_time string, event_type string, sequence string, _bad string"
_MATCH_TEXT = ", ".join(f"{name} string" for name in MATCH_FIELDS) + ", _bad string"
_SOURCE_TEXT = (
    "machine_id string, machine_type string, event_time string, event_type string, sensors map<string,string>, "
    "sequence string, event_id string, order_id string, payload string"
)
_ORDER_TEXT = "event_id string, event_type string, order_id string, event_time string, payload string, _bad string"


def _parsed(records: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    kept = [c for c in ("topic", "offset", "timestamp") if c in records.columns]
    body = once(F.from_json("value", schema, options)).alias("_p")
    return records.select(F.col("value").alias("raw_json"), *kept, body)


def once(value: Column) -> Column:
    """``value``, evaluated once per row.

    A filter on a computed column is otherwise pushed below it with a copy of the whole
    computation, so every rule on a parsed field would parse the JSON again.
    """
    return F.explode(F.array(value))


def _reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that applies, or null."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(text)) for cond, text in rules])


def _not_json() -> Column:
    return F.col("_p").isNull() | F.col("_p._bad").isNotNull()


def parse_telemetry(records: DataFrame) -> DataFrame:
    """Typed telemetry; a sensor that is absent or not a number becomes -1, the text is kept."""

    def sensor(name: str) -> Column:
        return F.coalesce(F.col("_p.sensors")[name].try_cast("double"), F.lit(MISSING_READING)).alias(name)

    time = F.coalesce(F.col("_p.event_time"), F.lit(""))
    rows = _parsed(records, _TELEMETRY_TEXT).withColumn("_ms", once(iso_millis(time)))
    millis = F.col("_ms")
    return rows.select(
        F.coalesce("_p.machine_id", F.lit("")).alias("machine_id"),
        F.col("_p.machine_type").alias("machine_type"),
        time.alias("event_time"),
        millis.alias("event_ms"),
        F.col("_p.event_type").alias("event_type"),
        sensor("temperature_c"),
        sensor("vibration_rms_mm_s"),
        sensor("current_a"),
        F.transform_values("_p.sensors", lambda _, v: v.try_cast("double")).alias("sensors"),
        F.col("_p.meta").alias("meta"),
        *_extra(rows),
        _reason(
            (_not_json(), NOT_JSON),
            (millis.isNull() | (millis <= 0), BAD_TIME),
        ).alias("reject_reason"),
    )


def parse_heartbeats(records: DataFrame) -> DataFrame:
    """Typed heartbeats; a missing sequence is -1, a missing machine or time rejects the record."""
    time = F.coalesce(F.col("_p.event_time"), F.lit(""))
    machine = F.coalesce(F.col("_p.machine_id"), F.lit(""))
    rows = _parsed(records, _HEARTBEAT_TEXT).withColumn("_ms", once(iso_millis(time)))
    millis = F.col("_ms")
    return rows.select(
        machine.alias("machine_id"),
        time.alias("event_time"),
        millis.alias("event_ms"),
        F.coalesce(F.col("_p.sequence").try_cast("double").cast("long"), F.lit(-1).cast("long")).alias("sequence"),
        *_extra(rows),
        _reason(
            (_not_json(), NOT_JSON),
            (millis.isNull() | (millis <= 0), BAD_TIME),
            (machine == "", "machine_id missing"),
        ).alias("reject_reason"),
    )


def parse_order_events(records: DataFrame) -> DataFrame:
    """Typed order-flow events.

    Missing ids read as empty text (such rows share the key ``""``). The payload is JSON inside a
    string; a payload given as an object or array reads as empty.
    """
    time = F.coalesce(F.col("_p.event_time"), F.lit(""))
    rows = _parsed(records, _ORDER_TEXT).withColumn("_ms", once(F.unix_millis(iso_timestamp(time))))
    millis = F.col("_ms")
    read = F.coalesce(F.col("_p.payload"), F.lit(""))
    # Only a text that looks like a container needs the record's own type of the field.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw_json"), "$.payload", "variant"))
    looks_so = F.substring(read, 1, 1).isin("{", "[")
    is_container = F.when(looks_so, F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False))).otherwise(False)
    payload = F.when(is_container, "").otherwise(read)

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"_p.{name}"), F.lit("")).alias(name)

    return rows.select(
        text("event_id"),
        text("event_type"),
        text("order_id"),
        time.alias("event_time"),
        millis.alias("event_ms"),
        payload.alias("payload"),
        *_extra(rows),
        _reason((_not_json(), NOT_JSON), (millis.isNull(), BAD_TIME)).alias("reject_reason"),
    )


def _extra(rows: DataFrame) -> list[str]:
    return [c for c in ("topic", "offset", "timestamp", "raw_json") if c in rows.columns]


REQUIRED = ("machine_id", "pattern_name", "detected_at", "severity", "source_events")


def parse_matches(records: DataFrame) -> DataFrame:
    """Pattern matches from their JSON records, checked.

    ``source_json`` holds each source event as it came; ``source_events`` is a typed view of it, in which
    a field of an unexpected kind is null and no reason to reject the match.
    """
    rows = _parsed(records, _MATCH_TEXT)
    listed = F.col("_p.source_events")
    texts = F.when(F.substring(listed, 1, 1) == "[", F.from_json(listed, "array<string>")).when(listed != "", F.array(listed))
    rows = rows.withColumn("_texts", once(texts))
    rows = rows.withColumn("_events", once(F.transform("_texts", lambda e: F.from_json(e, _SOURCE_TEXT))))
    plain = [F.col(f"_p.{name}").alias(name) for name in MATCH_FIELDS if name != "source_events"]
    typed = rows.select(
        *plain,
        F.transform("_events", _source_event).alias("source_events"),
        F.col("_texts").alias("source_json"),
        *_extra(rows),
        _not_json().alias("_broken"),
    )
    checked = check_matches(typed)
    reason = F.when(F.col("_broken"), NOT_JSON).otherwise(F.col("reject_reason"))
    return checked.withColumn("reject_reason", reason).drop("_broken")


def _source_event(e: Column) -> Column:
    text = ["machine_id", "machine_type", "event_time", "event_type"]
    return F.struct(
        *[e[n].alias(n) for n in text],
        F.transform_values(e["sensors"], lambda _, v: v.try_cast("double")).alias("sensors"),
        e["sequence"].try_cast("double").try_cast("long").alias("sequence"),
        *[e[n].alias(n) for n in ("event_id", "order_id", "payload")],
    )


def missing_fields(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> Column:
    """Names of the required fields that are null, empty text or an empty list."""

    def absent(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        column = F.col(name)
        empty = F.size(column) == 0 if kind == "array" else column == "" if kind == "string" else F.lit(False)
        return F.when(column.isNull() | empty, F.lit(name))

    return F.array_compact(F.array(*[absent(name) for name in required]))


def check_matches(matches: DataFrame) -> DataFrame:
    """Add ``detected_ts`` and ``reject_reason``; the other columns stay as they came."""
    missing = missing_fields(matches)
    detected = iso_timestamp(F.col("detected_at"))
    reason = F.when(
        F.size(missing) > 0,
        F.concat(F.lit("missing required fields: "), F.array_join(missing, ", ")),
    ).when(detected.isNull(), F.concat(F.lit("detected_at is not ISO-8601: "), F.col("detected_at")))
    return matches.withColumns({"detected_ts": detected, "reject_reason": reason})


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns some of them lack are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
