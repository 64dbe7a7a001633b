"""Registered queries: the streaming detectors over the events table as a stream.

A stream only knows what its final watermark has passed: five seconds before the last event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.times import millis_iso
from tracewell.operators import matches as M
from tracewell.plans import detection_queries as D
from tracewell.plans.catalog import event_stream, events, query
from tracewell.plans.detection import cascades
from tracewell.plans.retrieval_queries import HISTORY_SQL
from tracewell.sources.sinks import append_messages
from tracewell.sources.topics import file_record_stream
from tracewell.storage import fresh_path
from tracewell.streaming import jobs
from tracewell.streaming.detectors import (
    stream_cascades,
    stream_missing_heartbeats,
    stream_order_violations,
    stream_step_deadlines,
)

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark, stream: DataFrame) -> DataFrame:
    """The rows a stream gives once it has read all that is there."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    out = fresh_path(spark, "stream")
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def first_time(index: int):
    return F.get_json_object(F.col("source_json")[index], "$.event_time")


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT 'Machine-' || user_id AS machine_id, {D.iso_sql('a_time')} AS started_at, {D.iso_sql('c_time')} AS detected_at
    FROM matched WHERE c_time <= (SELECT max(epoch_us(ts) // 1000) - 5000 FROM events)"""
)
def stream_cascade_matches(spark, sf_dir):
    records = D.telemetry_records(event_stream(spark, sf_dir))
    found = drained(spark, stream_cascades(records, D.machine_baselines(spark, sf_dir), D.THREE_DAYS_MS))
    return found.select("machine_id", first_time(0).alias("started_at"), "detected_at")


@query(
    f"""SELECT 'Machine-' || user_id AS machine_id, {D.iso_sql('ms')} AS detected_at, {D.iso_sql('previous_ms')} AS last_seen
    FROM ({D.gaps_sql('event_id', "WHERE event_type <> 'view'")})"""
)
def stream_heartbeat_matches(spark, sf_dir):
    found = drained(spark, stream_missing_heartbeats(D.heartbeat_records(event_stream(spark, sf_dir)), 86_400))
    return found.select("machine_id", "detected_at", first_time(0).alias("last_seen"))


WATERMARK_SQL = (
    "(SELECT max(epoch_us(ts) // 1000) - 5000 FROM events WHERE event_type IN ('signup', 'click', 'purchase'))"
)


@query(
    f"""SELECT violation_type, {D.iso_sql('ms')} AS detected_at, order_id FROM ({D.ORDER_MATCHES_SQL
        .replace("max(ms) OVER () AS as_of", f"{WATERMARK_SQL} + 1 AS as_of")
        .replace("FROM f WINDOW", f"FROM f WHERE ms <= {WATERMARK_SQL} WINDOW")})
    WHERE violation_type IS NOT NULL"""
)
def stream_order_matches(spark, sf_dir):
    found = drained(spark, stream_order_violations(D.order_records(event_stream(spark, sf_dir)), D.DAY_MS))
    order_id = F.get_json_object(F.col("source_json")[0], "$.order_id")
    return found.select("violation_type", "detected_at", order_id.alias("order_id"))


LAST_SQL = f"(SELECT max(epoch_us(ts) // 1000 - (event_id * 7919000) % {2 * D.DAY_MS}) FROM events WHERE event_type IN ('signup', 'click', 'purchase'))"


@query(D.ORDER_ROWS_SQL.replace("max(ms) OVER () AS as_of", f"{LAST_SQL} - 5000 + 1 AS as_of"))
def stream_order_matches_by_arrival(spark, sf_dir):
    """Order flows as they arrive, in a stream: two days of disorder, five seconds of watermark delay, no row too late."""
    records = D.order_records(D.jittered(event_stream(spark, sf_dir)))
    return D.order_rows(drained(spark, stream_order_violations(records, D.DAY_MS, order_by="arrival")))


@query(
    f"""SELECT replace(alert_id, 'alert-', 'train-') AS record_id, machine_id, confidence_raw, confidence_final, flags, retrieved
    FROM ({HISTORY_SQL})"""
)
def stored_history_alerts(spark, sf_dir):
    """The chain of ``history_alerts`` through the jobs: matches from a topic remembered in a stored index by group, then
    alerts that search it, read back from the training files."""
    path = fresh_path(spark, "memory")
    matches = cascades(D.telemetry_records(events(spark, sf_dir)), D.machine_baselines(spark, sf_dir), D.THREE_DAYS_MS)
    append_messages(M.match_messages(matches, "plant"), f"{path}/topics")
    store, alerts = f"{path}/store", f"{path}/alerts"

    def done(job) -> None:
        job.trigger(availableNow=True).start().awaitTermination()

    done(jobs.remember(file_record_stream(spark, f"{path}/topics"), store, f"{path}/remembered"))
    done(
        jobs.alert(
            file_record_stream(spark, f"{path}/topics"),
            lambda: spark.read.parquet(f"{store}/facts"),
            lambda: spark.read.parquet(f"{store}/episodes"),
            alerts,
            f"{path}/alerted",
            "plant",
            index=jobs.stored_index(spark, store),
        )
    )
    schema = (
        "record_id string, machine_id string, confidence_raw double, confidence_final double, validation_flags array<string>,"
        "retrieved_episodes array<struct<metadata:struct<edge_uuid:string>>>"
    )
    read = spark.read.schema(schema).json(f"{alerts}/training")
    return read.select(
        "record_id",
        "machine_id",
        "confidence_raw",
        "confidence_final",
        F.array_join("validation_flags", ",").alias("flags"),
        F.array_join(F.transform("retrieved_episodes", lambda e: e["metadata"]["edge_uuid"]), ",").alias("retrieved"),
    )


LATE_MS = 3 * D.DAY_MS
LATE_CASCADES_SQL = D.matches_sql(D.jittered_sql(D.FLAGGED_READINGS, "epoch_us(ts) // 1000 AS ms", "epoch_us(ts) // 1000"), "ms", D.THREE_DAYS_MS)


@query(
    f"""WITH RECURSIVE {LATE_CASCADES_SQL}
    SELECT 'Machine-' || user_id AS machine_id, {D.iso_sql('a_time')} AS started_at, {D.iso_sql('c_time')} AS detected_at
    FROM matched WHERE c_time <= (SELECT max(epoch_us(ts) // 1000 - (event_id * 7919000) % {2 * D.DAY_MS}) - {LATE_MS} FROM events)"""
)
def stream_cascade_matches_jittered(spark, sf_dir):
    """Cascades of rows that arrive in another order than they happened, put in order behind a watermark of three days."""
    records = D.telemetry_records(D.jittered(event_stream(spark, sf_dir)))
    found = drained(spark, stream_cascades(records, D.machine_baselines(spark, sf_dir), D.THREE_DAYS_MS, "3 days"))
    return found.select("machine_id", first_time(0).alias("started_at"), "detected_at")


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, (SELECT max(epoch_us(ts) // 1000) - 5000 FROM events) AS mark FROM events),
    pairs(step, missing_step) AS (VALUES ('signup', 'click'), ('click', 'purchase'))
    SELECT 'user-' || user_id AS user, {D.iso_sql('ms')} AS event_time, step, missing_step FROM (
      SELECT e.*, step, missing_step, lead(ms) OVER (PARTITION BY user_id, step ORDER BY ms, event_id) AS next_ms
      FROM e JOIN pairs ON event_type IN (step, missing_step) WHERE ms <= mark)
    WHERE event_type = step AND coalesce(next_ms, mark + 1) > ms + {2 * D.DAY_MS}"""
)
def stream_step_deadlines_missed(spark, sf_dir):
    """Sign-ups without a click, and clicks without a purchase, within two days, as a stream."""
    rows = event_stream(spark, sf_dir).select(
        F.concat(F.lit("user-"), "user_id").alias("user"),
        F.col("ms").alias("event_ms"),
        F.col("event_id").alias("offset"),
        "event_type",
        millis_iso(F.col("ms")).alias("event_time"),
        F.lit("{}").alias("event_json"),
    )
    pairs = [("signup", "click", 2 * D.DAY_MS), ("click", "purchase", 2 * D.DAY_MS)]
    return drained(spark, stream_step_deadlines(rows, "user", pairs)).select("user", "event_time", "step", "missing_step")
