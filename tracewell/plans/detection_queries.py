"""Registered queries: ingest, rules, sequences, gaps, order flow, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.times import micros, millis_iso
from tracewell.operators import matches as M
from tracewell.operators.baselines import flag_readings
from tracewell.operators.gaps import missing_slots as slots_without_signal
from tracewell.operators.gaps import signal_gaps
from tracewell.operators.intervals import grade_interventions, label_intervals
from tracewell.operators.orderflow import ORPHAN, SKIPPED, UNFULFILLED, flow_violations
from tracewell.operators.orderflow import step_deadlines as missed_steps
from tracewell.operators.sequence import match_sequence
from tracewell.operators.sequence import sequence_candidates as find_candidates
from tracewell.plans.catalog import events, query, table
from tracewell.plans.detection import cascades, missing_heartbeats, order_violations
from tracewell.schemas import CASCADE, HEARTBEAT, ORDER_FLOW
from tracewell.sources.ingest import (
    accepted,
    check_matches,
    parse_heartbeats,
    parse_matches,
    parse_order_events,
    parse_telemetry,
    union_all,
)

DAY_US = 86_400_000_000
DAY_MS = 86_400_000
THREE_DAYS_US = 3 * DAY_US
THREE_DAYS_MS = 3 * DAY_MS


# ---- sequences ----------------------------------------------------------------------------


def _steps() -> list[tuple[str, Column]]:
    kind, value = F.col("event_type"), F.col("value")
    return [
        ("a", (kind == "error") & (value > 40)),
        ("b", (kind == "click") & (value > 20)),
        ("c", (kind == "purchase") & (value > 20)),
    ]


def _sequence_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "user_id",
        F.col("a.event_id").alias("a_id"),
        F.col("b.event_id").alias("b_id"),
        F.col("c.event_id").alias("c_id"),
        F.col("a.us").alias("start_us"),
        F.col("c.us").alias("end_us"),
    )


def candidates_sql(flagged: str, time: str, within: int) -> str:
    """CTEs ``cand``: per start the nearest completion, from a select with is_a, is_b, is_c."""
    return f"""
    flagged AS ({flagged}),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {time}, event_id) AS rn
      FROM flagged WHERE is_a OR is_b OR is_c),
    ahead AS (
      SELECT *,
        min(CASE WHEN is_b THEN rn END) OVER later AS next_b,
        min(CASE WHEN is_c THEN rn END) OVER later AS next_c
      FROM numbered WINDOW later AS (
        PARTITION BY user_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    cand AS (
      SELECT a.user_id, a.rn AS a_rn, c.rn AS c_rn,
        a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id,
        a.{time} AS a_time, b.{time} AS b_time, c.{time} AS c_time
      FROM ahead a
      JOIN ahead b ON b.user_id = a.user_id AND b.rn = a.next_b
      JOIN ahead c ON c.user_id = b.user_id AND c.rn = b.next_c
      WHERE a.is_a AND c.{time} - a.{time} < {within})"""


def matches_sql(flagged: str, time: str, within: int) -> str:
    """CTEs ``matched``: the candidates left after skipping past each match's last event."""
    return f"""
    {candidates_sql(flagged, time, within)},
    linked AS (
      SELECT c.*, (SELECT min(d.a_rn) FROM cand d WHERE d.user_id = c.user_id AND d.a_rn > c.c_rn) AS next_a
      FROM cand c),
    matched AS (
      SELECT l.* FROM linked l
      JOIN (SELECT user_id, min(a_rn) AS a_rn FROM linked GROUP BY user_id) f
        ON f.user_id = l.user_id AND f.a_rn = l.a_rn
      UNION ALL
      SELECT l.* FROM matched m JOIN linked l ON l.user_id = m.user_id AND l.a_rn = m.next_a)"""


FLAGGED_EVENTS = """
      SELECT event_id, user_id, epoch_us(ts) AS us,
        event_type = 'error' AND value > 40 AS is_a,
        event_type = 'click' AND value > 20 AS is_b,
        event_type = 'purchase' AND value > 20 AS is_c
      FROM events"""
SEQUENCE_COLUMNS = "user_id, a_id, b_id, c_id, a_time AS start_us, c_time AS end_us"


@query(f"WITH RECURSIVE {matches_sql(FLAGGED_EVENTS, 'us', THREE_DAYS_US)} SELECT {SEQUENCE_COLUMNS} FROM matched")
def sequence_match(spark, sf_dir):
    """High-value error, then click, then purchase of one user within three days."""
    rows = events(spark, sf_dir)
    return _sequence_columns(match_sequence(rows, ["user_id"], ["us", "event_id"], _steps(), THREE_DAYS_US))


@query(f"WITH {candidates_sql(FLAGGED_EVENTS, 'us', THREE_DAYS_US)} SELECT {SEQUENCE_COLUMNS} FROM cand")
def sequence_candidates(spark, sf_dir):
    rows = events(spark, sf_dir)
    return _sequence_columns(find_candidates(rows, ["user_id"], ["us", "event_id"], _steps(), THREE_DAYS_US))


# ---- telemetry built from the events table ------------------------------------------------


def telemetry_records(rows: DataFrame) -> DataFrame:
    """Every event as a telemetry message of the machine ``Machine-<user>``.

    Errors heat up, clicks vibrate, purchases draw current; the other readings stay normal, and
    views carry no current reading at all.
    """
    kind, value = F.col("event_type"), F.col("value")
    sensors = F.struct(
        F.when(kind == "error", 340 + value).otherwise(320.0).alias("temperature_c"),
        F.when(kind == "click", 2.5 + value / 10).otherwise(3.0).alias("vibration_rms_mm_s"),
        F.when(kind == "purchase", 415 + 4 * value).when(kind != "view", 415.0).alias("current_a"),
    )
    message = F.struct(
        F.concat(F.lit("Machine-"), F.col("user_id")).alias("machine_id"),
        F.lit("rolling_mill").alias("machine_type"),
        millis_iso(F.col("ms")).alias("event_time"),
        F.lit("telemetry").alias("event_type"),
        sensors.alias("sensors"),
    )
    return rows.select(
        F.lit("plant.sensors").alias("topic"),
        F.col("user_id").cast("string").alias("key"),
        F.to_json(message).alias("value"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def machine_baselines(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select(F.concat(F.lit("Machine-"), F.col("user_id")).alias("machine_id"))
        .distinct()
        .select(
            "machine_id",
            F.lit(320.0).alias("baseline_temperature_c"),
            F.lit(415.0).alias("baseline_current_a"),
            F.lit(60.0).alias("cascade_temperature_offset_c"),
            F.lit(4.5).alias("cascade_vibration_threshold_mm_s"),
            F.lit(0.15).alias("cascade_current_deviation_pct"),
        )
    )


def iso_sql(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


# A view has no current reading; missing is -1, which deviates from 415 by more than 15 %.
READINGS_SQL = """
      SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms,
        CASE WHEN event_type = 'error' THEN 340 + value ELSE 320.0::DOUBLE END AS temperature,
        CASE WHEN event_type = 'click' THEN 2.5::DOUBLE + value / 10 ELSE 3.0::DOUBLE END AS vibration,
        CASE WHEN event_type = 'purchase' THEN 415 + 4 * value
             WHEN event_type <> 'view' THEN 415.0::DOUBLE END AS current
      FROM events"""
FLAGGED_READINGS = f"""
      SELECT *, temperature > 380 AS is_a, vibration > 4.5::DOUBLE AS is_b,
        abs(coalesce(current, -1) - 415) / 415 > 0.15::DOUBLE AS is_c
      FROM ({READINGS_SQL})"""
CASCADES_SQL = matches_sql(FLAGGED_READINGS, "ms", THREE_DAYS_MS)
STRICT_SQL = matches_sql(FLAGGED_READINGS.replace("coalesce(current, -1)", "current"), "ms", THREE_DAYS_MS)


def strict_cascades(spark, sf_dir) -> DataFrame:
    """Cascades in which a missing current reading does not count as an anomaly."""
    return cascades(
        telemetry_records(events(spark, sf_dir)), machine_baselines(spark, sf_dir), THREE_DAYS_MS, strict_missing=True
    )


def _match_times(matches: DataFrame) -> DataFrame:
    times = [F.get_json_object(F.col("source_json")[i], "$.event_time").alias(f"time_{i + 1}") for i in range(3)]
    return matches.select("machine_id", "pattern_name", "severity", "detected_at", *times)


MATCH_TIMES_SQL = f"""
    SELECT 'Machine-' || user_id AS machine_id, 'ThermalVibrationCascade' AS pattern_name,
      'CRITICAL' AS severity, {iso_sql('c_time')} AS detected_at, {iso_sql('a_time')} AS time_1,
      {iso_sql('b_time')} AS time_2, {iso_sql('c_time')} AS time_3
    FROM matched"""


@query(f"WITH RECURSIVE {CASCADES_SQL} {MATCH_TIMES_SQL}")
def cascade_matches(spark, sf_dir):
    """Telemetry JSON to cascade matches, with the rule that a missing reading is -1."""
    return _match_times(
        cascades(telemetry_records(events(spark, sf_dir)), machine_baselines(spark, sf_dir), THREE_DAYS_MS)
    )


@query(f"WITH RECURSIVE {STRICT_SQL} {MATCH_TIMES_SQL}")
def cascade_matches_strict(spark, sf_dir):
    return _match_times(strict_cascades(spark, sf_dir))


# ---- ingest -------------------------------------------------------------------------------


def damaged_records(spark, sf_dir) -> DataFrame:
    """Telemetry in which cheap events are cut off and dear ones have a bad time."""
    value = F.col("value")
    cut = F.expr("substring(value, 1, length(value) - 2)")
    untimed = F.regexp_replace("value", '"event_time":"[^"]*"', '"event_time":"soon"')
    amounts = table(spark, sf_dir, "events").select(F.col("event_id").alias("offset"), F.col("value").alias("amount"))
    return (
        telemetry_records(events(spark, sf_dir))
        .join(amounts, "offset")
        .withColumn("value", F.when(F.col("amount") < 5, cut).when(F.col("amount") > 200, untimed).otherwise(value))
    )


@query(
    f"""SELECT event_id, 'Machine-' || user_id AS machine_id, ms AS event_ms, temperature AS temperature_c,
      vibration AS vibration_rms_mm_s, coalesce(current, -1) AS current_a
    FROM ({READINGS_SQL}) JOIN (SELECT event_id, value FROM events) USING (event_id) WHERE value BETWEEN 5 AND 200"""
)
def telemetry_parse(spark, sf_dir):
    rows = accepted(parse_telemetry(damaged_records(spark, sf_dir)))
    return rows.select(
        F.col("offset").alias("event_id"), "machine_id", "event_ms", "temperature_c", "vibration_rms_mm_s", "current_a"
    )


@query(
    """SELECT CASE WHEN value < 5 THEN 'not a JSON object' WHEN value > 200 THEN 'event_time missing or not ISO-8601'
      END AS reject_reason, count(*) AS n
    FROM events GROUP BY 1"""
)
def telemetry_rejects(spark, sf_dir):
    rows = parse_telemetry(damaged_records(spark, sf_dir))
    return rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def heartbeat_records(rows: DataFrame) -> DataFrame:
    message = F.struct(
        F.when(F.col("event_type") != "view", F.concat(F.lit("Machine-"), F.col("user_id"))).alias("machine_id"),
        millis_iso(F.col("ms")).alias("event_time"),
        F.lit("heartbeat").alias("event_type"),
        F.when(F.col("event_type") != "signup", F.get_json_object("props", "$.k").cast("long")).alias("sequence"),
    )
    return rows.select(F.to_json(message).alias("value"), F.col("event_id").alias("offset"))


@query(
    """SELECT event_id, 'Machine-' || user_id AS machine_id, epoch_us(ts) // 1000 AS event_ms,
      CASE WHEN event_type = 'signup' THEN -1 ELSE (props ->> '$.k')::BIGINT END AS sequence
    FROM events WHERE event_type <> 'view'"""
)
def heartbeat_parse(spark, sf_dir):
    rows = accepted(parse_heartbeats(heartbeat_records(events(spark, sf_dir))))
    return rows.select(F.col("offset").alias("event_id"), "machine_id", "event_ms", "sequence")


GAPS_SQL = """
    SELECT event_id, user_id, ms, k, lag(event_id) OVER w AS previous_id, lag(ms) OVER w AS previous_ms,
      lag(k) OVER w AS previous_k, (ms - lag(ms) OVER w) // 1000 AS gap_seconds
    FROM (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, (props ->> '$.k')::BIGINT AS k, event_type
          FROM events) {where}
    WINDOW w AS (PARTITION BY user_id ORDER BY {order})"""


def gaps_sql(order: str, where: str = "") -> str:
    return f"SELECT * FROM ({GAPS_SQL.format(order=order, where=where)}) WHERE gap_seconds > 86400"


@query(f"SELECT user_id, event_id, previous_id, gap_seconds FROM ({gaps_sql('event_id')})")
def gap_detect(spark, sf_dir):
    """Users silent for more than a day, in arrival order."""
    found = signal_gaps(events(spark, sf_dir), ["user_id"], ["event_id"], "ms", 86_400)
    return found.select("user_id", "event_id", F.col("previous.event_id").alias("previous_id"), "gap_seconds")


@query(f"SELECT user_id, event_id, previous_id, gap_seconds FROM ({gaps_sql('ms, event_id')})")
def gap_detect_event_time(spark, sf_dir):
    found = signal_gaps(events(spark, sf_dir), ["user_id"], ["ms", "event_id"], "ms", 86_400)
    return found.select("user_id", "event_id", F.col("previous.event_id").alias("previous_id"), "gap_seconds")


def jittered(rows: DataFrame) -> DataFrame:
    """Events whose clocks run behind by up to two days, so that they arrive in another order than they happened."""
    return rows.withColumn("ms", F.col("ms") - F.pmod(F.col("event_id") * 7_919_000, F.lit(2 * DAY_MS)))


def jittered_sql(text: str, ms: str, jittered_ms: str) -> str:
    """An oracle over the same events with the jittered time in place of ``ms``."""
    return text.replace(ms, f"{jittered_ms} - (event_id * 7919000) % {2 * DAY_MS} AS ms")


def jittered_gaps_sql(order: str) -> str:
    return jittered_sql(gaps_sql(order), "epoch_us(ts) // 1000 AS ms", "epoch_us(ts) // 1000")


@query(
    f"""SELECT 'arrival' AS order_by, user_id, event_id, previous_id, gap_seconds FROM ({jittered_gaps_sql('event_id')})
    UNION ALL SELECT 'event_time', user_id, event_id, previous_id, gap_seconds FROM ({jittered_gaps_sql('ms, event_id')})"""
)
def gap_detect_jittered(spark, sf_dir):
    """Silent users where clocks run behind: a late signal resets the last time seen in arrival order only."""
    rows = jittered(events(spark, sf_dir))
    found = None
    for name, order in (("arrival", ["event_id"]), ("event_time", ["ms", "event_id"])):
        gaps = signal_gaps(rows, ["user_id"], order, "ms", 86_400)
        gaps = gaps.select(F.lit(name).alias("order_by"), "user_id", "event_id", F.col("previous.event_id").alias("previous_id"), "gap_seconds")
        found = gaps if found is None else found.unionByName(gaps)
    return found


@query(
    f"""SELECT 'Machine-' || user_id AS machine_id, {iso_sql('ms')} AS detected_at, {iso_sql('previous_ms')} AS last_seen
    FROM ({gaps_sql('event_id', "WHERE event_type <> 'view'")})"""
)
def heartbeat_matches(spark, sf_dir):
    """Heartbeat JSON to MissingHeartbeat matches."""
    found = missing_heartbeats(heartbeat_records(events(spark, sf_dir)), 86_400)
    last_seen = F.get_json_object(F.col("source_json")[0], "$.event_time")
    return found.select("machine_id", "detected_at", last_seen.alias("last_seen"))


@query(
    f"""WITH seen AS (SELECT DISTINCT user_id, epoch_us(ts) // {DAY_US} AS slot FROM events),
    expected AS (SELECT user_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM seen GROUP BY user_id)
    SELECT user_id, slot * {DAY_MS} AS slot_start_ms FROM expected ANTI JOIN seen USING (user_id, slot)"""
)
def missing_slots(spark, sf_dir):
    """Days on which an otherwise active user sent nothing."""
    return slots_without_signal(events(spark, sf_dir), ["user_id"], "ms", DAY_MS)


# ---- rules --------------------------------------------------------------------------------


@query(
    """WITH base AS (
      SELECT p_brand, round(avg(p_retailprice), 2) AS price, round(avg(p_size), 2) AS size FROM part GROUP BY p_brand),
    r AS (
      SELECT p.p_brand, l_returnflag, p_retailprice AS t, l_discount AS v,
        CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS c
      FROM lineitem JOIN part p ON p_partkey = l_partkey)
    SELECT r.p_brand AS brand, l_returnflag, count(*) AS readings,
      count(*) FILTER (WHERE t > price + 50) AS temperature, count(*) FILTER (WHERE v > 0.05::DOUBLE) AS vibration,
      count(*) FILTER (WHERE size <> 0 AND abs(coalesce(c, -1) - size) / size > 0.5::DOUBLE) AS current
    FROM r JOIN base ON base.p_brand = r.p_brand GROUP BY ALL"""
)
def threshold_flags(spark, sf_dir):
    """The three anomaly rules over all line items, with one baseline per brand."""
    parts = table(spark, sf_dir, "part")
    base = parts.groupBy(F.col("p_brand").alias("machine_id")).agg(
        F.round(F.avg("p_retailprice"), 2).alias("baseline_temperature_c"),
        F.round(F.avg("p_size"), 2).alias("baseline_current_a"),
        F.lit(50.0).alias("cascade_temperature_offset_c"),
        F.lit(0.05).alias("cascade_vibration_threshold_mm_s"),
        F.lit(0.5).alias("cascade_current_deviation_pct"),
    )
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    readings = lines.select(
        F.col("p_brand").alias("machine_id"),
        "l_returnflag",
        F.col("p_retailprice").alias("temperature_c"),
        F.col("l_discount").alias("vibration_rms_mm_s"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("current_a"),
    )
    return (
        flag_readings(readings, base)
        .groupBy(F.col("machine_id").alias("brand"), "l_returnflag")
        .agg(
            F.count(F.lit(1)).alias("readings"),
            F.count_if("is_temperature").alias("temperature"),
            F.count_if("is_vibration").alias("vibration"),
            F.count_if("is_current").alias("current"),
        )
    )


# ---- order flow ---------------------------------------------------------------------------


def shipping(spark, sf_dir) -> DataFrame:
    """Orders and their shipments as one event table; ties put orders first."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.lit("order").alias("kind"),
        micros(F.col("o_orderdate")).alias("us"),
        F.lit(0).alias("seq"),
    )
    shipments = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.lit("shipment").alias("kind"),
        micros(F.col("l_shipdate")).alias("us"),
        (F.col("l_linenumber") + 1).alias("seq"),
    )
    return orders.unionByName(shipments)


SHIPPING_SQL = """
    SELECT o_orderkey AS order_key, 'order' AS kind, epoch_us(o_orderdate) AS us, 0 AS seq FROM orders
    UNION ALL SELECT l_orderkey, 'shipment', epoch_us(l_shipdate), l_linenumber + 1 FROM lineitem"""
ORPHAN_SQL = f"""
    SELECT order_key, us AS detected_us FROM (
      SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY us, seq) AS rn FROM ({SHIPPING_SQL}))
    WHERE rn = 1 AND kind = 'shipment'"""
DEADLINE_SQL = f"""
    SELECT order_key, us AS detected_us FROM (
      SELECT *, lead(us) OVER (PARTITION BY order_key ORDER BY us, seq) AS next_us, max(us) OVER () AS as_of
      FROM ({SHIPPING_SQL}))
    WHERE kind = 'order' AND coalesce(next_us, as_of) > us + {90 * DAY_US}"""
FUNNEL_SQL = """
    SELECT user_id, event_id, epoch_us(ts) AS us,
      CASE event_type WHEN 'signup' THEN 'order' WHEN 'click' THEN 'shipment' WHEN 'purchase' THEN 'invoice' END AS kind
    FROM events WHERE event_type IN ('signup', 'click', 'purchase')"""
# Running counts of invoices make cycles; inside a cycle the last order must lie before a shipment.
SKIPPED_SQL = f"""
    WITH funnel AS ({FUNNEL_SQL}),
    cycles AS (
      SELECT *, coalesce(sum(CASE WHEN kind = 'invoice' THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cycle
      FROM funnel),
    summed AS (
      SELECT user_id, cycle,
        max(CASE WHEN kind = 'order' THEN us END) AS order_us, arg_max(event_id, us) FILTER (WHERE kind = 'order') AS order_id,
        max(CASE WHEN kind = 'shipment' THEN us END) AS shipment_us,
        max(CASE WHEN kind = 'invoice' THEN us END) AS invoice_us, max(CASE WHEN kind = 'invoice' THEN event_id END) AS invoice_id
      FROM cycles GROUP BY user_id, cycle)
    SELECT user_id, order_id, invoice_id, invoice_us AS detected_us FROM summed
    WHERE invoice_us IS NOT NULL AND order_us IS NOT NULL AND (shipment_us IS NULL OR shipment_us < order_us)"""


def _shipping_violations(spark, sf_dir) -> DataFrame:
    return flow_violations(shipping(spark, sf_dir), ["order_key"], ["us", "seq"], "kind", 90 * DAY_US)


def funnel(rows: DataFrame) -> DataFrame:
    """Sign-up, click and purchase of a user in the roles of order, shipment and invoice."""
    kind = F.col("event_type")
    role = F.when(kind == "signup", "order").when(kind == "click", "shipment").when(kind == "purchase", "invoice")
    return rows.withColumn("kind", role).filter(F.col("kind").isNotNull())


def _funnel_violations(spark, sf_dir) -> DataFrame:
    return flow_violations(
        funnel(events(spark, sf_dir)), ["user_id"], ["us", "event_id"], "kind", 90 * DAY_US, carry=["event_id"]
    )


@query(ORPHAN_SQL)
def orphan_step(spark, sf_dir):
    """Orders whose first event is a shipment."""
    found = _shipping_violations(spark, sf_dir).filter(F.col("violation_type") == ORPHAN)
    return found.select("order_key", F.col("detected").alias("detected_us"))


@query(DEADLINE_SQL)
def deadline_miss(spark, sf_dir):
    """Orders not followed by a shipment within 90 days."""
    found = _shipping_violations(spark, sf_dir).filter(F.col("violation_type") == UNFULFILLED)
    return found.select("order_key", F.col("detected").alias("detected_us"))


@query(SKIPPED_SQL)
def skipped_step(spark, sf_dir):
    """Purchases that follow a sign-up with no click in between."""
    found = _funnel_violations(spark, sf_dir).filter(F.col("violation_type") == SKIPPED)
    return found.select(
        "user_id",
        F.col("evidence")[0]["event_id"].alias("order_id"),
        F.col("evidence")[1]["event_id"].alias("invoice_id"),
        F.col("detected").alias("detected_us"),
    )


@query(
    f"""SELECT violation_type, count(*) AS n FROM (
      SELECT 'shipment_without_order' AS violation_type FROM ({ORPHAN_SQL})
      UNION ALL SELECT 'order_unfulfilled' FROM ({DEADLINE_SQL})
      UNION ALL SELECT 'invoice_without_shipment' FROM ({SKIPPED_SQL})) GROUP BY violation_type"""
)
def violations_union(spark, sf_dir):
    """Violations of the shipping flow and skipped steps of the funnel, per type."""
    skipped = _funnel_violations(spark, sf_dir).filter(F.col("violation_type") == SKIPPED)
    both = _shipping_violations(spark, sf_dir).select("violation_type").unionByName(skipped.select("violation_type"))
    return both.groupBy("violation_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
    pairs(step, missing_step) AS (VALUES ('signup', 'click'), ('click', 'purchase'))
    SELECT user_id, event_id, us, step, missing_step FROM (
      SELECT e.*, step, missing_step, lead(us) OVER (PARTITION BY user_id, step ORDER BY us, event_id) AS next_us
      FROM e JOIN pairs ON event_type IN (step, missing_step))
    WHERE event_type = step AND coalesce(next_us, (SELECT max(us) FROM e)) > us + {2 * DAY_US}"""
)
def step_deadlines(spark, sf_dir):
    """Sign-ups without a click, and clicks without a purchase, within two days."""
    pairs = [("signup", "click", 2 * DAY_US), ("click", "purchase", 2 * DAY_US)]
    rows = events(spark, sf_dir)
    end = rows.select(F.max("us")).scalar()
    return missed_steps(rows, ["user_id"], ["us", "event_id"], "event_type", pairs, as_of=end)


def order_records(rows: DataFrame) -> DataFrame:
    """Funnel events as order-flow JSON; large events carry a broken payload, small ones an object."""
    text = F.when(F.col("value") > 100, F.lit("{broken")).otherwise(F.col("props"))
    order_id = F.when(F.col("value") >= 1, F.concat(F.lit("order-"), F.col("user_id")))
    fields = [
        F.concat(F.lit("e-"), F.col("event_id")).alias("event_id"),
        F.col("kind").alias("event_type"),
        order_id.alias("order_id"),
        millis_iso(F.col("ms")).alias("event_time"),
    ]
    plain = F.to_json(F.struct(*fields, text.alias("payload")))
    nested = F.to_json(F.struct(*fields, F.struct(F.lit(1).alias("x")).alias("payload")))
    return funnel(rows).select(
        F.when(F.col("value") < 5, nested).otherwise(plain).alias("value"), F.col("event_id").alias("offset")
    )


@query(
    f"""SELECT event_id AS "offset", 'e-' || event_id AS event_id, kind AS event_type,
      CASE WHEN value >= 1 THEN 'order-' || user_id ELSE '' END AS order_id, us // 1000 AS event_ms,
      CASE WHEN value < 5 THEN '' WHEN value > 100 THEN '{{broken' ELSE props END AS payload
    FROM ({FUNNEL_SQL.replace('SELECT user_id,', 'SELECT value, props, user_id,')})"""
)
def order_event_parse(spark, sf_dir):
    rows = accepted(parse_order_events(order_records(events(spark, sf_dir))))
    return rows.select("offset", "event_id", "event_type", "order_id", "event_ms", "payload")


ORDER_MATCHES_SQL = f"""
    WITH f AS (
      SELECT event_id, us // 1000 AS ms, kind, CASE WHEN value >= 1 THEN 'order-' || user_id ELSE '' END AS order_id
      FROM ({FUNNEL_SQL.replace('SELECT user_id,', 'SELECT value, user_id,')})),
    looked AS (
      SELECT *, lag(kind) OVER k AS kind_before, lag(ms) OVER k AS ms_before,
        last_value(CASE WHEN kind <> 'invoice' THEN ms END IGNORE NULLS) OVER (
          k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delivery_before,
        first_value(CASE WHEN kind <> 'invoice' THEN ms END IGNORE NULLS) OVER (
          k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS delivery_after,
        max(ms) OVER () AS as_of
      FROM f WINDOW k AS (PARTITION BY order_id ORDER BY ms, event_id))
    SELECT *, CASE
      WHEN kind = 'shipment' AND delivery_before IS NULL THEN 'shipment_without_order'
      WHEN kind = 'invoice' AND kind_before = 'order' THEN 'invoice_without_shipment'
      WHEN kind = 'order' AND coalesce(delivery_after, as_of) > ms + {DAY_MS} THEN 'order_unfulfilled' END AS violation_type
    FROM looked"""


@query(
    f"""SELECT 'EDI-System' AS machine_id, violation_type, {iso_sql('ms')} AS detected_at, order_id,
      CASE WHEN violation_type = 'invoice_without_shipment' THEN 2 ELSE 1 END AS n_events
    FROM ({ORDER_MATCHES_SQL}) WHERE violation_type IS NOT NULL"""
)
def order_matches(spark, sf_dir):
    """Order-flow JSON to matches of all three kinds; rows without an order id share one key."""
    found = order_violations(order_records(events(spark, sf_dir)), DAY_MS)
    order_id = F.get_json_object(F.col("source_json")[0], "$.order_id")
    return found.select(
        "machine_id", "violation_type", "detected_at", order_id.alias("order_id"), F.size("source_json").alias("n_events")
    )


ARRIVAL_MATCHES_SQL = jittered_sql(ORDER_MATCHES_SQL, "us // 1000 AS ms", "us // 1000").replace("ORDER BY ms, event_id", "ORDER BY event_id")
ORDER_ROWS_SQL = f"""SELECT violation_type, {iso_sql('ms')} AS detected_at, order_id,
      CASE WHEN violation_type = 'invoice_without_shipment' THEN 2 ELSE 1 END AS n_events
    FROM ({ARRIVAL_MATCHES_SQL}) WHERE violation_type IS NOT NULL"""


def order_rows(found: DataFrame) -> DataFrame:
    order_id = F.get_json_object(F.col("source_json")[0], "$.order_id")
    return found.select("violation_type", "detected_at", order_id.alias("order_id"), F.size("source_json").alias("n_events"))


@query(ORDER_ROWS_SQL)
def order_matches_by_arrival(spark, sf_dir):
    """Order flows as their events arrive, with clocks that run behind."""
    return order_rows(order_violations(order_records(jittered(events(spark, sf_dir))), DAY_MS, order_by="arrival"))


def all_matches(spark, sf_dir) -> DataFrame:
    """Messages of all three detectors, read back and checked."""
    found = union_all(
        [
            strict_cascades(spark, sf_dir),
            missing_heartbeats(heartbeat_records(events(spark, sf_dir)), 86_400),
            order_violations(order_records(events(spark, sf_dir)), DAY_MS),
        ]
    )
    return accepted(parse_matches(M.match_messages(found, "plant")))


@query(
    f"""WITH RECURSIVE {STRICT_SQL}
    SELECT '{CASCADE}' AS pattern_name, 'CRITICAL' AS severity, NULL AS violation_type, count(*) AS n, 3 * count(*) AS n_events
    FROM matched
    UNION ALL SELECT '{HEARTBEAT}', 'CRITICAL', NULL, count(*), count(*)
    FROM ({gaps_sql('event_id', "WHERE event_type <> 'view'")})
    UNION ALL SELECT '{ORDER_FLOW}', 'HIGH', violation_type, count(*),
      sum(CASE WHEN violation_type = 'invoice_without_shipment' THEN 2 ELSE 1 END)::BIGINT
    FROM ({ORDER_MATCHES_SQL}) WHERE violation_type IS NOT NULL GROUP BY violation_type"""
)
def match_union(spark, sf_dir):
    """All detectors through one match schema, counted per pattern and violation."""
    return (
        all_matches(spark, sf_dir)
        .groupBy("pattern_name", "severity", "violation_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("source_events")).alias("n_events"))
    )


@query(
    """SELECT event_id, CASE WHEN missing <> '' THEN 'missing required fields: ' || missing
      WHEN event_type = 'signup' THEN 'detected_at is not ISO-8601: not-a-date' END AS reject_reason
    FROM (SELECT event_id, event_type, concat_ws(', ',
        CASE WHEN event_type = 'view' THEN 'machine_id' END, CASE WHEN value > 100 THEN 'severity' END,
        CASE WHEN value < 2 THEN 'source_events' END) AS missing FROM events)"""
)
def match_validate(spark, sf_dir):
    """Required-field and time checks over match-shaped rows made from every event."""
    value, kind = F.col("value"), F.col("event_type")
    rows = events(spark, sf_dir).select(
        "event_id",
        F.when(kind == "view", "").otherwise(F.concat(F.lit("Machine-"), F.col("user_id"))).alias("machine_id"),
        F.lit(CASCADE).alias("pattern_name"),
        F.when(kind == "signup", "not-a-date").otherwise(millis_iso(F.col("ms"))).alias("detected_at"),
        F.when(value <= 100, "HIGH").alias("severity"),
        F.when(value < 2, F.array().cast("array<string>")).otherwise(F.array("props")).alias("source_events"),
    )
    return check_matches(rows).select("event_id", "reject_reason")


# ---- intervals ----------------------------------------------------------------------------


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
    w AS (SELECT user_id, ms AS start_ms, ms + {6 * 3_600_000} AS end_ms, event_id AS registered FROM e WHERE event_type = 'error')
    SELECT user_id, event_id, ms, label, elapsed_seconds FROM (
      SELECT e.user_id, e.event_id, e.ms, 'fault-' || w.registered AS label, (e.ms - w.start_ms) / 1000.0::DOUBLE AS elapsed_seconds,
        row_number() OVER (PARTITION BY e.event_id ORDER BY w.registered NULLS LAST) AS rn
      FROM e LEFT JOIN w ON w.user_id = e.user_id AND e.ms >= w.start_ms AND e.ms < w.end_ms) WHERE rn = 1"""
)
def interval_label(spark, sf_dir):
    """Every event with the first error window (six hours) of its user that holds it."""
    rows = events(spark, sf_dir)
    windows = rows.filter(F.col("event_type") == "error").select(
        "user_id",
        F.col("ms").alias("start_ms"),
        (F.col("ms") + 6 * 3_600_000).alias("end_ms"),
        F.col("event_id").alias("registered"),
        F.concat(F.lit("fault-"), F.col("event_id")).alias("label"),
    )
    return label_intervals(rows, windows, ["user_id"], "event_id", "ms")


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
    x AS (SELECT p.event_id, p.user_id, p.ms, min(n.ms) AS again, (SELECT max(ms) FROM e WHERE event_type IN ('purchase', 'error')) AS as_of
      FROM e p LEFT JOIN e n ON n.user_id = p.user_id AND n.event_type = 'error' AND n.ms > p.ms AND n.ms <= p.ms + {7 * DAY_MS}
      WHERE p.event_type = 'purchase' GROUP BY ALL)
    SELECT event_id AS intervention_id, user_id,
      CASE WHEN again IS NOT NULL THEN 'recurred' WHEN as_of >= ms + {7 * DAY_MS} THEN 'resolved' ELSE 'ongoing' END AS outcome_status,
      coalesce((again - ms) // {DAY_MS}, -1)::INTEGER AS days_until_recurrence, 7 AS evaluation_window_days,
      coalesce(again, least(as_of, ms + {7 * DAY_MS})) AS observed_ms
    FROM x"""
)
def recurrence_grading(spark, sf_dir):
    """Purchases as interventions, errors of the same user within seven days as recurrences."""
    rows = events(spark, sf_dir)
    acts = rows.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("intervention_id"), F.col("ms").alias("performed_ms")
    )
    seen = rows.filter(F.col("event_type") == "error").select("user_id", F.col("ms").alias("detected_ms"))
    graded = grade_interventions(acts, seen, ["user_id"], 7)
    return graded.fillna(-1, ["days_until_recurrence"])
