"""Registered queries: episodes, entities, gate, alerts, training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import sentence, word_count
from tracewell.operators import alerts as A
from tracewell.operators import entities as G
from tracewell.operators import episodes as E
from tracewell.operators import matches as M
from tracewell.plans import detection_queries as D
from tracewell.plans.catalog import events, query, table
from tracewell.plans.detection import cascades, missing_heartbeats, order_violations
from tracewell.sources.ingest import accepted, parse_matches
from tracewell.sources.sinks import alert_messages, append_messages, append_training_records
from tracewell.sources.topics import file_records, pattern_topics
from tracewell.storage import fresh_path


def _typed(matches: DataFrame) -> DataFrame:
    """Matches after a round trip through their JSON messages."""
    return M.with_match_id(accepted(parse_matches(M.match_messages(matches, "plant"))))


def cascade_table(spark, sf_dir) -> DataFrame:
    records, baselines = D.telemetry_records(events(spark, sf_dir)), D.machine_baselines(spark, sf_dir)
    return _typed(cascades(records, baselines, D.THREE_DAYS_MS))


# ---- narratives ---------------------------------------------------------------------------


def occurrence_sql(machine: str, ms: str) -> str:
    return f"'occ-' || lower({machine}) || '-' || strftime(make_timestamp({ms} * 1000), '%Y%m%dT%H%M%SZ')"


CASCADE_ROWS_SQL = f"""
    readings AS ({D.READINGS_SQL}),
    told AS (
      SELECT 'Machine-' || m.user_id AS machine_id, a_time, c_time,
        greatest(a.temperature, b.temperature, c.temperature) AS temperature,
        greatest(a.vibration, b.vibration, c.vibration) AS vibration,
        greatest(a.current, b.current, c.current) AS current,
        a.current IS NULL OR b.current IS NULL OR c.current IS NULL AS lacking
      FROM matched m JOIN readings a ON a.event_id = a_id JOIN readings b ON b.event_id = b_id
      JOIN readings c ON c.event_id = c_id)"""


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}, {CASCADE_ROWS_SQL}
    SELECT machine_id, {D.iso_sql('c_time')} AS detected_at,
      CASE WHEN lacking THEN 'source event lacks sensor data' END AS reject_reason,
      CASE WHEN NOT lacking THEN 'ThermalVibrationCascade on ' || machine_id || ', occurrence ' || {occurrence_sql('machine_id', 'c_time')}
        || ', family bearing_degradation, severity CRITICAL. The rolling mill took its first step at ' || {D.iso_sql('a_time')}
        || ' and the last ' || printf('%.0f', (c_time - a_time) / 1000.0::DOUBLE) || ' s later, noticed at ' || {D.iso_sql('c_time')}
        || '. Maxima: ' || printf('%.1f', temperature) || ' °C, ' || printf('%.2f', vibration) || ' mm/s, '
        || printf('%.1f', current) || ' A.'
      END AS body
    FROM told"""
)
def episode_text(spark, sf_dir):
    """Cascade narratives; matches with a missing reading are rejected."""
    told = E.narrate_matches(cascade_table(spark, sf_dir))
    body = F.when(F.col("reject_reason").isNull(), F.col("body")).alias("body")
    return told.select("machine_id", "detected_at", "reject_reason", body)


@query(
    f"""SELECT 'Machine-' || user_id AS machine_id, {D.iso_sql('ms')} AS detected_at,
      'MissingHeartbeat on Machine-' || user_id || ', occurrence ' || {occurrence_sql("'Machine-' || user_id", 'ms')}
        || ', family connectivity_failure, severity CRITICAL. Silent since heartbeat ' || coalesce(previous_k::VARCHAR, '?')
        || ' of ' || {D.iso_sql('previous_ms')} || ', noticed at ' || {D.iso_sql('ms')} || '; check its network and power.' AS body
    FROM ({D.gaps_sql('event_id', "WHERE event_type <> 'view'").replace(
        "(props ->> '$.k')::BIGINT AS k", "CASE WHEN event_type <> 'signup' THEN (props ->> '$.k')::BIGINT END AS k")})"""
)
def heartbeat_text(spark, sf_dir):
    found = missing_heartbeats(D.heartbeat_records(events(spark, sf_dir)), 86_400)
    return accepted(E.narrate_matches(_typed(found))).select("machine_id", "detected_at", "body")


@query(
    f"""SELECT {D.iso_sql('ms')} AS detected_at, violation_type,
      'EDISequenceViolation on EDI-System, occurrence ' || {occurrence_sql("'EDI-System'", 'ms')}
        || ', family edi_compliance, severity HIGH. Order ' || CASE WHEN order_id = '' THEN 'not named' ELSE order_id END
        || ' broke rule ' || violation_type || ', noticed at ' || {D.iso_sql('ms')} || '. Messages: '
        || CASE WHEN violation_type = 'invoice_without_shipment' THEN 'order, invoice' ELSE kind END || '.' AS body
    FROM ({D.ORDER_MATCHES_SQL}) WHERE violation_type IS NOT NULL"""
)
def order_flow_text(spark, sf_dir):
    found = order_violations(D.order_records(events(spark, sf_dir)), D.DAY_MS)
    return accepted(E.narrate_matches(_typed(found))).select("detected_at", "violation_type", "body")


def interventions(spark, sf_dir) -> DataFrame:
    """Purchases as maintenance actions; cheap ones have a type that is not allowed."""
    value, kind = F.col("value"), F.col("event_type")
    action = F.when(value > 60, "bearing_replacement").when(value > 20, "lubrication").otherwise("polishing")
    return events(spark, sf_dir).filter(kind == "purchase").select(
        F.concat(F.lit("act-"), F.col("event_id")).alias("intervention_id"),
        F.concat(F.lit("Machine-"), F.col("user_id")).alias("machine_id"),
        action.alias("intervention_type"),
        F.timestamp_millis(F.floor(F.col("ms") / 1000) * 1000).alias("performed_at"),
        F.when(value > 30, F.concat(F.lit("crew "), F.col("user_id"))).alias("performed_by"),
        F.when(value > 40, F.col("props")).alias("notes"),
        F.when(value > 100, "ThermalVibrationCascade").alias("target_pattern_name"),
    )


@query(
    """SELECT 'act-' || event_id AS intervention_id,
      CASE WHEN value <= 20 THEN 'unknown intervention type: polishing' END AS reject_reason,
      CASE WHEN value > 20 THEN 'Machine-' || user_id || ' serviced: '
        || CASE WHEN value > 60 THEN 'bearing replacement' ELSE 'lubrication' END
        || CASE WHEN value > 100 THEN ', against ThermalVibrationCascade' ELSE '' END
        || ', record act-' || event_id || ', time ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00, by '
        || CASE WHEN value > 30 THEN 'crew ' || user_id ELSE 'someone not recorded' END || '.'
        || CASE WHEN value > 40 THEN ' Remarks: ' || props ELSE '' END END AS body
    FROM events WHERE event_type = 'purchase'"""
)
def intervention_text(spark, sf_dir):
    told = E.narrate_interventions(interventions(spark, sf_dir))
    body = F.when(F.col("reject_reason").isNull(), F.col("body")).alias("body")
    return told.select("intervention_id", "reject_reason", body)


@query(
    """SELECT 'PERFORMED_ON' AS name, 'act-' || event_id AS source, 'Machine-' || user_id AS target, 'intervention' AS episode_type
    FROM events WHERE event_type = 'purchase' AND value > 20
    UNION ALL SELECT 'TARGETED', 'act-' || event_id, 'ThermalVibrationCascade', 'intervention'
    FROM events WHERE event_type = 'purchase' AND value > 100"""
)
def intervention_facts(spark, sf_dir):
    """Facts of allowed interventions, each with the type of the episode it came from."""
    told = accepted(E.narrate_interventions(interventions(spark, sf_dir)))
    kinds = E.intervention_episodes(told).select("episode_id", "episode_type")
    facts = G.intervention_facts(told).withColumn("episode_id", F.get("episodes", F.lit(0)))
    return facts.join(kinds, "episode_id").select("name", "source", "target", "episode_type")



@query(
    """SELECT sha256('["alert-' || doc_id || '","DETECTED_WITH"]') AS fact_id, source AS group_id, lang AS pattern, length(text) AS fact_length,
      sha256('["agent_alert","' || source || '","alert-' || doc_id || '"]') AS episode_id, 'AgentAlert alert-' || doc_id || ' on ' || source AS episode_name
    FROM documents WHERE len(regexp_split_to_array(trim(text, E' \\n\\t\\r'), '\\s+')) <= 100"""
)
def alert_facts(spark, sf_dir):
    """Documents as alert summaries: the facts of those that can become an episode, each with its episode."""
    alerts = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("alert-"), "doc_id").alias("alert_id"),
        F.col("source").alias("machine_id"),
        F.col("lang").alias("pattern_name"),
        F.timestamp_seconds("doc_id").alias("detected_ts"),
        F.timestamp_seconds("doc_id").alias("alerted_at"),
        F.col("text").alias("summary"),
    )
    told = accepted(E.check_alerts(alerts))
    facts = G.alert_facts(told).withColumn("episode_id", F.get("episodes", F.lit(0)))
    names = E.alert_episodes(told).select("episode_id", F.col("name").alias("episode_name"))
    return facts.join(names, "episode_id").select(
        "fact_id", "group_id", F.col("source").alias("pattern"), F.length("fact").cast("long").alias("fact_length"), "episode_id", "episode_name"
    )


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT 'Machine-' || m.user_id AS machine_id, {D.iso_sql('c_time')} AS detected_at, 'rolling_mill' AS machine_type, 'error' AS kind
    FROM matched m"""
)
def match_payloads(spark, sf_dir):
    """What a match keeps of its source events beyond the typed view, read back from its message."""
    found = cascades(D.telemetry_records(events(spark, sf_dir)), D.machine_baselines(spark, sf_dir), D.THREE_DAYS_MS)
    value = M.match_messages(found, "plant").select("key", F.from_json("value", "detected_at string, source_events array<string>").alias("v"))
    first, last = (F.col("v.source_events")[i] for i in (0, 2))
    hot = F.get_json_object(first, "$.sensors.temperature_c").cast("double") > 380
    return value.select(
        F.col("key").alias("machine_id"),
        F.get_json_object(last, "$.event_time").alias("detected_at"),
        F.get_json_object(first, "$.machine_type").alias("machine_type"),
        F.when(hot, "error").alias("kind"),
    )


@query(
    rf"""SELECT conv_id, turn, n_words, CASE WHEN n_words > 100 THEN 'episode of ' || n_words || ' words, limit 100' END AS reject_reason
    FROM (SELECT conv_id, turn, (len(regexp_split_to_array(trim(text, E' \n\t\r'), '\s+'))
      - CASE WHEN trim(text, E' \n\t\r') = '' THEN 1 ELSE 0 END)::INTEGER AS n_words FROM conversations)"""
)
def word_cap(spark, sf_dir):
    """Turns that would be rejected as too long for an episode."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", word_count(F.col("text")).alias("n_words"), E.too_long(F.col("text")).alias("reject_reason")
    )


@query(
    r"""SELECT doc_id, CASE WHEN len(w) <= 100 THEN text ELSE array_to_string(w[1:100], ' ') END AS text
    FROM (SELECT doc_id, text, regexp_split_to_array(trim(text, E' \n\t\r'), '\s+') AS w FROM documents)"""
)
def word_truncate(spark, sf_dir):
    """Documents cut to 100 words; shorter ones unchanged."""
    return table(spark, sf_dir, "documents").select("doc_id", E.clipped(F.col("text")).alias("text"))


# ---- entities -----------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}, {CASCADE_ROWS_SQL}
    SELECT {occurrence_sql('machine_id', 'c_time')} AS occurrence_id, machine_id, c_time AS detected_ms,
      temperature AS peak_temperature_c, vibration AS peak_vibration_rms_mm_s, current AS peak_current_a,
      (c_time - a_time) / 1000.0::DOUBLE AS cascade_duration_seconds
    FROM told"""
)
def occurrence_entities(spark, sf_dir):
    found = G.occurrences(cascade_table(spark, sf_dir))
    return found.select(
        "occurrence_id",
        "machine_id",
        F.unix_millis("detected_at").alias("detected_ms"),
        "peak_temperature_c",
        "peak_vibration_rms_mm_s",
        "peak_current_a",
        "cascade_duration_seconds",
    )


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL},
    acts AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 20),
    mentions AS (
      SELECT 'Machine' AS label, 'Machine-' || user_id AS name FROM matched
      UNION ALL SELECT 'Pattern', 'ThermalVibrationCascade' FROM matched
      UNION ALL SELECT 'PatternOccurrence', {occurrence_sql("'Machine-' || user_id", 'c_time')} FROM matched
      UNION ALL SELECT 'Machine', 'Machine-' || user_id FROM acts
      UNION ALL SELECT 'Intervention', 'act-' || event_id FROM acts
      UNION ALL SELECT 'Pattern', 'ThermalVibrationCascade' FROM acts WHERE value > 100)
    SELECT 'node ' || label AS kind, count(DISTINCT name) AS n FROM mentions GROUP BY label
    UNION ALL SELECT 'edge MENTIONS', count(*) FROM mentions
    UNION ALL SELECT 'edge DETECTED_ON', count(*) FROM matched
    UNION ALL SELECT 'edge EXPERIENCED_PATTERN', count(*) FROM matched"""
)
def graph_census(spark, sf_dir):
    """Nodes by label and edges by type of the memory graph."""
    matches = cascade_table(spark, sf_dir)
    acts = accepted(E.narrate_interventions(interventions(spark, sf_dir)))
    mentions = G.match_mentions(matches).unionByName(G.intervention_mentions(acts))
    labels = G.census(G.nodes(mentions), "label").select(F.concat(F.lit("node "), F.col("label")).alias("kind"), "n")
    facts = G.census(G.match_facts(matches), "name").select(F.concat(F.lit("edge "), F.col("name")).alias("kind"), "n")
    total = mentions.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge MENTIONS").alias("kind"), "n")
    return labels.unionByName(facts).unionByName(total)


@query(
    f"""SELECT pattern_name, pattern_family, severity_default, count(*) AS n FROM (
      SELECT 'MissingHeartbeat' AS pattern_name, 'connectivity_failure' AS pattern_family, 'CRITICAL' AS severity_default
      UNION ALL SELECT 'EDISequenceViolation', 'edi_compliance', 'HIGH') GROUP BY ALL"""
)
def pattern_entities(spark, sf_dir):
    """The patterns seen in heartbeat and order-flow matches, each once."""
    found = missing_heartbeats(D.heartbeat_records(events(spark, sf_dir)), 86_400).unionByName(
        order_violations(D.order_records(events(spark, sf_dir)), D.DAY_MS)
    )
    return G.patterns(found).groupBy("pattern_name", "pattern_family", "severity_default").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT DISTINCT 'Machine-' || user_id AS machine_id, 'rolling_mill' AS machine_type, 'rolling_mill' AS process_position FROM matched"""
)
def machine_entities(spark, sf_dir):
    return G.machines(cascade_table(spark, sf_dir))


def sales_mentions(spark, sf_dir) -> DataFrame:
    """Orders as episodes that mention their customer, parts and suppliers."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")

    def mention(df, episode, label, name):
        return df.select(
            F.col(episode).cast("string").alias("episode_id"),
            F.lit(label).alias("label"),
            F.col(name).cast("string").alias("name"),
        )

    return (
        mention(orders, "o_orderkey", "Customer", "o_custkey")
        .unionByName(mention(lines, "l_orderkey", "Part", "l_partkey"))
        .unionByName(mention(lines, "l_orderkey", "Supplier", "l_suppkey"))
    )


@query(
    """SELECT 'Customer' AS label, count(DISTINCT o_custkey) AS n FROM orders
    UNION ALL SELECT 'Part', count(DISTINCT l_partkey) FROM lineitem
    UNION ALL SELECT 'Supplier', count(DISTINCT l_suppkey) FROM lineitem"""
)
def entity_counts(spark, sf_dir):
    return G.census(G.nodes(sales_mentions(spark, sf_dir)), "label")


@query(
    """SELECT o_custkey::VARCHAR AS customer, count(*) AS mentions, count(DISTINCT l_partkey) AS parts
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey"""
)
def two_hop(spark, sf_dir):
    """Customer <- order -> part over the whole graph, counted per customer."""
    found = G.co_mentions(sales_mentions(spark, sf_dir), "Customer", "Part")
    return found.groupBy(F.col("left_name").alias("customer")).agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("right_name").alias("parts")
    )


@query(
    """SELECT o_custkey::VARCHAR AS left_name, o_orderkey::VARCHAR AS episode_id, l_partkey::VARCHAR AS right_name
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey ORDER BY 1, 2, 3 LIMIT 20"""
)
def two_hop_first(spark, sf_dir):
    """The first 20 paths, as the graph view shows them."""
    return G.co_mentions(sales_mentions(spark, sf_dir), "Customer", "Part", limit=20)


@query(
    """SELECT o_custkey::VARCHAR AS entity, o_orderkey::VARCHAR AS episode_id, o_orderstatus AS episode_type
    FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY 1, 2 LIMIT 30"""
)
def kind_hop(spark, sf_dir):
    """The first 30 customer mentions in finished or pending orders."""
    episodes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("episode_id"),
        F.col("o_orderstatus").alias("episode_type"),
        F.col("o_orderdate").alias("reference_time"),
    )
    found = G.mentioned_in(sales_mentions(spark, sf_dir), episodes, "Customer", None, ["F", "P"], 30)
    return found.select("entity", "episode_id", "episode_type")


# ---- gate and alerts ----------------------------------------------------------------------


def scored_events(spark, sf_dir) -> DataFrame:
    """Every event with a confidence from its value and up to four anchors from its counter."""
    count = F.expr("cast(cast(get_json_object(props, '$.k') as int) div 20 as int)")
    anchors = F.when(count > 0, F.array_repeat(F.lit("anchor"), count)).otherwise(F.array().cast("array<string>"))
    return events(spark, sf_dir).select(
        "event_id",
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence_raw"),
        anchors.alias("confidence_anchors"),
        (F.col("event_type") == "purchase").alias("has_outcome"),
    )


GATE_SQL = """
    SELECT event_id, confidence_raw, n, third AS confidence_final, concat_ws(',',
      CASE WHEN n = 0 THEN 'no_anchors' END,
      CASE WHEN first >= 0.7::DOUBLE AND n < 3 THEN 'insufficient_anchors_for_tier' END,
      CASE WHEN second >= 0.9::DOUBLE AND NOT has_outcome THEN 'missing_outcome_for_tier' END) AS flags
    FROM (SELECT *, CASE WHEN second >= 0.9::DOUBLE AND NOT has_outcome THEN least(second, 0.8::DOUBLE) ELSE second END AS third
    FROM (SELECT *, CASE WHEN first >= 0.7::DOUBLE AND n < 3 THEN least(first, 0.6::DOUBLE) ELSE first END AS second
    FROM (SELECT *, CASE WHEN n = 0 THEN least(confidence_raw, 0.3::DOUBLE) ELSE confidence_raw END AS first
    FROM (SELECT event_id, least(1.0::DOUBLE, value / 100) AS confidence_raw, (props ->> '$.k')::INTEGER // 20 AS n,
      event_type = 'purchase' AS has_outcome FROM events))))"""


@query(f"SELECT event_id, confidence_final, flags FROM ({GATE_SQL})")
def confidence_gate(spark, sf_dir):
    gated = A.gate_confidence(scored_events(spark, sf_dir), F.col("has_outcome"))
    return gated.select("event_id", "confidence_final", F.array_join("validation_flags", ",").alias("flags"))


@query(
    f"""SELECT count(*) AS alerts, count(*) FILTER (WHERE confidence_final < confidence_raw) AS downgraded,
      round(avg(confidence_raw), 6) AS mean_raw, round(avg(confidence_final), 6) AS mean_final, min(n) AS min_anchors
    FROM ({GATE_SQL})"""
)
def alert_report(spark, sf_dir):
    report = A.alert_report(A.gate_confidence(scored_events(spark, sf_dir), F.col("has_outcome")))
    return report.drop("downgraded_share", "grounded_share").withColumns({c: F.round(c, 6) for c in ("mean_raw", "mean_final")})


def conversation_history(spark, sf_dir) -> DataFrame:
    """Every five turns of a conversation as a match with these turns as its retrieved episodes."""
    kinds = F.create_map(*[F.lit(x) for x in ("user", "pattern_occurrence", "assistant", "intervention", "system", "outcome")])
    episode = F.struct(
        "turn",
        F.col("role").alias("name"),
        F.col("text").alias("content"),
        kinds[F.col("role")].alias("episode_type"),
        F.timestamp_seconds("turn").alias("occurred_at"),
        F.lit(0.5).alias("reranker_score"),
        F.col("turn").alias("retrieval_rank"),
        F.lit(None).cast("struct<edge_uuid:string,source_episode_uuids:array<string>>").alias("metadata"),
    )
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id", F.expr("turn div 5").alias("part"))
        .agg(F.sort_array(F.collect_list(episode)).alias("_e"))
        .select(
            "conv_id",
            "part",
            F.concat(F.lit("Machine-"), F.col("conv_id")).alias("machine_id"),
            F.lit("the").alias("pattern_name"),
            F.lit("HIGH").alias("severity"),
            F.timestamp_seconds("conv_id").alias("detected_ts"),
            F.sha2(F.col("conv_id").cast("string"), 256).alias("match_id"),
            F.transform("_e", lambda e: e.dropFields("turn")).alias("retrieved_episodes"),
        )
    )


@query(
    """SELECT conv_id, part, raw AS confidence_raw, CASE WHEN anchors = 0 THEN least(raw, 0.3::DOUBLE) WHEN raw >= 0.7::DOUBLE AND anchors < 3 THEN 0.6::DOUBLE ELSE raw END AS confidence_final, anchors AS n_anchors
    FROM (SELECT *, CASE WHEN similar_n >= 3 AND outcomes > 0 AND interventions > 0 THEN 0.9::DOUBLE
        WHEN similar_n >= 3 AND outcomes > 0 THEN 0.7::DOUBLE WHEN similar_n >= 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS raw
      FROM (SELECT conv_id, turn // 5 AS part, count(*) FILTER (WHERE role = 'user' AND contains(text, 'the')) AS similar_n,
          count(*) FILTER (WHERE role = 'system') AS outcomes, count(*) FILTER (WHERE role = 'assistant') AS interventions,
          count(*) FILTER (WHERE contains(text, 'the')) AS anchors
        FROM conversations GROUP BY ALL))"""
)
def evidence_rubric(spark, sf_dir):
    """The offline scorer and the gate over all turns, five at a time."""
    gated = A.gate_confidence(A.score_by_rubric(conversation_history(spark, sf_dir)))
    return gated.select(
        "conv_id", "part", "confidence_raw", "confidence_final", F.size("confidence_anchors").cast("long").alias("n_anchors")
    )


@query(
    """SELECT conv_id, turn // 5 AS part, count(*) AS n_history, count(*) FILTER (WHERE role = 'assistant') AS n_interventions,
      arg_min(text, turn) AS first_content
    FROM conversations GROUP BY ALL"""
)
def evidence_payload(spark, sf_dir):
    """The JSON document for an external scorer, read back."""
    document = A.evidence_payload(F.array().cast("array<string>"))
    shape = "pattern_match struct<machine_id:string>, retrieved_history array<struct<content:string,episode_type:string>>"
    read = conversation_history(spark, sf_dir).select("conv_id", "part", F.from_json(document, shape).alias("d"))
    held = F.col("d.retrieved_history")
    return read.select(
        "conv_id",
        "part",
        F.size(held).cast("long").alias("n_history"),
        F.size(F.filter(held, lambda e: e["episode_type"] == "intervention")).cast("long").alias("n_interventions"),
        held[0]["content"].alias("first_content"),
    )


@query(
    r"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'response is not JSON' WHEN length(text) > 400 THEN 'response lacks confidence' END AS reject_reason,
      CASE WHEN role <> 'user' THEN regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') END AS reasoning,
      CASE WHEN role <> 'user' THEN 1 END AS n_anchors,
      CASE WHEN role <> 'user' AND length(text) <= 400 THEN least(1.0::DOUBLE, turn / 4.0::DOUBLE) END AS confidence_raw
    FROM conversations"""
)
def response_parse(spark, sf_dir):
    """Assistant and system turns as fenced scorer responses, user turns as plain text."""
    body = F.to_json(
        F.struct(
            F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("reasoning"),
            F.array(F.lit(" seen before "), F.lit("  ")).alias("confidence_anchors"),
            F.when(F.length("text") <= 400, F.col("turn") / 4.0).alias("confidence"),
            F.lit("check the mill").alias("alert_text"),
        )
    )
    response = F.when(F.col("role") == "user", F.col("text")).otherwise(sentence("```json\n", body, "\n```"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("response"))
    parsed = A.parse_responses(turns, "response")
    answered = F.coalesce(F.col("reject_reason"), F.lit("")) != "response is not JSON"
    return parsed.select(
        "conv_id",
        "turn",
        "reject_reason",
        F.when(answered, F.col("reasoning")).alias("reasoning"),
        F.when(answered, F.size("confidence_anchors")).alias("n_anchors"),
        "confidence_raw",
    )


@query(
    r"""SELECT doc_id, CASE WHEN len(w) <= 100 THEN full_text ELSE array_to_string(w[1:100], ' ') END AS summary
    FROM (SELECT doc_id, full_text, regexp_split_to_array(trim(full_text, E' \n\t\r'), '\s+') AS w
      FROM (SELECT d.doc_id, source || ': ' || lang || ' alert for ' || strftime(make_timestamp(d.doc_id * 1000000), '%Y-%m-%dT%H:%M:%S')
          || '+00:00, confidence ' || CASE WHEN quality = 1 THEN '0.30' ELSE '0.20' END || '. ' || text || ' Gate: no_anchors.' AS full_text
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""
)
def alert_summary(spark, sf_dir):
    """Alert texts of up to 20 000 words, with flags, cut to 100 words."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(
        "doc_id",
        F.col("source").alias("machine_id"),
        F.col("lang").alias("pattern_name"),
        F.timestamp_seconds("doc_id").alias("detected_ts"),
        F.when(F.col("quality") == 1, 0.8).otherwise(0.2).alias("confidence_raw"),
        F.array().cast("array<string>").alias("confidence_anchors"),
        F.col("text").alias("alert_text"),
    )
    gated = A.gate_confidence(rows, F.lit(False))
    return gated.select("doc_id", A.alert_summary().alias("summary"))


MATCH_ID_SQL = r"""sha256('["ThermalVibrationCascade","Machine-' || user_id || '","' || c_time || '","","[\"\"]","[\"\"]"]')"""


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT 'train-machine-' || user_id || '-' || {MATCH_ID_SQL} AS record_id, 'Machine-' || user_id AS machine_id,
      c_time AS detected_ms, 3 AS n_source_events, 0 AS n_retrieved, 0.3::DOUBLE AS confidence_raw, 0.3::DOUBLE AS confidence_final,
      'no_anchors' AS flags, NULL AS outcome_id
    FROM matched"""
)
def training_records(spark, sf_dir):
    """Records of cascades without any history: a first sighting, capped by the gate."""
    record = A.training_records(_first_sightings(spark, sf_dir), M.raw_events(), "offline-rubric")
    return record.select(
        "record_id",
        "machine_id",
        F.unix_millis("detected_at").alias("detected_ms"),
        F.size("pattern_match.source_events").alias("n_source_events"),
        F.size("retrieved_episodes").alias("n_retrieved"),
        "confidence_raw",
        "confidence_final",
        F.array_join("validation_flags", ",").alias("flags"),
        "outcome_id",
    )


def _first_sightings(spark, sf_dir) -> DataFrame:
    nothing = F.array().cast(
        "array<struct<name:string,content:string,episode_type:string,occurred_at:timestamp,reranker_score:double,"
        "retrieval_rank:int,metadata:struct<edge_uuid:string,source_episode_uuids:array<string>>>>"
    )
    return A.gate_confidence(
        A.score_by_rubric(cascade_table(spark, sf_dir).withColumn("retrieved_episodes", nothing))
    )


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT 'alert-machine-' || user_id || '-' || {MATCH_ID_SQL} AS alert_id, 'Machine-' || user_id AS machine_id,
      strftime(make_timestamp(c_time * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN c_time % 1000 = 0 THEN '' ELSE strftime(make_timestamp(c_time * 1000), '.%f') END || '+00:00' AS detected_at,
      '2026-01-01T00:00:00+00:00' AS alerted_at, 'CRITICAL' AS severity, 0.3::DOUBLE AS confidence, 0 AS retrieved_episode_count,
      'ThermalVibrationCascade on Machine-' || user_id || '. Nothing on record for this machine.' AS alert_text
    FROM matched"""
)
def alert_records(spark, sf_dir):
    gated = _first_sightings(spark, sf_dir)
    alerted = F.timestamp_seconds(F.lit(1767225600))
    alerts = A.alert_records(gated.withColumn("alert_id", A.alert_id()), alerted)
    ids = gated.select("machine_id", A.isoformat(F.col("detected_ts")).alias("detected_at"), A.alert_id().alias("alert_id"))
    return alerts.join(ids, ["machine_id", "detected_at"]).select(
        "alert_id", "machine_id", "detected_at", "alerted_at", "severity", "confidence", "retrieved_episode_count", "alert_text"
    )


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT 'Machine-' || user_id AS machine_id, count(*) AS n FROM matched GROUP BY user_id"""
)
def alert_dedupe(spark, sf_dir):
    """Every match delivered twice, counted once."""
    once = cascade_table(spark, sf_dir)
    return M.distinct_matches(once.unionByName(once)).groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))


# ---- topics and files ---------------------------------------------------------------------


@query(
    f"""SELECT 'plant.patterns.machine-' || user_id AS topic, count(*) AS n
    FROM ({D.gaps_sql('event_id', "WHERE event_type <> 'view'")}) GROUP BY user_id
    UNION ALL SELECT 'plant.patterns.edi', count(*) FROM ({D.ORDER_MATCHES_SQL}) WHERE violation_type IS NOT NULL"""
)
def match_topics(spark, sf_dir):
    """Match messages written by topic and read back through the pattern of all match topics."""
    path = fresh_path(spark, "topics")
    found = missing_heartbeats(D.heartbeat_records(events(spark, sf_dir)), 86_400).unionByName(
        order_violations(D.order_records(events(spark, sf_dir)), D.DAY_MS)
    )
    append_messages(M.match_messages(found, "plant"), path)
    records = file_records(spark, path, pattern_topics("plant"))
    return accepted(parse_matches(records)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT 'plant.alerts.machine-' || user_id AS topic, 'Machine-' || user_id AS key, count(*) AS n FROM matched GROUP BY user_id"""
)
def alert_topics(spark, sf_dir):
    """Alerts addressed to the topic of their machine, written and read back."""
    path = fresh_path(spark, "alerts")
    append_messages(alert_messages(A.alert_records(_first_sightings(spark, sf_dir)), "plant"), path)
    return file_records(spark, path).groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {D.CASCADES_SQL}
    SELECT strftime(make_timestamp(c_time * 1000), '%Y-%m-%d') AS alert_date, count(*) AS n FROM matched GROUP BY 1"""
)
def training_files(spark, sf_dir):
    """Training records written as one folder of JSON lines per day and read back."""
    path = fresh_path(spark, "training")
    rows = _first_sightings(spark, sf_dir)
    append_training_records(A.training_records(rows, M.raw_events(), "offline-rubric", F.col("detected_ts")), path)
    read = spark.read.schema("record_id string, alert_date date").json(path)
    return read.groupBy(F.col("alert_date").cast("string").alias("alert_date")).agg(F.count("record_id").alias("n"))
