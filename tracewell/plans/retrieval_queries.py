"""Registered queries: lexical, dense and entity rankings, fusion, type filter, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import alerts as A
from tracewell.operators import entities as G
from tracewell.operators import episodes as E
from tracewell.operators import matches as M
from tracewell.operators import retrieval as R
from tracewell.plans import detection_queries as D
from tracewell.plans import memory
from tracewell.plans.catalog import query, spread, table
from tracewell.plans.memory_queries import CASCADE_ROWS_SQL, cascade_table
from tracewell.sources.ingest import accepted
from tracewell.storage import checkpointed, written

TERMS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')"
BM25_SQL = rf"""
    tokens AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
    lengths AS (SELECT d.doc_id, count(t.term) AS length
      FROM documents d LEFT JOIN (SELECT * FROM tokens WHERE term <> '') t ON t.doc_id = d.doc_id GROUP BY d.doc_id),
    corpus AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean_length FROM lengths),
    asked AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) WHERE term <> ''),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
    idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, corpus GROUP BY term, n),
    lexical AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, tf.doc_id, round(sum(idf * (tf * 2.2::DOUBLE
          / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length)))), 6) AS score
        FROM asked JOIN tf ON tf.term = asked.term JOIN idf ON idf.term = tf.term JOIN lengths ON lengths.doc_id = tf.doc_id, corpus
        GROUP BY query_id, tf.doc_id))"""


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def benchmark_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM lexical WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents for every benchmark text."""
    ranked = R.bm25_topk(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 10)
    return ranked.select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH {BM25_SQL} SELECT * FROM (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id, score FROM lexical WHERE doc_id <= query_id * 5 + 100)) WHERE rank <= 10"""
)
def bm25_as_of(spark, sf_dir):
    """The ten best of the documents that were there when the query was asked."""
    docs = documents(spark, sf_dir).withColumn("valid_at", F.timestamp_seconds("doc_id"))
    asked = benchmark_queries(spark, sf_dir).withColumn("as_of", F.timestamp_seconds(F.col("query_id") * 5 + 100))
    return R.bm25_topk(docs, asked, 10).select("query_id", "doc_id", "score", "rank")


def cosine_sql(asked: str) -> str:
    return f"""
    asked AS ({asked}),
    dense AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score
        FROM embeddings CROSS JOIN asked))"""


@query(
    f"""WITH {cosine_sql("SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label")}
    SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 10"""
)
def cosine_topk(spark, sf_dir):
    """The ten nearest vectors to the first vector of every label."""
    asked = (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
    )
    return R.cosine_topk(vectors(spark, sf_dir), asked, 10).select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH {cosine_sql("SELECT vec_id AS query_id, label, embedding AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
        .replace("FROM embeddings CROSS JOIN asked", "FROM embeddings JOIN asked ON asked.label = embeddings.label")}
    SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 5"""
)
def cosine_in_group(spark, sf_dir):
    """Nearest vectors within the label, for the vectors of the benchmark items."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    grouped = table(spark, sf_dir, "embeddings").withColumn("group_id", F.col("label").cast("string"))
    asked = grouped.join(items, "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    docs = grouped.withColumnRenamed("vec_id", "doc_id")
    return R.cosine_topk(docs, asked, 5, by_group=True).select("query_id", "doc_id", "score", "rank")


@query(
    """WITH asked AS (
      SELECT s_suppkey AS query_id, 'nation ' || s_nationkey AS entity FROM supplier
      UNION ALL SELECT s_suppkey, 'segment BUILDING' FROM supplier WHERE s_acctbal > 0),
    held AS (
      SELECT c_custkey AS doc_id, 'nation ' || c_nationkey AS entity FROM customer
      UNION ALL SELECT c_custkey, 'segment ' || c_mktsegment FROM customer)
    SELECT query_id, doc_id, shared, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, count(*)::DOUBLE AS shared FROM asked JOIN held ON held.entity = asked.entity GROUP BY query_id, doc_id))
    WHERE rank <= 5"""
)
def shared_entity_topk(spark, sf_dir):
    """For every supplier the five customers it shares most entities with."""
    supplier = table(spark, sf_dir, "supplier")
    customer = table(spark, sf_dir, "customer")
    building = F.when(F.col("s_acctbal") > 0, F.lit("segment BUILDING"))
    asked = supplier.select(
        F.col("s_suppkey").alias("query_id"),
        F.explode(F.array_compact(F.array(F.concat(F.lit("nation "), "s_nationkey"), building))).alias("entity"),
    )
    held = customer.select(
        F.col("c_custkey").alias("doc_id"),
        F.explode(F.array(F.concat(F.lit("nation "), "c_nationkey"), F.concat(F.lit("segment "), "c_mktsegment"))).alias("entity"),
    )
    return R.shared_entity_topk(asked, held, 5).select("query_id", "doc_id", F.col("score").alias("shared"), "rank")


@query(
    f"""WITH {BM25_SQL}, {cosine_sql("SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
        .replace("asked AS", "wanted AS").replace("CROSS JOIN asked", "CROSS JOIN wanted")}
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
          SELECT query_id, doc_id, rank FROM lexical WHERE rank <= 30
          UNION ALL SELECT query_id, doc_id, rank FROM dense WHERE rank <= 30)
        GROUP BY query_id, doc_id)) WHERE rank <= 10"""
)
def rrf_topk(spark, sf_dir):
    """Lexical and dense rankings of every benchmark item, fused."""
    asked = benchmark_queries(spark, sf_dir)
    wanted = vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id").join(asked.select("query_id"), "query_id", "left_semi")
    rankings = [
        R.bm25_topk(documents(spark, sf_dir), asked, 30),
        R.cosine_topk(vectors(spark, sf_dir), wanted, 30),
    ]
    return R.fuse_rankings(rankings, 10).select("query_id", "doc_id", "score", "rank")


KINDS_SQL = "CASE lang WHEN 'en' THEN 'pattern_occurrence' WHEN 'fr' THEN 'intervention' WHEN 'de' THEN 'agent_alert' WHEN 'es' THEN 'outcome' END"


def document_episodes(spark, sf_dir) -> DataFrame:
    """Documents as episodes whose type follows the language."""
    kinds = {"en": "pattern_occurrence", "fr": "intervention", "de": "agent_alert", "es": "outcome"}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("episode_id"), names[F.col("lang")].alias("episode_type")
    )


def lexical_candidates(spark, sf_dir) -> DataFrame:
    """Thirty lexical candidates per benchmark text, with the type of their source."""
    asked = benchmark_queries(spark, sf_dir)
    found = R.bm25_topk(documents(spark, sf_dir), asked, 30).select("query_id", "doc_id", (F.col("rank") - 1).alias("retrieval_rank"))
    found = checkpointed(found)
    facts = found.select("doc_id").distinct().select(
        F.col("doc_id").cast("string").alias("fact_id"), F.array(F.lit("gone"), F.col("doc_id").cast("string")).alias("episodes")
    )
    typed = R.with_episode_type(facts, document_episodes(spark, sf_dir)).select(F.col("fact_id").cast("long").alias("doc_id"), "episode_type")
    return (
        found.join(typed, "doc_id")
        .join(documents(spark, sf_dir).withColumnRenamed("text", "content"), "doc_id")
        .join(asked.withColumnRenamed("text", "query_text"), "query_id")
    )


OVERLAP_SQL = rf"""{BM25_SQL},
    candidates AS (
      SELECT query_id, l.doc_id, rank - 1 AS retrieval_rank, {KINDS_SQL} AS episode_type, b.text AS query_text, d.text AS content
      FROM lexical l JOIN documents d ON d.doc_id = l.doc_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 30),
    doc_terms AS (SELECT doc_id, count(DISTINCT term) AS n FROM tokens WHERE term <> '' GROUP BY doc_id),
    ask_terms AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
    shared AS (SELECT query_id, doc_id, count(*) AS n FROM asked JOIN tf ON tf.term = asked.term GROUP BY query_id, doc_id),
    overlap AS (
      SELECT c.query_id, c.doc_id, c.retrieval_rank, c.episode_type,
        round(coalesce(s.n / sqrt((a.n * t.n)::DOUBLE), 0), 6) AS reranker_score
      FROM candidates c LEFT JOIN shared s ON s.query_id = c.query_id AND s.doc_id = c.doc_id
      LEFT JOIN ask_terms a ON a.query_id = c.query_id LEFT JOIN doc_terms t ON t.doc_id = c.doc_id)"""


@query(
    f"""WITH {OVERLAP_SQL} SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, retrieval_rank) AS rank FROM overlap)
    WHERE rank <= 5"""
)
def rerank_topk(spark, sf_dir):
    """Candidates of any type, reranked by term overlap."""
    ranked = R.rerank(lexical_candidates(spark, sf_dir), k=5)
    return ranked.select("query_id", "doc_id", "retrieval_rank", "episode_type", "reranker_score", "rank")


@query(
    f"""WITH {OVERLAP_SQL} SELECT query_id, doc_id, retrieval_rank, episode_type, reranker_score, tier, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY reranker_score DESC, retrieval_rank) AS rank FROM (
        SELECT *, CASE WHEN episode_type = 'agent_alert' THEN 2 ELSE 1 END AS tier FROM overlap WHERE episode_type IS NOT NULL))
    WHERE rank <= CASE tier WHEN 1 THEN 4 ELSE 1 END"""
)
def typed_two_tier(spark, sf_dir):
    """Type filter after the candidate cut: four results of the first tier, one of the second."""
    found = R.in_tiers(lexical_candidates(spark, sf_dir), R.TIERS)
    return found.select("query_id", "doc_id", "retrieval_rank", "episode_type", "reranker_score", "tier", "rank")


# Both rankings, fused; then the reranked four of the only type there is.
DETAIL_SQL = """'peak temperature ' || printf('%.1f', temperature) || ' °C, peak vibration ' || printf('%.2f', vibration) || ' mm/s, peak current '
      || printf('%.1f', current) || ' A'"""
FACT_ID_SQL = """sha256('["' || match_id || '","{name}"]')"""
HISTORY_SQL = rf"""
    WITH RECURSIVE {D.CASCADES_SQL}, {CASCADE_ROWS_SQL},
    m AS (SELECT *, sha256('["ThermalVibrationCascade","' || machine_id || '","' || c_time || '","","[\"\"]","[\"\"]"]') AS match_id FROM told),
    facts AS (
      SELECT {FACT_ID_SQL.format(name='DETECTED_ON')} AS doc_id, machine_id,
        machine_id || ' showed ThermalVibrationCascade, ' || {DETAIL_SQL} AS text FROM m WHERE NOT lacking
      UNION ALL SELECT {FACT_ID_SQL.format(name='EXPERIENCED_PATTERN')}, machine_id,
        'ThermalVibrationCascade recorded for ' || machine_id || ' at ' || {D.iso_sql('c_time')} || ', ' || {DETAIL_SQL} || '.'
        FROM m WHERE NOT lacking),
    questions AS (SELECT match_id, machine_id, 'ThermalVibrationCascade on ' || machine_id || ' with peak temperature '
      || printf('%.1f', temperature) || ' C' AS text FROM m),
    tf AS (SELECT doc_id, machine_id, term, count(*) AS tf
      FROM (SELECT doc_id, machine_id, unnest({TERMS}) AS term FROM facts) WHERE term <> '' GROUP BY ALL),
    lengths AS (SELECT doc_id, sum(tf)::DOUBLE AS length, count(*) AS n_terms FROM tf GROUP BY doc_id),
    corpus AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean_length FROM lengths),
    asked AS (SELECT DISTINCT match_id, machine_id, term
      FROM (SELECT match_id, machine_id, unnest({TERMS}) AS term FROM questions) WHERE term <> ''),
    idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, corpus GROUP BY term, n),
    met AS (SELECT match_id, tf.doc_id, count(*) AS n_shared, round(sum(idf * (tf * 2.2::DOUBLE
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length)))), 6) AS score
      FROM asked JOIN tf ON tf.term = asked.term AND tf.machine_id = asked.machine_id JOIN idf ON idf.term = tf.term
      JOIN lengths ON lengths.doc_id = tf.doc_id, corpus GROUP BY match_id, tf.doc_id),
    ranked AS (
      SELECT match_id, doc_id, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, doc_id) AS rank FROM met
      UNION ALL SELECT match_id, doc_id, row_number() OVER (PARTITION BY match_id ORDER BY doc_id)
      FROM questions q JOIN facts f ON f.machine_id = q.machine_id),
    fused AS (
      SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, doc_id) - 1 AS retrieval_rank FROM (
        SELECT match_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ranked WHERE rank <= 30 GROUP BY ALL)),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY overlap DESC, retrieval_rank) AS rank FROM (
        SELECT f.match_id, f.doc_id, retrieval_rank,
          round(n_shared / sqrt((l.n_terms * (SELECT count(*) FROM asked a WHERE a.match_id = f.match_id))::DOUBLE), 6) AS overlap
        FROM fused f JOIN met ON met.match_id = f.match_id AND met.doc_id = f.doc_id JOIN lengths l ON l.doc_id = f.doc_id
        WHERE retrieval_rank < 30)),
    held AS (SELECT match_id, string_agg(doc_id, ',' ORDER BY rank) AS retrieved, count(*) AS n FROM best WHERE rank <= 4 GROUP BY match_id),
    raised AS (SELECT m.*, coalesce(retrieved, '') AS retrieved, coalesce(h.n, 0) AS n FROM m LEFT JOIN held h ON h.match_id = m.match_id)
    SELECT 'alert-' || lower(machine_id) || '-' || match_id AS alert_id, machine_id, {D.iso_sql('c_time')} AS detected_at,
      CASE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence_raw, CASE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence_final,
      CASE WHEN n > 0 THEN '' ELSE 'no_anchors' END AS flags, retrieved,
      machine_id || ': ThermalVibrationCascade alert for ' || strftime(make_timestamp(c_time * 1000), '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN c_time % 1000 = 0 THEN '' ELSE strftime(make_timestamp(c_time * 1000), '.%f') END
        || '+00:00, confidence ' || CASE WHEN n > 0 THEN '0.50' ELSE '0.30' END
        || '. ThermalVibrationCascade on ' || machine_id || '. ' || CASE WHEN n > 0 THEN n || ' of ' || n
          || ' retrieved episodes describe the same pattern.' ELSE 'Nothing on record for this machine. Gate: no_anchors.' END AS summary
    FROM raised"""


def remembered(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches with the facts and episodes made of them."""
    matches = written(cascade_table(spark, sf_dir), "matches")
    narrated = written(accepted(E.narrate_matches(matches)), "narrated")
    return matches, written(G.match_facts(narrated), "facts"), E.match_episodes(narrated)


def raised(spark, sf_dir) -> DataFrame:
    matches, facts, episodes = remembered(spark, sf_dir)
    return memory.raise_alerts(memory.retrieve(matches, facts, episodes))


@query(HISTORY_SQL)
def history_alerts(spark, sf_dir):
    """The whole chain: matches, facts, two-tier history, score, gate, alert."""
    return raised(spark, sf_dir).select(
        "alert_id",
        "machine_id",
        "detected_at",
        "confidence_raw",
        "confidence_final",
        F.array_join("validation_flags", ",").alias("flags"),
        F.array_join(F.transform("retrieved_episodes", lambda e: e["metadata"]["edge_uuid"]), ",").alias("retrieved"),
        "summary",
    )


@query(
    HISTORY_SQL.rsplit("held AS (", 1)[0].rstrip().rstrip(",")
    + " SELECT match_id AS query_id, rank, doc_id, overlap AS reranker_score, retrieval_rank FROM best WHERE rank <= 5"
)
def history_search(spark, sf_dir):
    """One search over all types for every match: five results, reranked, after the candidate cut."""
    matches, facts, episodes = remembered(spark, sf_dir)
    entities = {"query_entities": memory.match_query_entities(matches), "fact_entities": G.fact_entities(facts)}
    found = R.search_history(memory.match_queries(matches), facts, episodes, **entities)
    return found.select("query_id", "rank", F.col("metadata.edge_uuid").alias("doc_id"), "reranker_score", "retrieval_rank")


# Every alert counts once per kind of output; the number of results is the number of commas and one.
RESULTS_SQL = "CASE WHEN retrieved = '' THEN 0 ELSE len(string_split(retrieved, ',')) END"


@query(
    f"""SELECT count(*) AS alerts, count(*) FILTER (WHERE confidence_final < confidence_raw) AS downgraded,
      round(avg((confidence_final < confidence_raw)::INT), 6) AS downgraded_share, round(avg(confidence_raw), 6) AS mean_raw,
      round(avg(confidence_final), 6) AS mean_final, min({RESULTS_SQL})::INTEGER AS min_anchors,
      round(avg(({RESULTS_SQL} >= 3)::INT), 6) AS grounded_share, count(*) AS alert_episodes, count(*) AS training_records
    FROM ({HISTORY_SQL})"""
)
def alert_run_report(spark, sf_dir):
    """A run in one row: alerts, their episodes and records, caps, confidence and grounding."""
    alerts = written(raised(spark, sf_dir).withColumn("alerted_at", F.col("detected_ts")), "alerts")
    episodes = E.alert_episodes(accepted(E.check_alerts(alerts)))
    records = A.training_records(alerts, M.raw_events(), "offline-rubric")
    report = A.alert_report(alerts, episodes, records)
    return report.withColumns({c: F.round(c, 6) for c in ("downgraded_share", "mean_raw", "mean_final", "grounded_share")})


@query(
    f"""SELECT machine_id, {RESULTS_SQL} AS retrieved_episode_count, confidence_final AS confidence, confidence_raw, flags, count(*) AS n
    FROM ({HISTORY_SQL}) GROUP BY ALL"""
)
def alert_records_with_history(spark, sf_dir):
    """Alert records of matches whose machine has a history, per machine and outcome of the gate."""
    records = A.alert_records(raised(spark, sf_dir)).withColumn("flags", F.array_join("validation_flags", ","))
    return records.groupBy("machine_id", "retrieved_episode_count", "confidence", "confidence_raw", "flags").agg(F.count(F.lit(1)).alias("n"))
