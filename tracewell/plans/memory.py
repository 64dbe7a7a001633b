"""Matches to memory and alerts, as chains of table transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import fixed, sentence
from tracewell.operators import alerts as A
from tracewell.operators import entities as G
from tracewell.operators import episodes as E
from tracewell.operators import matches as M
from tracewell.operators import retrieval as R
from tracewell.operators.lexical import Index
from tracewell.sources.ingest import accepted, parse_matches, rejected


def known_matches(records: DataFrame) -> DataFrame:
    """Valid matches of topic records, each once, with ``match_id``."""
    return M.distinct_matches(M.with_match_id(accepted(parse_matches(records))))


def ingest_matches(records: DataFrame, prefix: str = "occ") -> tuple[DataFrame, DataFrame]:
    """(episodes, rejects) of match records."""
    parsed = parse_matches(records)
    valid = M.with_match_id(accepted(parsed))
    narrated = E.narrate_matches(valid, prefix)
    episodes = E.distinct_episodes(E.match_episodes(accepted(narrated)))
    columns = ["raw_json", "reject_reason"]
    return episodes, rejected(parsed).select(*columns).unionByName(rejected(narrated).select(*columns))


def ingest_interventions(interventions: DataFrame) -> tuple[DataFrame, DataFrame]:
    narrated = E.narrate_interventions(interventions)
    return E.intervention_episodes(accepted(narrated)), rejected(narrated)


def query_text() -> Column:
    """What to search for: pattern, machine and one number, else the severity."""
    hottest = E.peak(F.col("source_events"), "temperature_c")
    anchor = F.coalesce(
        sentence("peak temperature ", fixed(hottest, 1), " C"),
        sentence("severity ", F.coalesce("severity", F.lit("UNKNOWN"))),
    )
    return sentence(F.col("pattern_name"), " on ", F.col("machine_id"), " with ", anchor)


def match_queries(matches: DataFrame) -> DataFrame:
    """One search query per match, scoped to its machine."""
    return matches.select(
        F.col("match_id").alias("query_id"), F.col("machine_id").alias("group_id"), query_text().alias("text")
    )


def match_query_entities(matches: DataFrame) -> DataFrame:
    return matches.select(
        F.col("match_id").alias("query_id"), F.explode(F.array("machine_id", "pattern_name")).alias("entity")
    )


def retrieve(
    matches: DataFrame,
    facts: DataFrame,
    episodes: DataFrame,
    scorer: R.Scorer = R.term_overlap,
    index: Index | None = None,
) -> DataFrame:
    """Matches with their ``retrieved_episodes``, both tiers; the lexical ranking reads ``index`` where there is one."""
    found = R.two_tier_history(
        match_queries(matches),
        facts,
        episodes,
        scorer=scorer,
        query_entities=match_query_entities(matches),
        fact_entities=G.fact_entities(facts),
        index=index,
    )
    return R.attach_history(matches, found)


def raise_alerts(retrieved: DataFrame, score=A.score_by_rubric) -> DataFrame:
    """Scored and gated matches with ``alert_id`` and ``summary``."""
    gated = A.gate_confidence(score(retrieved))
    return gated.withColumn("alert_id", A.alert_id()).withColumn("summary", A.alert_summary())
