"""Scoring evidence, the confidence gate, alerts and training records.

Input rows are matches with ``retrieved_episodes``, an array of
struct<name, content, episode_type, occurred_at, reranker_score, retrieval_rank, metadata>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import first_words, fixed, sentence
from tracewell.functions.times import isoformat
from tracewell.schemas import MAX_EPISODE_WORDS, SCHEMA_VERSION

# Tier bounds of the evidence rubric and caps of the gate (fixed values).
FIRST_SIGHT_CAP = 0.4
NO_ANCHOR_CAP = 0.3
FEW_ANCHORS_CAP = 0.6
NO_OUTCOME_CAP = 0.8
STRONG_TIER = 0.7
TOP_TIER = 0.9
STRONG_ANCHORS = 3


def evidence_payload(source_events: Column) -> Column:
    """Match and retrieved history as one JSON document for an external scorer."""
    match = F.struct(
        "machine_id",
        "pattern_name",
        "severity",
        isoformat(F.col("detected_ts")).alias("detected_at"),
        source_events.alias("source_events"),
    )
    history = F.transform(
        "retrieved_episodes",
        lambda e: F.struct(
            e["name"].alias("name"),
            e["content"].alias("content"),
            e["episode_type"].alias("episode_type"),
            isoformat(e["occurred_at"]).alias("occurred_at"),
            e["reranker_score"].alias("reranker_score"),
        ),
    )
    return F.to_json(
        F.struct(match.alias("pattern_match"), history.alias("retrieved_history")),
        {"ignoreNullFields": "false"},
    )


def parse_responses(df: DataFrame, response: str) -> DataFrame:
    """Scorer responses to ``reasoning, confidence_anchors, confidence_raw, alert_text``.

    A surrounding code fence is dropped, anchors are trimmed and empty ones left out, confidence is
    clamped to [0, 1]. Responses without the needed keys get a ``reject_reason``.
    """
    text = F.col(response)
    body = _unfenced(text)
    schema = "reasoning string, confidence_anchors array<string>, confidence string, alert_text string"
    parsed = df.withColumn("_r", F.from_json(body, schema)).withColumn("_body", body)
    confidence = F.col("_r.confidence").try_cast("double")
    stripped = F.transform(
        F.coalesce("_r.confidence_anchors", F.array().cast("array<string>")), lambda a: _strip(a)
    )
    absent = F.array_compact(
        F.array(
            *[F.when(F.col(f"_r.{n}").isNull(), F.lit(n)) for n in ("reasoning", "confidence", "alert_text")]
        )
    )
    reason = (
        F.when(text.isNull() | F.try_parse_json("_body").isNull(), "response is not JSON")
        .when(F.size(absent) > 0, sentence("response lacks ", F.array_join(absent, ", ")))
        .when(confidence.isNull(), "confidence is not a number")
    )
    return parsed.select(
        *df.columns,
        _strip(F.col("_r.reasoning")).alias("reasoning"),
        F.filter(stripped, lambda a: a != "").alias("confidence_anchors"),
        F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).alias("confidence_raw"),
        _strip(F.col("_r.alert_text")).alias("alert_text"),
        reason.alias("reject_reason"),
    )


def _unfenced(text: Column) -> Column:
    """Text without the code fence around it; a mark on one side only stays."""
    bare = _strip(text)
    fenced = bare.startswith("```") & bare.endswith("```") & (F.length(bare) >= 6)
    return F.when(fenced, F.regexp_replace(F.regexp_replace(bare, "^`{3}[A-Za-z]*", ""), "`{3}$", "")).otherwise(text)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rubric_features(episodes: Column, pattern: Column) -> dict[str, Column]:
    """How much of the retrieved history supports a match."""
    def count(keep) -> Column:
        return F.coalesce(F.array_size(F.filter(episodes, keep)), F.lit(0))

    def of_type(kind: str):
        return lambda e: e["episode_type"] == kind

    def similar(e: Column) -> Column:
        return of_type("pattern_occurrence")(e) & F.coalesce(e["content"].contains(pattern), F.lit(False))

    return {
        "n_episodes": F.coalesce(F.array_size(episodes), F.lit(0)),
        "n_similar": count(similar),
        "n_interventions": count(of_type("intervention")),
        "n_outcomes": count(of_type("outcome")),
    }


def score_by_rubric(df: DataFrame) -> DataFrame:
    """The offline scorer: confidence is the lower bound of the rubric's tier that applies.

    Stands in for an external scorer; adds the same columns as ``parse_responses``.
    """
    counts = rubric_features(F.col("retrieved_episodes"), F.col("pattern_name"))
    rows = df.withColumns(counts)
    n, outcomes = F.col("n_similar"), F.col("n_outcomes")
    tier = (
        F.when((n >= 3) & (outcomes > 0) & (F.col("n_interventions") > 0), 0.9)
        .when((n >= 3) & (outcomes > 0), 0.7)
        .when(n >= 1, 0.5)
        .otherwise(0.3)
    )
    capped = F.when(F.col("n_episodes") == 0, F.least(tier, F.lit(FIRST_SIGHT_CAP))).otherwise(tier)
    anchors = F.transform(
        F.filter(
            "retrieved_episodes",
            lambda e: F.coalesce(e["content"].contains(F.col("pattern_name")), F.lit(False)),
        ),
        lambda e: e["content"],
    )
    history = (
        F.when(F.col("n_episodes") == 0, F.lit("Nothing on record for this machine."))
        .otherwise(sentence(n.cast("string"), " of ", F.col("n_episodes").cast("string"), " retrieved episodes describe the same pattern."))
    )
    text = sentence(F.col("pattern_name"), " on ", F.col("machine_id"), ". ", history)
    return rows.withColumns(
        {"reasoning": history, "confidence_anchors": anchors, "confidence_raw": capped, "alert_text": text}
    ).drop(*counts)


def gate_confidence(df: DataFrame, has_outcome: Column | None = None) -> DataFrame:
    """Add ``confidence_final`` and ``validation_flags`` from ``confidence_raw`` and the anchors.

    The three caps apply in order to the running value; each one that applies leaves a flag.
    """
    raw = F.coalesce(F.col("confidence_raw").cast("double"), F.lit(0.0))
    count = F.coalesce(F.array_size("confidence_anchors"), F.lit(0))
    if has_outcome is None:
        has_outcome = F.exists("retrieved_episodes", lambda e: e["episode_type"] == "outcome")
    bare = count == 0
    first = F.when(bare, F.least(raw, F.lit(NO_ANCHOR_CAP))).otherwise(raw)
    thin = (first >= STRONG_TIER) & (count < STRONG_ANCHORS)
    second = F.when(thin, F.least(first, F.lit(FEW_ANCHORS_CAP))).otherwise(first)
    unproven = (second >= TOP_TIER) & ~F.coalesce(has_outcome, F.lit(False))
    third = F.when(unproven, F.least(second, F.lit(NO_OUTCOME_CAP))).otherwise(second)
    flags = F.array_compact(
        F.array(
            F.when(bare, "no_anchors"),
            F.when(thin, "insufficient_anchors_for_tier"),
            F.when(unproven, "missing_outcome_for_tier"),
        )
    )
    return df.withColumns({"confidence_final": third, "validation_flags": flags})


def alert_id(prefix: str = "alert") -> Column:
    """The same for every delivery of a match, so that repeats can be told."""
    return sentence(f"{prefix}-", F.lower("machine_id"), "-", F.col("match_id"))


def alert_summary() -> Column:
    """Flags come before the cut to the word ceiling and may fall to it."""
    flags = F.when(
        F.size("validation_flags") > 0,
        sentence(" Gate: ", F.array_join("validation_flags", ", "), "."),
    ).otherwise("")
    text = sentence(
        F.col("machine_id"),
        ": ",
        F.col("pattern_name"),
        " alert for ",
        isoformat(F.col("detected_ts")),
        ", confidence ",
        fixed(F.col("confidence_final"), 2),
        ". ",
        F.coalesce("alert_text", F.lit("")),
        flags,
    )
    return first_words(text, MAX_EPISODE_WORDS)


def alert_records(gated: DataFrame, alerted_at: Column | None = None) -> DataFrame:
    """The alert of each gated match; ``alerted_at`` defaults to the wall clock."""
    now = F.current_timestamp() if alerted_at is None else alerted_at
    return gated.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "machine_id",
        "pattern_name",
        isoformat(F.col("detected_ts")).alias("detected_at"),
        isoformat(now).alias("alerted_at"),
        "severity",
        F.coalesce("alert_text", F.lit("")).alias("alert_text"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.col("confidence_final").alias("confidence"),
        F.coalesce(F.col("confidence_raw").cast("double"), F.lit(0.0)).alias("confidence_raw"),
        "validation_flags",
        F.coalesce(F.array_size("retrieved_episodes"), F.lit(0)).alias("retrieved_episode_count"),
    )


def training_records(gated: DataFrame, source_events: Column, model: str, alerted_at: Column | None = None, prefix: str = "train") -> DataFrame:
    """One record per alert; ``outcome_id`` is filled later by ``fill_outcomes``."""
    now = F.current_timestamp() if alerted_at is None else alerted_at
    detected = isoformat(F.col("detected_ts"))
    held = F.transform(
        "retrieved_episodes",
        lambda e: F.struct(
            e["name"].alias("name"),
            e["content"].alias("content"),
            e["episode_type"].alias("episode_type"),
            isoformat(e["occurred_at"]).alias("occurred_at"),
            e["reranker_score"].alias("reranker_score"),
            e["retrieval_rank"].alias("retrieval_rank"),
            e["metadata"].alias("metadata"),
        ),
    )
    return gated.select(
        sentence(f"{prefix}-", F.lower("machine_id"), "-", F.col("match_id")).alias("record_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "machine_id",
        "pattern_name",
        F.col("detected_ts").alias("detected_at"),
        now.alias("alerted_at"),
        F.struct(
            "machine_id", "pattern_name", "severity", detected.alias("detected_at"), source_events.alias("source_events")
        ).alias("pattern_match"),
        held.alias("retrieved_episodes"),
        "reasoning",
        "confidence_anchors",
        "confidence_raw",
        "confidence_final",
        "validation_flags",
        "alert_text",
        F.lit(model).alias("model"),
        F.lit(None).cast("string").alias("outcome_id"),
    )


def fill_outcomes(records: DataFrame, links: DataFrame) -> DataFrame:
    """Set ``outcome_id`` from (record_id, outcome_id) pairs; records without one keep null."""
    one = links.groupBy("record_id").agg(F.min("outcome_id").alias("_outcome"))
    columns = [F.coalesce("outcome_id", "_outcome").alias("outcome_id") if c == "outcome_id" else F.col(c) for c in records.columns]
    return records.join(one, "record_id", "left").select(*columns)


def alert_report(gated: DataFrame, episodes: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """One row on a run: alerts, their episodes and training records, how many were capped and which share, mean
    confidence before and after, the fewest anchors and the share of alerts with three or more.

    Episodes and records are counted where their tables are given.
    """
    downgraded = F.col("confidence_final") < F.col("confidence_raw")
    anchors = F.size("confidence_anchors")
    share = lambda n: F.coalesce(n / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    report = gated.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(downgraded).alias("downgraded"),
        share(F.count_if(downgraded)).alias("downgraded_share"),
        F.avg("confidence_raw").alias("mean_raw"),
        F.avg("confidence_final").alias("mean_final"),
        F.min(anchors).alias("min_anchors"),
        share(F.count_if(anchors >= 3)).alias("grounded_share"),
    )
    for name, rows in (("alert_episodes", episodes), ("training_records", records)):
        if rows is not None:
            report = report.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return report
