"""Entity tables, MENTIONS and fact edges from matches and interventions, and queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import schemas as S
from tracewell.functions.text import fixed, identity, sentence
from tracewell.operators import episodes as E

# Position of each known machine type on the line (fixed values).
PROCESS_POSITION = {
    "melting_furnace": "furnace",
    "continuous_caster": "caster",
    "rolling_mill": "rolling_mill",
    "annealing_oven": "annealing",
    "finishing_line": "finishing",
}


def machines(matches: DataFrame) -> DataFrame:
    kind = F.get("source_events", F.lit(0))["machine_type"]
    positions = F.create_map(*[F.lit(x) for pair in PROCESS_POSITION.items() for x in pair])
    return (
        matches.select("machine_id", kind.alias("machine_type"))
        .groupBy("machine_id")
        .agg(F.max("machine_type").alias("machine_type"))
        .withColumn("process_position", positions[F.col("machine_type")])
    )


def patterns(matches: DataFrame) -> DataFrame:
    defaults = F.create_map(*[F.lit(x) for pair in S.DEFAULT_SEVERITY.items() for x in pair])
    return matches.select("pattern_name").distinct().select(
        "pattern_name",
        E.pattern_family(F.col("pattern_name")).alias("pattern_family"),
        defaults[F.col("pattern_name")].alias("severity_default"),
    )


def occurrences(matches: DataFrame, prefix: str = "occ") -> DataFrame:
    """One row per match that carries ``match_id``."""
    events = F.col("source_events")
    return matches.select(
        "match_id",
        E.occurrence_id(F.col("machine_id"), F.col("detected_at"), prefix).alias("occurrence_id"),
        "pattern_name",
        "machine_id",
        E.iso_timestamp(F.col("detected_at")).alias("detected_at"),
        "severity",
        E.peak(events, "temperature_c").alias("peak_temperature_c"),
        E.peak(events, "vibration_rms_mm_s").alias("peak_vibration_rms_mm_s"),
        E.peak(events, "current_a").alias("peak_current_a"),
        E.duration_seconds(events).alias("cascade_duration_seconds"),
    )


def outcomes(graded: DataFrame) -> DataFrame:
    """Outcome entities from graded interventions that carry ``machine_id``."""
    return graded.select(
        sentence("outcome-", F.col("intervention_id")).alias("outcome_id"),
        "intervention_id",
        "machine_id",
        "outcome_status",
        "days_until_recurrence",
        "evaluation_window_days",
        F.timestamp_millis("observed_ms").alias("observed_at"),
    )


def _entity(label: str, name: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), name.alias("name"))


def match_mentions(matches: DataFrame, prefix: str = "occ") -> DataFrame:
    """(episode_id, label, name) for the entities each match episode mentions."""
    mentioned = F.array(
        _entity("Machine", F.col("machine_id")),
        _entity("Pattern", F.col("pattern_name")),
        _entity("PatternOccurrence", E.occurrence_id(F.col("machine_id"), F.col("detected_at"), prefix)),
    )
    return _mentions(matches, "pattern_occurrence", F.col("match_id"), mentioned)


def intervention_mentions(interventions: DataFrame) -> DataFrame:
    target = F.when(F.col("target_pattern_name").isNotNull(), _entity("Pattern", F.col("target_pattern_name")))
    mentioned = F.array_compact(
        F.array(
            _entity("Machine", F.col("machine_id")),
            _entity("Intervention", F.col("intervention_id")),
            target,
        )
    )
    return _mentions(interventions, "intervention", F.col("intervention_id"), mentioned)


def _mentions(df: DataFrame, kind: str, source: Column, mentioned: Column) -> DataFrame:
    return df.select(E.episode_id(kind, source).alias("episode_id"), F.explode(mentioned).alias("_e")).select(
        "episode_id", "_e.*"
    )


def match_facts(matches: DataFrame) -> DataFrame:
    """Two facts per match: the pattern DETECTED_ON the machine, the machine EXPERIENCED_PATTERN.

    Matches without sensor readings tell their severity instead of peaks.
    """
    events = F.col("source_events")
    readings = sentence(
        "peak temperature ",
        fixed(E.peak(events, "temperature_c"), 1),
        " °C, peak vibration ",
        fixed(E.peak(events, "vibration_rms_mm_s"), 2),
        " mm/s, peak current ",
        fixed(E.peak(events, "current_a"), 1),
        " A",
    )
    detail = F.coalesce(readings, sentence("severity ", F.coalesce("severity", F.lit("UNKNOWN"))))
    detected = sentence(F.col("machine_id"), " showed ", F.col("pattern_name"), ", ", detail)
    experienced = sentence(F.col("pattern_name"), " recorded for ", F.col("machine_id"), " at ", F.col("detected_at"), ", ", detail, ".")
    episode = E.episode_id("pattern_occurrence", F.col("match_id"))
    pair = F.array(
        F.struct(F.lit("DETECTED_ON").alias("name"), F.col("pattern_name").alias("source"), F.col("machine_id").alias("target"), detected.alias("fact")),
        F.struct(F.lit("EXPERIENCED_PATTERN").alias("name"), F.col("machine_id").alias("source"), F.col("pattern_name").alias("target"), experienced.alias("fact")),
    )
    return matches.select(
        F.col("machine_id").alias("group_id"),
        "match_id",
        E.iso_timestamp(F.col("detected_at")).alias("valid_at"),
        F.array(episode).alias("episodes"),
        F.explode(pair).alias("_f"),
    ).select(
        identity(F.col("match_id"), F.col("_f.name")).alias("fact_id"),
        "group_id",
        "_f.*",
        "valid_at",
        "episodes",
    )


def _fact(name: str, key: Column, source: Column, target: Column, text: Column, time: Column, episode: Column) -> list[Column]:
    return [
        identity(key, F.lit(name)).alias("fact_id"),
        F.col("machine_id").alias("group_id"),
        F.lit(name).alias("name"),
        source.alias("source"),
        target.alias("target"),
        text.alias("fact"),
        time.alias("valid_at"),
        F.array(episode).alias("episodes"),
    ]


def alert_facts(alerts: DataFrame) -> DataFrame:
    """One fact per alert episode, told by its summary."""
    key = F.col("alert_id")
    episode = E.episode_id("agent_alert", key)
    return alerts.select(
        *_fact("DETECTED_WITH", key, F.col("pattern_name"), F.col("machine_id"), F.col("summary"), F.col("detected_ts"), episode)
    )


def intervention_facts(narrated: DataFrame) -> DataFrame:
    """Facts of accepted, narrated interventions: PERFORMED_ON the machine, TARGETED the pattern if one is named."""
    key = F.coalesce("intervention_id", F.col("body"))
    time, episode = F.coalesce("performed_at", F.current_timestamp()), E.episode_id("intervention", key)
    performed = narrated.select(*_fact("PERFORMED_ON", key, key, F.col("machine_id"), F.col("body"), time, episode))
    against = sentence(
        F.col("target_pattern_name"), " on ", F.col("machine_id"), " was answered with ",
        F.replace("intervention_type", F.lit("_"), F.lit(" ")), ", record ", key, ".",
    )
    aimed = narrated.filter(F.coalesce("target_pattern_name", F.lit("")) != "")
    return performed.unionByName(aimed.select(*_fact("TARGETED", key, key, F.col("target_pattern_name"), against, time, episode)))


def outcome_facts(outcomes: DataFrame) -> DataFrame:
    """One fact per outcome entity: the intervention RESULTED_IN it."""
    key = F.col("outcome_id")
    time, episode = F.coalesce("observed_at", F.current_timestamp()), E.episode_id("outcome", key)
    return outcomes.select(*_fact("RESULTED_IN", key, F.col("intervention_id"), key, E.outcome_text(), time, episode))


def intervention_entities(interventions: DataFrame) -> DataFrame:
    """One row per intervention id."""
    fields = ["machine_id", "intervention_type", "performed_at", "performed_by", "notes", "target_pattern_name"]
    known = interventions.filter(F.col("intervention_id").isNotNull())
    # One whole row of a repeated id, the least.
    least = known.groupBy("intervention_id").agg(F.min(F.struct(*fields)).alias("_r"))
    return least.select("intervention_id", "_r.*")


def alert_entities(alerts: DataFrame) -> DataFrame:
    """One row per alert id, of gated matches that carry ``alert_id``."""
    fields = ["machine_id", "pattern_name", "detected_ts", "severity", "confidence_raw", "confidence_final"]
    least = alerts.groupBy("alert_id").agg(F.min(F.struct(*fields)).alias("_r"))
    return least.select("alert_id", "_r.*")


def fact_entities(facts: DataFrame) -> DataFrame:
    return facts.select("fact_id", F.explode(F.array("source", "target")).alias("entity")).distinct()


def nodes(mentions: DataFrame) -> DataFrame:
    return mentions.select("label", "name").distinct()


def census(rows: DataFrame, by: str) -> DataFrame:
    """Number of rows per label or edge type; counts combine before the shuffle."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def co_mentions(mentions: DataFrame, left: str, right: str, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Entity <- MENTIONS - episode - MENTIONS -> other entity, in name order when limited.

    An episode mentions only a handful of entities, so the join on episode stays small.
    """
    near = mentions.filter(F.col("label") == left)
    if name is not None:
        near = near.filter(F.col("name") == name)
    near = near.select(F.col("name").alias("left_name"), "episode_id")
    far = mentions.filter(F.col("label") == right).select("episode_id", F.col("name").alias("right_name"))
    found = near.join(far, "episode_id").select("left_name", "episode_id", "right_name")
    return found if limit is None else found.orderBy("left_name", "episode_id", "right_name").limit(limit)


def mentioned_in(
    mentions: DataFrame, episodes: DataFrame, label: str, name: str | None, kinds: list[str], limit: int | None = None
) -> DataFrame:
    """Entity <- MENTIONS - episode, for episodes of the given kinds."""
    wanted = mentions.filter(F.col("label") == label)
    if name is not None:
        wanted = wanted.filter(F.col("name") == name)
    found = wanted.select(F.col("name").alias("entity"), "episode_id").join(
        episodes.filter(F.col("episode_type").isin(kinds)).select("episode_id", "episode_type", "reference_time"),
        "episode_id",
    )
    return found if limit is None else found.orderBy("entity", "episode_id").limit(limit)
