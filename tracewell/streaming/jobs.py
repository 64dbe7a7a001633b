"""Streaming queries that write memory, alerts and training records.

Every batch is written below its own ``batch=<id>`` folder and replaces it when it is replayed after
a failure, and ids are derived from the match; so a restart loses nothing and doubles nothing. A match
that is delivered again in a later batch is told and raised once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracewell.operators import alerts as A
from tracewell.operators import entities as G
from tracewell.operators import episodes as E
from tracewell.operators import matches as M
from tracewell.operators import retrieval as R
from tracewell.operators.lexical import Index, LexicalStore, joined, slot_of, slots_of
from tracewell.plans import memory
from tracewell.sources.ingest import accepted
from tracewell.sources.runs import RunTable
from tracewell.sources.sinks import alert_messages, gathered
from tracewell.storage import checkpointed, written


def _replace(df: DataFrame, path: str, batch: int, partition: str | None = None, form: str = "parquet") -> None:
    writer = (gathered(df, partition) if partition else df).write.mode("overwrite").format(form)
    if form == "json":
        writer = writer.option("ignoreNullFields", "false")
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(f"{path}/batch={batch}")


def _unseen(matches: DataFrame, path: str, batch: int) -> DataFrame:
    """Matches that no earlier batch had; their ids are noted below ``path`` by day.

    A repeated delivery has the day of the first, so only the days of this batch are read, and there is
    no horizon after which a repeat would count as new. A replayed batch does not see its own notes.
    """
    day = F.coalesce(F.to_date("detected_ts"), F.lit("1970-01-01").cast("date"))
    matches = checkpointed(matches.withColumn("_day", day.cast("string")))
    days = [r[0] for r in matches.select("_day").distinct().collect()]
    if not days:
        return matches.drop("_day")
    seen = RunTable(matches.sparkSession, f"{path}/seen", "day", "match_id string", ("match_id",))
    seen.merge(days, batch)
    seen.append(matches.select("match_id", F.col("_day").alias("day")), batch)
    return matches.join(seen.read(days, batch).select("match_id"), "match_id", "left_anti").drop("_day")


def messages_to(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of messages to JSON lines by topic."""
    return (
        messages.writeStream.format("json")
        .partitionBy("topic")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def _remembered(episodes: DataFrame, facts: DataFrame, path: str, batch: int) -> None:
    """Episodes and facts of a batch by a slot of their group, and the facts in the stored index.

    A bounded number of slots, as there may be many thousand machines.
    """
    for name, rows in (("episodes", episodes), ("facts", facts)):
        _replace(rows.withColumn("slot", slot_of("group_id")), f"{path}/{name}", batch, "slot")
    LexicalStore(facts.sparkSession, f"{path}/index").append(indexed(facts), batch)


def of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of these groups (a table of ``group_id``), from their slots alone where rows lie by slot.

    Joined, as there may be many thousand: their names never go through the driver or into a plan.
    """
    if "slot" in rows.columns:
        rows = rows.filter(F.col("slot").cast("string").isin(slots_of(groups))).drop("slot")
    return rows.join(groups, "group_id", "left_semi")


def indexed(facts: DataFrame) -> DataFrame:
    """Facts as documents of the lexical index."""
    return facts.select(F.col("fact_id").alias("doc_id"), "group_id", "valid_at", F.col("fact").alias("text"))


def stored_index(spark: SparkSession, *paths: str) -> Callable[[DataFrame], Index]:
    """The indexes that jobs keep below these paths, as one, over the groups that are asked for."""
    return lambda groups: joined([LexicalStore(spark, f"{p}/index").read(groups) for p in paths])


def remember(records: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Match records to ``episodes``, ``facts`` and ``rejects`` below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        batch = checkpointed(batch)
        _, rejects = memory.ingest_matches(batch)
        told = checkpointed(accepted(E.narrate_matches(_unseen(memory.known_matches(batch), path, number))))
        _remembered(E.match_episodes(told), G.match_facts(told), path, number)
        _replace(rejects, f"{path}/rejects", number)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def alert(
    records: DataFrame,
    facts: Callable[[], DataFrame],
    episodes: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    prefix: str,
    score: Callable[[DataFrame], DataFrame] = A.score_by_rubric,
    scorer: R.Scorer = R.term_overlap,
    model: str = "offline-rubric",
    index: Callable[[DataFrame], Index] | None = None,
) -> DataStreamWriter:
    """Match records to ``alerts``, ``episodes`` and ``training`` below ``path``.

    ``facts``, ``episodes`` and ``index`` (see ``stored_index``) are asked anew for every batch, and only for the
    machines of its matches (see ``of_groups``).
    Without ``index`` the facts are indexed for each batch. Wall-clock columns are fixed by one checkpoint per
    batch, so the three outputs agree.
    """

    def write(batch: DataFrame, number: int) -> None:
        matches = checkpointed(_unseen(memory.known_matches(batch), path, number))
        groups = written(matches.select(F.col("machine_id").alias("group_id")).distinct(), "groups")
        mine = of_groups(facts(), groups) if index else facts()
        found = memory.retrieve(matches, mine, episodes(), scorer, index(groups) if index else None)
        raised = memory.raise_alerts(found, score)
        done = checkpointed(raised.withColumn("alerted_at", F.current_timestamp()))
        alerts = A.alert_records(done, F.col("alerted_at"))
        _replace(alert_messages(alerts, prefix), f"{path}/alerts", number, form="json")
        told = accepted(E.check_alerts(done))
        _remembered(E.alert_episodes(told), G.alert_facts(told), path, number)
        training = A.training_records(done, M.raw_events(), model, F.col("alerted_at"))
        dated = training.withColumn("alert_date", F.to_date("alerted_at"))
        _replace(dated, f"{path}/training", number, "alert_date", "json")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
