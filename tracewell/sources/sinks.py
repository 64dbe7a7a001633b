"""Writers for matches, episodes, alerts and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def topic_messages(df: DataFrame, topic: Column, key: Column) -> DataFrame:
    """One message per row: topic, key and the row as JSON (null fields left out)."""
    columns = [c for c in df.columns if c not in ("topic", "key", "value")]
    return df.select(topic.alias("topic"), key.alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def alert_messages(alerts: DataFrame, prefix: str) -> DataFrame:
    """Alerts addressed to their machine's topic, keyed by machine."""
    topic = F.concat(F.lit(f"{prefix}.alerts."), F.lower("machine_id"))
    return topic_messages(alerts, topic, F.col("machine_id"))


def gathered(df: DataFrame, column: str) -> DataFrame:
    """Rows of one folder brought together before a partitioned write.

    Without this every task writes a file into every folder. Adaptive execution splits a folder
    that holds too much for one task.
    """
    return df.hint("rebalance", column)


def append_messages(messages: DataFrame, path: str, by_topic: bool = False) -> None:
    """Messages as JSON lines, with the topic as a field or, for few topics, as a folder."""
    if by_topic:
        gathered(messages, "topic").write.partitionBy("topic").mode("append").json(path)
    else:
        messages.write.mode("append").json(path)


def send_messages(messages: DataFrame, options: dict[str, str]) -> None:
    """Messages to Kafka, at least once."""
    messages.write.format("kafka").options(**options).save()


def stream_messages(messages: DataFrame, options: dict[str, str], checkpoint: str) -> DataStreamWriter:
    return (
        messages.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
    )


def append_training_records(records: DataFrame, path: str) -> None:
    """JSON lines in one folder per UTC day of ``alerted_at``.

    ``outcome_id`` is written even while it is null.
    """
    day = F.to_date("alerted_at")
    (
        gathered(records.withColumn("alert_date", day), "alert_date")
        .write.partitionBy("alert_date")
        .mode("append")
        .option("ignoreNullFields", "false")
        .json(path)
    )
