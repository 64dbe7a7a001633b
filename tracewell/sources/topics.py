"""Topic records: value-only JSON messages, from Kafka or from files.

Both give the columns ``topic, key, value, offset, timestamp``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.schemas import RECORD


def kafka_options(
    servers: str,
    topic: str | None = None,
    topic_pattern: str | None = None,
    starting_offsets: str = "latest",
    user: str | None = None,
    password: str | None = None,
) -> dict[str, str]:
    """Reader options; exactly one of ``topic`` and ``topic_pattern`` (a regex) is needed.

    Starting offsets are "earliest" (read history) or anything else for "latest"; they only count
    until the query has a checkpoint.
    """
    if (topic is None) == (topic_pattern is None):
        raise ValueError("give either a topic or a topic pattern")
    options = {"kafka.bootstrap.servers": servers}
    options["subscribe" if topic else "subscribePattern"] = topic or topic_pattern
    options["startingOffsets"] = "earliest" if starting_offsets.lower() == "earliest" else "latest"
    options.update(_sasl(user, password))
    return options


def kafka_sink_options(servers: str, user: str | None = None, password: str | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, **_sasl(user, password)}


def _sasl(user: str | None, password: str | None) -> dict[str, str]:
    if not user:
        return {}
    login = "org.apache.kafka.common.security.plain.PlainLoginModule"
    return {
        "kafka.security.protocol": "SASL_PLAINTEXT",
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.sasl.jaas.config": f'{login} required username="{user}" password="{password}";',
    }


def _records(df: DataFrame) -> DataFrame:
    return df.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "offset",
        "timestamp",
    )


def kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return _records(spark.readStream.format("kafka").options(**options).load())


def kafka_batch(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """A bounded read; a batch always starts at the earliest offset."""
    return _records(spark.read.format("kafka").options(**{**options, "startingOffsets": "earliest"}).load())


def file_records(spark: SparkSession, path: str, topic_pattern: str | None = None) -> DataFrame:
    """Records stored as JSON lines, partitioned by topic or with a topic field."""
    return _matching(spark.read.schema(RECORD).json(path), topic_pattern)


def file_record_stream(
    spark: SparkSession, path: str, topic_pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _matching(reader.json(path), topic_pattern)


def _matching(df: DataFrame, topic_pattern: str | None) -> DataFrame:
    return df if topic_pattern is None else df.filter(F.col("topic").rlike(topic_pattern))


def pattern_topics(prefix: str) -> str:
    """Regex of every pattern topic below ``prefix``, present and future."""
    return "^" + prefix.replace(".", "\\.") + "\\.patterns\\..+"
