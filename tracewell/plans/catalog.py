"""Named queries over the benchmark tables, each with the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.times import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its oracle SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The files hold timestamps without a zone; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer input splits than cores.

    One small file with a single row group would keep CPU-heavy work on one core. Tables of many
    files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def timed(rows: DataFrame) -> DataFrame:
    """Events with their time in microseconds and milliseconds."""
    return rows.withColumns({"us": micros(F.col("ts")), "ms": F.unix_millis(F.col("ts").cast("timestamp"))})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spread(table(spark, sf_dir, "events")))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream; a pattern, as the source takes no plain path of one file."""
    schema = table(spark, sf_dir, "events").schema
    return timed(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"))


def load_all() -> None:
    from tracewell.plans import detection_queries, memory_queries, retrieval_queries, stream_queries  # noqa: F401
