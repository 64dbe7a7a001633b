"""Where intermediate tables are written."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), "tracewell-checkpoints")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the application's own part of the shared folder.

    That part is removed when the application ends.
    """
    own = f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again.

    Cuts the lineage like a checkpoint; columns can be pruned when it is read, and a column with a
    row number keeps its values when tasks are repeated.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(fresh_path(spark, "checkpoints"))
    return df.checkpoint()


def spread_by(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` hash-partitioned by ``columns`` into the configured number of partitions.

    For work that costs far more than its bytes suggest: with the number given, adaptive execution
    does not merge partitions that look small.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
