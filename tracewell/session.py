"""Session settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the operators count on; sizes are left to the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )


def local_session(cores: int, name: str = "tracewell") -> SparkSession:
    """A single-machine session for tests and measurements."""
    session = (
        configured(SparkSession.builder.master(f"local[{cores}]").appName(name))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), "tracewell-checkpoints"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
