"""The baseline dimension: one row of thresholds per machine."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.schemas import BASELINE_FIELDS, BASELINES


def baselines_from(spark: SparkSession, machines: dict[str, dict]) -> DataFrame:
    """A table from {machine: {field: value}}; a missing field is an error."""
    rows = []
    for machine, values in machines.items():
        absent = [name for name in BASELINE_FIELDS if values.get(name) is None]
        if absent:
            raise ValueError(f"baseline of {machine} lacks {absent}")
        rows.append((machine, *[float(values[name]) for name in BASELINE_FIELDS]))
    return spark.createDataFrame(rows, BASELINES)


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    """The baselines of a small JSON or YAML settings file."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs the yaml module; use JSON instead") from error
        return baselines_from(spark, yaml.safe_load(text))
    return baselines_from(spark, json.loads(text))


def require_machines(baselines: DataFrame, machines: list[str]) -> DataFrame:
    """``baselines``, or an error naming the configured machines that have none."""
    wanted = F.col("machine_id").isin(machines)
    found = {r.machine_id for r in baselines.filter(wanted).select("machine_id").distinct().collect()}
    absent = sorted(set(machines) - found)
    if absent:
        raise ValueError(f"no baseline for machines {absent}")
    return baselines
