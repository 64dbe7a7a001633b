"""What several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tracewell.plans.catalog import spread
from tracewell.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

__all__ = ["ORACLES", "QUERIES", "SPACES", "UPPER", "documents", "query", "table", "texts_mapped", "whole", "written"]


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores where one small file would keep them on one."""
    return spread(table(spark, sf_dir, "documents"))


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: What is worked on at once inside a task, in bytes of text; one longer text is a slice of its own.
SLICE = 4 << 20


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    begin, room = 0, SLICE
    for row, value in enumerate(batch.column(at)):
        n = len(value.as_buffer()) if value.is_valid else 0
        if n > room and row > begin:
            yield batch.slice(begin, row - begin)
            begin, room = row, SLICE
        room -= n
    yield batch.slice(begin)


def texts_mapped(
    docs: DataFrame, text: str, added: dict[str, tuple[str, pa.DataType]], make: Callable[[list[str]], list]
) -> DataFrame:
    """``docs`` with columns made from each whole text, null as empty; existing columns of these names go.

    ``make`` gets some texts and returns the values of each added column. Input and output are cut into
    slices of bounded size, so a worker's memory depends on the longest text only.
    """
    own = {name.lower() for name in added}
    kept = [c for c in docs.columns if c.lower() not in own]
    if text not in kept:
        raise ValueError(f"the text column {text} would be replaced")
    at, types = docs.columns.index(text), [t for _, t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, at):
                made = make([t or "" for t in part.column(at).to_pylist()])
                columns = [part.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

    fields = docs.select(*[f"`{c}`" for c in kept]).schema
    for name, (kind, _) in added.items():
        fields = fields.add(name, DataType.fromDDL(kind))
    return docs.mapInArrow(run, fields)
