"""Gaps between successive signals of a key, and expected signals that never came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import MAX_ROWS, Look, neighbours
from tracewell.storage import spread_by


def signal_gaps(
    df: DataFrame,
    key: list[str],
    order: list[str],
    time_ms: str,
    threshold_seconds: int,
    carry: list[str] | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Rows that arrive more than ``threshold_seconds`` after the row before them.

    The gap counts whole seconds, so 63.999 s is 63. With arrival order (an offset in ``order``)
    a late signal resets the last time seen; with [event time, tie-breaker] it does not.
    Adds ``previous`` (the row before the gap) and ``gap_seconds``.
    """
    columns = list(dict.fromkeys([*order, time_ms, *(carry or [])]))
    rows = neighbours(df, key, order, [Look("previous", "prev", columns)], max_rows)
    gap = F.expr(f"({time_ms} - previous.{time_ms}) div 1000")
    return rows.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") > threshold_seconds)


#: Periods that one row of a long gap is expanded to at once.
PIECE = 1 << 14


def missing_ranges(
    df: DataFrame, key: list[str], time_ms: str, period_ms: int, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Gaps of whole periods without any signal: the first and last missing period, numbered from 1970.

    The seen periods are made distinct first; each then only needs the next seen one, so no table
    of expected periods is built or joined, and a gap of any length is one row.
    """
    seen = df.select(*key, F.expr(f"{time_ms} div {int(period_ms)}").alias("slot")).distinct()
    ahead = neighbours(seen, key, ["slot"], [Look("following", "next", ["slot"])], max_rows)
    gaps = ahead.filter(F.col("following.slot") > F.col("slot") + 1)
    return gaps.select(*key, (F.col("slot") + 1).alias("first_slot"), (F.col("following.slot") - 1).alias("last_slot"))


def missing_slots(
    df: DataFrame, key: list[str], time_ms: str, period_ms: int, max_rows: int = MAX_ROWS
) -> DataFrame:
    """Periods without any signal, between a key's first and last signal, one row each.

    Ranges are cut into pieces of ``PIECE`` periods, dealt out over the tasks, and only then expanded, so a
    clock that once showed 1970 costs its rows but no long array.
    """
    gaps = missing_ranges(df, key, time_ms, period_ms, max_rows)
    begins = F.explode(F.sequence("first_slot", "last_slot", F.lit(PIECE).cast("long"))).alias("piece")
    pieces = spread_by(gaps.select(*key, "last_slot", begins), *key, "piece")
    ends = F.least(F.col("piece") + PIECE - 1, F.col("last_slot"))
    slots = pieces.select(*key, F.explode(F.sequence("piece", ends)).alias("missing"))
    return slots.select(*key, (F.col("missing") * period_ms).alias("slot_start_ms"))
