"""Nearest earlier or later row of the same key, safe for hot keys.

A plain window partitioned by key puts a whole key into one task. Here the keys that hold more
than ``max_rows`` rows are found first with an exact count, and only their rows are cut into
slices along the order: a range sort deals them out by number of rows, so bursts and rows of one
and the same time are cut through, too. Each slice is one window group; what a slice must know of
the others is one row, taken from a small per-slice summary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.storage import written

MAX_ROWS = 1_000_000
#: Rows that one task sorts for its windows; the number of tasks follows from the number of rows.
TASK_ROWS = 100_000
#: Rows are counted by a hash of their key first, so that this count holds a bounded number of groups.
BUCKETS = 65_536

SLICE = "_slice"
LO = "_slice_lo"
WIDTH = "_slice_width"
CARRY = "_carry_row"
ANY = "_any"


def crowded(df: DataFrame, key: list[str], max_rows: int) -> tuple[int, DataFrame | None]:
    """The number of rows, and those rows whose key may hold more than ``max_rows``; ``None`` when there are none.

    Exact: a key with that many rows makes its bucket as full. Only the keys of full buckets, at most (all rows /
    ``max_rows``) of these, are then counted one by one.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS))
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    full = F.collect_list(F.when(F.col("_n") > max_rows, F.col("_bucket")))
    rows, found = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), full).head()
    return rows, df.filter(bucket.isin(found)) if found else None


def dealt(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """``df`` of ``rows`` rows with the rows of a key together, about ``TASK_ROWS`` or fewer of them to a task.

    The number is given, as adaptive execution would merge tasks by their compressed bytes, whatever the rows take in memory.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *key) if tasks > 1 else df.repartition(*key)


def hot_keys(
    df: DataFrame, key: list[str], pos: str, max_rows: int, min_width: int = 1
) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows, with the start and width of their slices.

    ``None`` when there is no such key. Count, minimum and maximum are exact, so every evaluation
    cuts at the same places. At most (all rows / max_rows) keys qualify, which bounds the table.
    """
    slices = F.ceil(F.col("_n") / F.lit(max_rows))
    span = F.col("_hi") - F.col(LO) + 1
    _, some = crowded(df, key, max_rows)
    if some is None:
        return None
    hot = (
        some.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias(LO), F.max(pos).alias("_hi"))
        .filter(F.col("_n") > max_rows)
        .select(
            *key,
            LO,
            F.greatest(F.lit(min_width).cast("long"), F.ceil(span / slices)).alias(WIDTH),
        )
    )
    return None if hot.isEmpty() else hot


def in_slices(df: DataFrame, hot: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Add the slice number; keys that are not hot stay whole in slice 0.

    ``hot`` is broadcast: it has at most (all rows / max_rows) rows of a few numbers each.
    """
    number = F.expr(f"({pos} - {LO}) div {WIDTH}")
    return df.join(F.broadcast(hot), key, "left").withColumn(
        SLICE, F.coalesce(number, F.lit(0).cast("long"))
    )


@dataclass(frozen=True)
class Look:
    """One neighbour to look up: the nearest row before or after that satisfies ``where``."""

    name: str
    direction: str  # "prev" or "next"
    columns: list[str]
    where: Column | None = field(default=None)

    def value(self) -> Column:
        payload = F.struct(*self.columns)
        return payload if self.where is None else F.when(self.where, payload)


def _frames(partition: list[str], order: list[str], first: list[Column]):
    # Both frames end just before the current row. A frame that starts after the current row
    # would be recomputed for every row.
    before = Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, -1)
    return {
        "prev": before.orderBy(*first, *[F.asc(c) for c in order]),
        "next": before.orderBy(*first, *[F.desc(c) for c in order]),
    }


def neighbours(
    df: DataFrame,
    key: list[str],
    order: list[str],
    looks: list[Look],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Add one struct column per look; null where there is no such neighbour.

    ``order`` is a position (milliseconds, microseconds or an offset) followed by
    tie-breakers. Rows without a key or position belong to no order and are left out.
    """
    df = df.dropna(subset=[*key, order[0]])
    n, some = crowded(df, key, max_rows)
    if some is None:
        return _plain(df, key, order, looks, n)
    counts = some.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    hot = counts.agg(F.sum("_n")).head()[0]
    if hot is None:
        return _plain(df, key, order, looks, n)
    few = F.broadcast(counts.select(*key))  # at most all rows / max_rows
    cold = _plain(df.join(few, key, "left_anti"), key, order, looks, n - hot)
    rows = by_rank(df.join(few, key, "left_semi"), key, order, -(-hot // max_rows))
    return cold.unionByName(_in_slices(rows, key, [*order, ANY], looks).select(*cold.columns))


def _plain(df: DataFrame, key: list[str], order: list[str], looks: list[Look], rows: int) -> DataFrame:
    # Partitioned before the payload structs are built, so that these are not shuffled.
    frames = _frames(key, order, [])
    found = dealt(df, key, rows).withColumns({k.name: F.last(k.value(), True).over(frames[k.direction]) for k in looks})
    return found.select(*df.columns, *[k.name for k in looks])


def by_rank(df: DataFrame, key: list[str], order: list[str], slices: int) -> DataFrame:
    """Rows with their slice and a number that tells rows of one place apart, written once.

    The slices are the ranges of a sort by key and order, of about equal numbers of rows (Spark samples
    their bounds), whatever the distribution of the order columns.
    """
    numbered = df.withColumn(ANY, F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(slices + 1, *key, *order, ANY)
    return written(ranged.withColumn(SLICE, F.spark_partition_id().cast("long")), "slices")


def _in_slices(rows: DataFrame, key: list[str], order: list[str], looks: list[Look]) -> DataFrame:
    ends = rows.groupBy(*key, SLICE).agg(*[_edge(k, order).alias(k.name) for k in looks])
    # One row per slice, at most (all rows / max_rows) of them in total.
    per_key = Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    scans = {"prev": per_key.orderBy(F.asc(SLICE)), "next": per_key.orderBy(F.desc(SLICE))}
    carried = ends.select(
        *key,
        SLICE,
        F.lit(True).alias(CARRY),
        *[F.last(k.name, True).over(scans[k.direction]).alias(f"_in_{k.name}") for k in looks],
    )
    mixed = rows.withColumn(CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    mixed = mixed.repartition(*key, SLICE)
    frames = _frames([*key, SLICE], order, [F.desc(CARRY)])
    found = mixed.withColumns(
        {
            k.name: F.last(
                F.when(F.col(CARRY), F.col(f"_in_{k.name}")).otherwise(k.value()), True
            ).over(frames[k.direction])
            for k in looks
        }
    )
    return found.filter(~F.col(CARRY))


def _edge(look: Look, order: list[str]) -> Column:
    at = F.struct(*order)
    if look.where is not None:
        at = F.when(look.where, at)
    pick = F.max_by if look.direction == "prev" else F.min_by
    return pick(look.value(), at)
