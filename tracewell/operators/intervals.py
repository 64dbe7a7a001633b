"""Labelling events with the interval they fall in, and grading interventions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.operators.ordered import MAX_ROWS, Look, neighbours

DAY_MS = 86_400_000


def first_registered(windows: DataFrame, key: list[str]) -> DataFrame:
    """Windows ``[start_ms, end_ms)`` of a key as disjoint segments, each of the window registered first.

    A row per change: ``at_ms``, from when on the window with ``label`` and ``start_ms`` holds (nulls: none). The
    sweep reads the windows of a key in order of their starts and holds those that are open.
    """
    rows = windows.filter(F.col("end_ms") > F.col("start_ms")).select(*key, "start_ms", "end_ms", "registered", "label")
    schema = T.StructType([rows.schema[k] for k in key] + [T.StructField("at_ms", T.LongType()), rows.schema["start_ms"], rows.schema["label"]])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        own, open_, holding = None, [], None

        def until(time: float) -> None:
            """Take out what ends by then; where the holder changes, a segment begins."""
            nonlocal holding
            while open_ and open_[0][2] <= time:
                at = heappop(open_)[2]
                while open_ and open_[0][2] <= at:
                    heappop(open_)
                holding = open_[0] if open_ else None
                out.append((*own, at, *((holding[1], holding[3]) if holding else (None, None))))

        for batch in batches:
            for *mine, start, end, registered, label in zip(*[c.to_pylist() for c in batch.columns]):
                if mine != own:
                    until(math.inf)
                    own, open_, holding = mine, [], None
                until(start)
                heappush(open_, (registered, start, end, label))
                if open_[0] is not holding:
                    holding = open_[0]
                    if out and out[-1][:-2] == (*own, start):
                        out.pop()
                    out.append((*own, start, holding[1], holding[3]))
            if len(out) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[:-1]), arrow)], schema=arrow)
                out = out[-1:]
        until(math.inf)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.repartition(*key).sortWithinPartitions(*key, "start_ms", "registered").mapInArrow(sweep, schema)


def label_intervals(
    events: DataFrame,
    windows: DataFrame,
    key: list[str],
    event_id: str,
    time_ms: str,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """The first registered window ``[start_ms, end_ms)`` that holds each event, if any.

    ``windows`` has the key, ``start_ms``, ``end_ms``, ``registered`` (order of registration,
    unique per key) and ``label``. Each event looks up the last change of ``first_registered`` before
    it: one shuffle of the events, no pairs. Events without a key or time are labelled by none.
    """
    changes = first_registered(windows, key).withColumns({"_event": F.lit(0), time_ms: F.col("at_ms")}).drop("at_ms")
    points = events.select(*key, event_id, F.col(time_ms).cast("long").alias(time_ms), F.lit(1).alias("_event"))
    rows = points.unionByName(changes, allowMissingColumns=True)
    change = Look("_w", "prev", ["start_ms", "label"], F.col("_event") == 0)
    found = neighbours(rows, key, [time_ms, "_event"], [change], max_rows).filter(F.col("_event") == 1)
    lost = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*key, time_ms]])
    none = points.filter(lost).withColumn("_w", F.lit(None).cast(found.schema["_w"].dataType))
    columns = [*key, event_id, time_ms, "_w"]
    elapsed = F.greatest(F.lit(0.0), (F.col(time_ms) - F.col("_w.start_ms")) / 1000.0)
    return found.select(*columns).unionByName(none.select(*columns)).select(
        *key,
        event_id,
        time_ms,
        F.col("_w.label").alias("label"),
        F.when(F.col("_w.start_ms").isNotNull(), elapsed).alias("elapsed_seconds"),
    )


def grade_interventions(
    interventions: DataFrame,
    occurrences: DataFrame,
    key: list[str],
    window_days: int,
    as_of_ms: Column | int | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Whether the target pattern came back within ``window_days`` after each intervention.

    ``interventions`` has the key, ``intervention_id`` and ``performed_ms``; ``occurrences`` the
    key and ``detected_ms``. Status is ``recurred``, ``resolved`` (window over, no recurrence) or
    ``ongoing`` (window still open at ``as_of_ms``, by default the latest time in either table).
    Each intervention looks up its next occurrence; intervention-occurrence pairs are never formed.
    """
    acts = interventions.select(
        *key, F.col("performed_ms").alias("_ms"), F.lit(1).alias("_act"), "intervention_id"
    )
    seen = occurrences.select(*key, F.col("detected_ms").alias("_ms"), F.lit(0).alias("_act"))
    rows = acts.unionByName(seen, allowMissingColumns=True)
    # An occurrence at the very moment of the intervention sorts before it and is not a recurrence.
    found = neighbours(
        rows, key, ["_ms", "_act"], [Look("_again", "next", ["_ms"], F.col("_act") == 0)], max_rows
    ).filter(F.col("_act") == 1)
    if as_of_ms is None:
        end = rows.select(F.max("_ms")).scalar()
    else:
        end = F.lit(as_of_ms).cast("long") if isinstance(as_of_ms, int) else as_of_ms
    window = window_days * DAY_MS
    delay = F.col("_again._ms") - F.col("_ms")
    recurred = F.coalesce(delay <= window, F.lit(False))
    return found.select(
        "intervention_id",
        *key,
        F.when(recurred, "recurred").when(end >= F.col("_ms") + window, "resolved").otherwise("ongoing").alias("outcome_status"),
        F.when(recurred, F.floor(delay / DAY_MS).cast("int")).alias("days_until_recurrence"),
        F.lit(window_days).alias("evaluation_window_days"),
        F.when(recurred, F.col("_again._ms")).otherwise(F.least(end, F.col("_ms") + window)).alias("observed_ms"),
    )
