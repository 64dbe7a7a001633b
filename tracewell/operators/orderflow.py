"""Order -> shipment -> invoice violations.

All three rules only ask what the nearest earlier or later event of the order is, so one pass over
one partitioning answers them together:

* a shipment with no earlier order or shipment;
* an invoice whose directly preceding event is an order (a shipment in between would have been
  seen, an invoice in between would have closed the case);
* an order whose next order or shipment comes after the window, or not at all by ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordered import MAX_ROWS, Look, neighbours

ORPHAN = "shipment_without_order"
SKIPPED = "invoice_without_shipment"
UNFULFILLED = "order_unfulfilled"


def flow_violations(
    df: DataFrame,
    key: list[str],
    order: list[str],
    kind: str,
    window: int,
    as_of: Column | int | None = None,
    carry: list[str] | None = None,
    steps: tuple[str, str, str] = ("order", "shipment", "invoice"),
    max_rows: int = MAX_ROWS,
    clock: str | None = None,
) -> DataFrame:
    """One row per violation: key, ``violation_type``, ``detected`` (time) and ``evidence``.

    ``order`` says what comes before what, ``clock`` is the time that deadlines are measured in (by
    default the first order column). ``as_of`` defaults to the latest time in ``df``. An event exactly
    at the deadline is in time; an unfulfilled order is dated by the order itself.
    """
    opening, middle, closing = steps
    clock = clock or order[0]
    events = _until(df.filter(F.col(kind).isin(*steps)), clock, as_of)
    columns = list(dict.fromkeys([*order, clock, kind, *(carry or [])]))
    is_delivery = F.col(kind).isin(opening, middle)
    rows = neighbours(
        events,
        key,
        order,
        [
            Look("_before", "prev", columns),
            Look("_delivery_before", "prev", [order[0]], is_delivery),
            Look("_delivery_after", "next", [clock], is_delivery),
        ],
        max_rows,
    )
    here = F.struct(*columns)
    end = _as_of(df, clock, as_of)
    answered = F.coalesce(F.col(f"_delivery_after.{clock}"), end)
    orphan = (F.col(kind) == middle) & F.col("_delivery_before").isNull()
    skipped = (F.col(kind) == closing) & (F.col(f"_before.{kind}") == opening)
    unfulfilled = (F.col(kind) == opening) & (answered > F.col(clock) + window)
    # A row has one kind, so at most one rule applies to it.
    violation = F.when(orphan, ORPHAN).when(skipped, SKIPPED).when(unfulfilled, UNFULFILLED)
    evidence = F.when(skipped, F.array("_before", here)).otherwise(F.array(here))
    return (
        rows.withColumn("violation_type", violation)
        .filter(F.col("violation_type").isNotNull())
        .select(*key, "violation_type", F.col(clock).alias("detected"), evidence.alias("evidence"))
    )


def step_deadlines(
    df: DataFrame,
    key: list[str],
    order: list[str],
    kind: str,
    deadlines: list[tuple[str, str, int]],
    as_of: Column | int | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Steps that were not followed by their next step in time, for each (step, next, deadline).

    A repeated step restarts its clock.
    """
    wanted = {name for step, following, _ in deadlines for name in (step, following)}
    events = _until(df.filter(F.col(kind).isin(*wanted)), order[0], as_of)
    looks = [
        Look(f"_after_{i}", "next", [order[0]], F.col(kind).isin(step, following))
        for i, (step, following, _) in enumerate(deadlines)
    ]
    rows = neighbours(events, key, order, looks, max_rows)
    end = _as_of(df, order[0], as_of)
    missed = [
        F.when(
            (F.col(kind) == step)
            & (F.coalesce(F.col(f"_after_{i}.{order[0]}"), end) > F.col(order[0]) + deadline),
            F.struct(F.lit(step).alias("step"), F.lit(following).alias("missing_step")),
        )
        for i, (step, following, deadline) in enumerate(deadlines)
    ]
    return rows.select(
        *key, *order, F.explode(F.array_compact(F.array(*missed))).alias("_v")
    ).select(*key, *order, "_v.*")


def _until(df: DataFrame, pos: str, as_of) -> DataFrame:
    if as_of is None:
        return df
    return df.filter(F.col(pos) <= (F.lit(as_of) if isinstance(as_of, int) else as_of))


def _as_of(df: DataFrame, pos: str, as_of) -> Column:
    if as_of is None:
        return df.select(F.max(pos)).scalar()
    return F.lit(as_of).cast("long") if isinstance(as_of, int) else as_of
