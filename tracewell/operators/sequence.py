"""Ordered sequence matching: step 1, then step 2, ... then step n, within a time limit.

Other rows may lie between the steps. One row can flag several steps but fills only one step of a
match. With ``skip past last`` a row that lies inside a match cannot start another one.

The next row of each step is found in one descending window pass: the chain of a step is "the
nearest later row of this step, together with what that row found for the following step". Only
rows that flag some step enter the window. They are few, read more than once, and so written once,
each with a number: windows, selection and slices move positions and numbers only, and what a row
carries is joined at the end, for the rows of kept matches.

Selection walks the candidates of a key in order of their starts with one position as memory: the
next kept match is the first that starts after the end of the last. A hot key is cut into time
slices at least ``within`` long. A slice then is a function from the end that enters it to the end
that leaves it; few ends can enter, so each is followed in all slices at once, and a walk over one
small row per slice composes the functions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.operators.ordered import LO, SLICE, WIDTH, hot_keys, in_slices
from tracewell.storage import written

# One slice's candidates, a few numbers each, are in memory at once.
MAX_ROWS = 250_000

ID, MATCH, IDS = "_id", "_match", "_ids"
START, END = ["_start", "_start_tie"], ["_end", "_end_tie"]

Steps = list[tuple[str, Column]]


def sequence_candidates(
    df: DataFrame,
    key: list[str],
    order: list[str],
    steps: Steps,
    within: int,
    carry: list[str] | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """For every first-step row, the nearest completion; one struct column per step.

    ``order`` is [position, tie-breaker]; ``within`` is in units of the position, exclusive.
    The structs hold the order columns and ``carry``, which must be sortable types. Rows without a
    key or position are left out.
    """
    flagged = _flagged(df, key, order, steps, carry or [])
    places = flagged.drop("_row")
    hot = hot_keys(places, key, order[0], max_rows, min_width=within)
    if hot is None:
        found = _complete(places, key, order, steps, within)
    else:
        found = _complete(_overlapping(places, hot, key, order[0], within), [*key, SLICE], order, steps, within)
    return _with_rows(found, flagged, key, [name for name, _ in steps])


def match_sequence(
    df: DataFrame,
    key: list[str],
    order: list[str],
    steps: Steps,
    within: int,
    carry: list[str] | None = None,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Non-overlapping matches per key: the earliest start wins, the next starts after its end."""
    flagged = _flagged(df, key, order, steps, carry or [])
    places, names = flagged.drop("_row"), [name for name, _ in steps]
    hot = hot_keys(places, key, order[0], max_rows, min_width=within)
    if hot is None:
        return _with_rows(_kept_in_order(_complete(places, key, order, steps, within), key), flagged, key, names)

    few = F.broadcast(hot.select(*key))  # bounded, see hot_keys
    cold = _complete(places.join(few, key, "left_anti"), key, order, steps, within)
    sliced = _overlapping(places.join(few, key, "left_semi"), hot, key, order[0], within)
    warm = _complete(sliced, [*key, SLICE, LO, WIDTH], order, steps, within)
    kept = _kept_in_order(cold, key).unionByName(_kept_across_slices(warm, key))
    return _with_rows(kept, flagged, key, names)


def _flagged(df, key, order, steps, carry) -> DataFrame:
    flags = [F.coalesce(cond, F.lit(False)).alias(f"_is_{name}") for name, cond in steps]
    columns = list(dict.fromkeys([*order, *carry]))
    # The filter comes first and in the caller's own terms, so that it can reach the file scan.
    wanted = df.filter(reduce(lambda a, b: a | b, [cond for _, cond in steps])).dropna(subset=[*key, order[0]])
    row = F.struct(*columns).alias("_row")
    numbered = wanted.select(*key, row, F.col(order[0]), F.col(order[1]), *flags, F.monotonically_increasing_id().alias(ID))
    return written(numbered, "flagged")


def _overlapping(flagged, hot, key, pos, within) -> DataFrame:
    """Slices plus, for each, a copy of the rows within ``within`` after its end."""
    rows = in_slices(flagged, hot, key, pos)
    offset = F.col(pos) - F.col(LO) - F.col(SLICE) * F.col(WIDTH)
    needed_before = F.col(LO).isNotNull() & (F.col(SLICE) > 0) & (offset < within)
    copies = F.when(needed_before, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return rows.withColumn("_copy", F.explode(copies)).withColumn(
        SLICE, F.when(F.col("_copy"), F.col(SLICE) - 1).otherwise(F.col(SLICE))
    )


def _complete(flagged, group, order, steps, within) -> DataFrame:
    """The candidates: where each starts and ends, the number of its first row and those of all its rows."""
    names = [name for name, _ in steps]
    own = ~F.col("_copy") if "_copy" in flagged.columns else F.lit(True)
    later = (
        Window.partitionBy(*group)
        .orderBy(*[F.desc(c) for c in [*order, ID]])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = flagged.repartition(*group)
    for i in range(len(names) - 1, 0, -1):
        chain = [F.struct(*order, ID).alias(names[i])]
        if i < len(names) - 1:
            chain += [F.col(f"_next_{names[i + 1]}.{n}").alias(n) for n in names[i + 1 :]]
        rows = rows.withColumn(
            f"_next_{names[i]}",
            F.last(F.when(F.col(f"_is_{names[i]}"), F.struct(*chain)), True).over(later),
        )
    ahead = f"_next_{names[1]}"
    end = [F.col(f"{ahead}.{names[-1]}.{c}") for c in order]
    return rows.filter(own & F.col(f"_is_{names[0]}") & (end[0] - F.col(order[0]) < within)).select(
        *group,
        *[F.col(c).alias(a) for c, a in zip(order, START)],
        *[c.alias(a) for c, a in zip(end, END)],
        F.col(ID).alias(MATCH),
        F.array(ID, *[F.col(f"{ahead}.{n}.{ID}") for n in names[1:]]).alias(IDS),
    )


def _with_rows(found: DataFrame, flagged: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """One struct column per step with what its row carries; a first row begins one match."""
    steps = found.select(MATCH, F.posexplode(IDS).alias("_step", ID))
    met = steps.join(flagged.select(*key, "_row", ID), ID)
    return (
        met.groupBy(MATCH, *key)
        .agg(*[F.first(F.when(F.col("_step") == i, F.col("_row")), True).alias(n) for i, n in enumerate(names)])
        .drop(MATCH)
    )


def _places(rows, names: list[str]) -> list[tuple]:
    """Positions as tuples that sort like the columns, null tie-breakers first."""
    first, tie = (rows.column(n).to_pylist() for n in names)
    return [(p, t is not None, t) for p, t in zip(first, tie)]


def _kept_in_order(candidates: DataFrame, key: list[str]) -> DataFrame:
    """(match, rows) of the candidates that start after the end of the last kept one of their key.

    The window has left all candidates of a key in one partition, so a sort inside it is enough; the
    scan remembers one position.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, None
        for batch in batches:
            keep = []
            keys = zip(*[batch.column(k).to_pylist() for k in key])
            for i, (own, start, stop) in enumerate(zip(keys, _places(batch, START), _places(batch, END))):
                if own != last:
                    last, end = own, None
                if end is None or start > end:
                    keep.append(i)
                    end = stop
            yield batch.take(pa.array(keep, pa.int64())).select([MATCH, IDS])

    ordered = candidates.sortWithinPartitions(*key, *START, MATCH)
    return ordered.mapInArrow(scan, candidates.select(MATCH, IDS).schema)


def _kept_across_slices(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The same selection for keys cut into slices.

    An end that leaves a slice lies in the next one, and there are few: at the cut the candidates that
    wait for the same step share their end. Every slice is followed for each end that can enter it and
    for none; then one row per slice and case tells which case each slice is in.
    """
    found = written(candidates, "candidates")
    cut = F.col(LO) + (F.col(SLICE) + 1) * F.col(WIDTH)
    entering = found.filter(F.col(END[0]) >= cut).select(*key, (F.col(SLICE) + 1).alias(SLICE), *END).distinct()
    kinds = {f.name: f.dataType for f in found.schema}
    entry, leaving = ["_in", "_in_tie"], ["_out", "_out_tie"]
    fields = [found.schema[k] for k in [*key, SLICE]] + [T.StructField("_case", T.IntegerType()), found.schema[MATCH]]
    fields += [T.StructField(n, kinds[s]) for n, s in zip([*entry, *leaving], [*END, *END])]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(schema)

    def follow(rows: pa.Table, ends: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        own = [rows.column(k)[0].as_py() for k in [*key, SLICE]]
        sorted_ = sorted(zip(_places(rows, START), rows.column(MATCH).to_pylist(), _places(rows, END)))
        starts = [r[0] for r in sorted_]
        out = []
        for case, end in enumerate([None, *sorted(_places(ends, END))]):
            row = (*own, case), (None, None) if end is None else end[::2]
            at = 0 if end is None else bisect_right(starts, end)
            while at < len(sorted_):
                _, match, end = sorted_[at]
                out.append((*row[0], match, None, None, None, None))
                at = bisect_right(starts, end, at + 1)
            out.append((*row[0], None, *row[1], *((None, None) if end is None else end[::2])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    of = [*key, SLICE]
    followed = written(found.groupBy(*of).cogroup(entering.groupBy(*of)).applyInArrow(follow, schema), "followed")
    cases = followed.filter(F.col(MATCH).isNull()).drop(MATCH)
    chosen_schema = T.StructType(schema.fields[: len(of) + 1])
    chosen_arrow = to_arrow_schema(chosen_schema)

    def walk(rows: pa.Table) -> pa.Table:
        slices: dict[int, dict] = {}
        for number, case, *ends in zip(*[rows.column(c).to_pylist() for c in [SLICE, "_case", *entry, *leaving]]):
            slices.setdefault(number, {})[tuple(ends[:2])] = case, tuple(ends[2:])
        own, before, end, out = [rows.column(k)[0].as_py() for k in key], None, (None, None), []
        for number in sorted(slices):
            ways = slices[number]
            case, end = ways[end if before == number - 1 and end in ways else (None, None)]
            out.append((*own, number, case))
            before = number
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), chosen_arrow)], schema=chosen_arrow)

    chosen = cases.groupBy(*key).applyInArrow(walk, chosen_schema)
    kept = followed.filter(F.col(MATCH).isNotNull()).join(chosen, [*of, "_case"], "left_semi")
    return found.select(MATCH, IDS).join(kept.select(MATCH), MATCH, "left_semi")
