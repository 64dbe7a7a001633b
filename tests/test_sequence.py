import random

import pytest
from pyspark.sql import functions as F

from tests.machines import sequence_matches
from tracewell.operators.sequence import match_sequence, sequence_candidates

def abc():
    return [(name, F.col("flags").contains(str(i))) for i, name in enumerate("abc")]


def run(spark, rows, within=600, steps=None, **options):
    steps = steps or abc()
    df = spark.createDataFrame(rows, "k string, pos long, tie long, flags string")
    names = [n for n, _ in steps]
    got = match_sequence(df, ["k"], ["pos", "tie"], steps, within, **options).collect()
    return sorted((r["k"], tuple((r[n]["pos"], r[n]["tie"]) for n in names)) for r in got)


def brute(rows, within=600, steps=3):
    by_key = {}
    for k, pos, tie, flags in rows:
        by_key.setdefault(k, []).append((pos, tie, {int(f) for f in flags}))
    return sorted((k, m) for k, v in by_key.items() for m in sequence_matches(v, within, steps))


def noise(seed, keys, n, span, dense=False):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        for i in range(n):
            flags = "".join(str(f) for f in range(3) if rng.random() < (0.5 if dense else 0.25))
            rows.append((f"k{k}", rng.randrange(span), i, flags))
    return rows


def test_random_matches_equal_state_machine(spark):
    rows = noise(1, 30, 120, 12_000)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed,dense,span,within", [(2, False, 12_000, 600), (3, True, 4_000, 60), (4, True, 40_000, 3), (5, True, 900, 100)])
def test_hot_keys_in_slices_equal_state_machine(spark, seed, dense, span, within):
    rows = noise(seed, 3, 400, span, dense) + noise(seed + 50, 1, 10, span)
    rows += [("quiet", p, 0, f) for p, f in ((0, "0"), (1, "1"), (2, "2"))]
    assert run(spark, rows, within=within, max_rows=20) == brute(rows, within=within)


def test_periodic_overlap_crosses_every_slice(spark):
    # a c b a c b ...: two interleaved chains that never meet
    rows = [("k", i, 0, "021"[i % 3]) for i in range(900)]
    assert run(spark, rows, within=10, max_rows=20) == brute(rows, within=10)


def test_candidates_do_not_skip(spark):
    rows = noise(7, 4, 150, 5_000)
    df = spark.createDataFrame(rows, "k string, pos long, tie long, flags string")
    plain = sequence_candidates(df, ["k"], ["pos", "tie"], abc(), 600)
    sliced = sequence_candidates(df, ["k"], ["pos", "tie"], abc(), 600, max_rows=15)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))
    want = 0
    for k in {r[0] for r in rows}:
        ordered = sorted((p, t, f) for kk, p, t, f in rows if kk == k)
        for i, (p, _, f) in enumerate(ordered):
            if "0" not in f:
                continue
            j = next((j for j in range(i + 1, len(ordered)) if "1" in ordered[j][2]), None)
            c = j and next((c for c in range(j + 1, len(ordered)) if "2" in ordered[c][2]), None)
            want += bool(c and ordered[c][0] - p < 600)
    assert plain.count() == want


@pytest.mark.parametrize("steps", [2, 4])
def test_other_step_counts(spark, steps):
    rng = random.Random(steps)
    rows = [(f"k{i % 5}", rng.randrange(5_000), i, str(rng.randrange(steps))) for i in range(600)]
    conds = [(f"s{i}", F.col("flags") == str(i)) for i in range(steps)]
    for options in ({}, {"max_rows": 25}):
        assert run(spark, rows, within=900, steps=conds, **options) == brute(rows, 900, steps)


def test_one_long_chain(spark):
    """One key with 96 000 overlapping candidates: a scan of positions, no array of candidates."""
    n = 96_000
    rows = spark.range(n, numPartitions=4).select(
        F.lit("k").alias("k"), F.col("id").alias("pos"), F.lit(0).alias("tie"), F.substring(F.lit("021"), (F.col("id") % 3 + 1).cast("int"), 1).alias("flags")
    )
    got = match_sequence(rows.withColumn("payload", F.lit("x" * 200)), ["k"], ["pos", "tie"], abc(), 10, carry=["payload"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "collect_list" not in plan
    # a at 6 i, b at 6 i + 2, c at 6 i + 4; the start between lies inside the match.
    assert got.agg(F.count("*"), F.sum("a.pos"), F.sum("c.pos"), F.min(F.length("b.payload"))).head() == (
        n // 6, 6 * sum(range(n // 6)), 6 * sum(range(n // 6)) + 4 * (n // 6), 200)
