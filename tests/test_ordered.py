"""Nearest rows of keys cut into slices by rank."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ordered
from tracewell.operators.ordered import SLICE, Look, by_rank, neighbours

SHAPES = {
    "burst": lambda rng: 5_000_000 + rng.randrange(50) if rng.random() < 0.9 else rng.randrange(10**7),
    "one time": lambda rng: 77,
    "even": lambda rng: rng.randrange(10**7),
}


def made(spark, shape):
    rng = random.Random(shape)
    rows = [("hot" if i % 4 else f"k{i % 40}", SHAPES[shape](rng), i, rng.choice("xyz")) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "k string, ms long, seq long, kind string").repartition(5)


@pytest.mark.parametrize("shape", SHAPES)
def test_neighbours_in_slices(spark, shape):
    rows, df = made(spark, shape)
    looks = [Look("before", "prev", ["ms", "seq"], F.col("kind") == "x"), Look("after", "next", ["seq"])]
    got = neighbours(df, ["k"], ["ms", "seq"], looks, max_rows=200).collect()
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        last = None
        for i, (ms, seq, kind) in enumerate(own):
            want[seq] = last, own[i + 1][1] if i + 1 < len(own) else None
            last = (ms, seq) if kind == "x" else last
    have = {r.seq: (r.before and tuple(r.before), r.after and r.after.seq) for r in got}
    assert len(got) == len(rows) and have == want


@pytest.mark.parametrize("shape", SHAPES)
def test_slices_have_bounded_sizes(spark, shape):
    _, df = made(spark, shape)
    hot = df.filter("k = 'hot'")
    sizes = [r["count"] for r in by_rank(hot, ["k"], ["ms", "seq"], 15).groupBy(SLICE).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 12 and max(sizes) <= 3 * 200


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    df = spark.range(4000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("ms"))
    found = neighbours(df, ["k"], ["ms"], [Look("after", "next", ["ms"])])
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 30 and max(sizes) <= 2 * 100
    assert found.filter("after.ms = ms + 1000").count() == 3000


def test_full_buckets_are_counted_by_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    df = spark.range(300).select(F.when(F.col("id") < 200, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("ms"))
    hot = ordered.hot_keys(df, ["k"], "ms", 100)
    assert [r.k for r in hot.collect()] == [-1]
    assert ordered.hot_keys(df, ["k"], "ms", 200) is None
    found = neighbours(df, ["k"], ["ms"], [Look("before", "prev", ["ms"])], max_rows=100)
    assert found.count() == 300 and found.filter("before is not null").count() == 199


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Adaptive execution does not merge the tasks of a large table, however few bytes its rows take."""
    monkeypatch.setattr(ordered, "TASK_ROWS", 1000)
    rows = spark.range(7500).select((F.col("id") % 500).alias("k"), "id")
    found = ordered.dealt(rows, ["k"], 7500).groupBy(F.spark_partition_id()).count()
    assert found.agg(F.max("count")).head()[0] <= 2 * 1000
