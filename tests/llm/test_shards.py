"""The permutation, its inverse, and the law of sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import shards


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 65_537])
def test_permutation(n):
    numbers = np.arange(n)
    made = shards.permuted(numbers, n)
    assert sorted(made.tolist()) == list(range(n))
    assert (shards.permuted(made, n, forward=False) == numbers).all()
    assert n < 100 or (made == numbers).mean() < 0.05


def test_shards_do_not_depend_on_the_partitioning(spark):
    rows = [(i % 50 if i % 3 else None, f"t{i % 40}", "s") for i in range(211)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    order = [F.col("doc_id"), F.col("text")]
    results = []
    for n in (1, 7):
        got = shards.sharded(frame.repartition(n), order, 16).collect()
        results.append(sorted((str(r.doc_id), r.text, r.shard, r.slot) for r in got))
        sizes = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
        assert all(v == list(range(len(v))) for v in sizes.values())
        assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert results[0] == results[1]
    assert shards.sharded(frame.limit(0), order, 16).count() == 0


def test_written_shards(spark, tmp_path):
    frame = spark.range(100).select("id", F.lit("x").alias("text"))
    shards.write_shards(frame, [F.col("id")], 4, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
