"""Shards by a keyed permutation of row numbers.

Rows are numbered 0 to n-1 in an order that only their content decides. A Feistel network permutes the
numbers of the smallest even-width binary domain that holds n; a value outside goes through again until it
falls inside (cycle walking, under four rounds on average), which is a permutation of the n numbers. The
permuted number p gives shard p mod k and slot p div k: shard sizes differ by at most one row, slots have
no gaps, and both can be computed from a row's number, or the row's number from them, without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import documents, query, whole, written
from tracewell.llm.fuse import mix

ROUNDS = 6
SEED = 2024


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(values: np.ndarray, half: int, seed: int, forward: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = values >> np.uint64(half), values & low
    for r in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        if forward:
            left, right = right, left ^ (mix(right, seed + r) & low)
        else:
            left, right = right ^ (mix(left, seed + r) & low), left
    return left << np.uint64(half) | right


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, forward: bool = True) -> np.ndarray:
    """The permutation of 0..n-1 at each of the numbers, or its inverse."""
    half, out = _half_bits(n), numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _feistel(out[todo], half, seed, forward)
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their place (from 0) in the order; rows alike in it take neighbouring places.

    Ranges of the order are sorted on their own; their sizes, one row per range, give each an offset. An
    unused number spreads rows that are alike over ranges, so that no key is bound to one task.
    """
    spread = rows.withColumn("_any", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*order, "_any").sortWithinPartitions(*order, "_any").drop("_any")
    # Written, so that ranges and places stay the same when a task is repeated.
    placed = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part, inner = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # one row per range
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + inner).drop("_part", "_place", "_before")


def sharded(rows: DataFrame, order: list[Column], shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with number, shard and slot; the order should tell all different rows apart.

    Null keys come first, repeated rows get numbers of their own, no rows give no rows. The three columns
    replace existing ones of these names.
    """
    placed = numbered(rows.drop("number", "shard", "slot"), order)
    n = placed.count()

    @F.pandas_udf("long")
    def permutation(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    p = placed.withColumn("slot", permutation("number"))
    return p.withColumn("shard", F.pmod("slot", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("slot") / shards).cast("long"))


def write_shards(docs: DataFrame, order: list[Column], shards: int, path: str, seed: int = SEED) -> None:
    """One folder per shard, its rows sorted by slot within each file."""
    made = sharded(docs, order, shards, seed)
    made.hint("rebalance", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@query()
def op5_feistel_shards(spark, sf_dir):
    text = whole()
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    made = sharded(rows, [F.col("doc_id"), F.col("hash"), F.col("size")], 16)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
