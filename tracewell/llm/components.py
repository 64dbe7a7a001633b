"""Connected components by alternating stars.

A large star hangs every greater neighbour of a node on the least node of its neighbourhood, a small
star does so with the smaller neighbours and the node itself. Repeated in turn they end in one star per
component around its least node, after about log² n rounds. Per round, two minima (aggregated before
the shuffle) and two joins of edges with one row per node; the minima are written first, so that both
sides of a join are plain shuffles and the skew join can split the edges of a centre. Only a count and
a checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written

ROUNDS = 60


def _hung(pairs: DataFrame) -> DataFrame:
    """Each (node, near): ``near`` hung on the least of the node and all its ``near``; (least, node) too."""
    least = pairs.groupBy("node").agg(F.min("near").alias("least"))
    least = written(least.select("node", F.least("node", "least").alias("least")), "least")
    hung = pairs.join(least, "node").select("near", "node", "least")
    return hung


def _directed(edges: DataFrame) -> DataFrame:
    return edges.filter("high != low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, least): for each node of an edge ``a``-``b`` the least node of its component.

    Loops, repeated edges and both directions are allowed; rows with a null end are left out. Without
    edges the result is empty.
    """
    now = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = written(_directed(now.select(F.col(a).alias("high"), F.col(b).alias("low"))), "edges")
    before = None
    for _ in range(ROUNDS):
        both = now.select(F.col("high").alias("node"), F.col("low").alias("near")).union(now.select("low", "high"))
        large = _hung(both).filter("near > node").select(F.col("near").alias("high"), F.col("least").alias("low"))
        down = written(_directed(large), "large").select(F.col("high").alias("node"), F.col("low").alias("near"))
        small = _hung(down)
        small = small.select(F.explode(F.array(F.struct(F.col("near").alias("high"), F.col("least").alias("low")), F.struct(F.col("node").alias("high"), F.col("least").alias("low")))).alias("e")).select("e.*")
        now = written(_directed(small), "small")
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("high", "low")), F.lit(0))).head()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    stars = now.select(F.col("high").alias("node"), F.col("low").alias("least"))
    return stars.union(now.select("low", "low").distinct())
