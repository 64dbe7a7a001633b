"""Centroid clustering of integer vectors over zone maps along a Hilbert curve.

Vectors are sorted once by their place on a Hilbert curve through all their dimensions and packed into blocks of
neighbours; each block has a box, the least and greatest value of every component. In a round, the distance from a
centroid to the nearest and to the farthest point of a box bounds its distance to every vector inside. A centroid
whose nearest point is farther than the farthest point of another cannot win in that block, so it is not compared;
where one centroid is left, the block's sum is taken whole. The others are compared exactly, block by block, in
whole numbers. Sums and counts are added up per task and then in Spark; only the centroids (a stated number)
reach the driver and go out again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import query, table, written
from tracewell.plans.catalog import spread

CENTROIDS, ROUNDS = 8, 10
BLOCK = 512  # vectors of a block
CURVE_BITS = 4  # of each component in the Hilbert key
#: Squared distances of 64 components this large still fit 64 bits.
LARGEST = 1 << 27
_BLOCKS = "n int, ids array<{id}>, vectors binary, low binary, high binary, total binary"


def scaled(vectors: DataFrame, vector: str, dimensions: int, scale: int) -> DataFrame:
    """The rows whose vector has exactly so many components, none null or non-finite, with ``point``: floor(scale * x)."""
    x = F.col(vector)
    fine = (F.size(x) == dimensions) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).withColumn("point", F.transform(x, lambda e: F.floor(e.cast("double") * scale)))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row on the Hilbert curve, as a row of bytes that sort like it; ``cells`` are below 2**bits."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level, from the largest cubes down
        low = q - 1
        for i in range(n):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = [(x >> b & 1).T for b in range(bits - 1, -1, -1)]  # the highest bits of all dimensions first
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def blocks(points: DataFrame, id_column: str) -> DataFrame:
    """Blocks of neighbours on the curve with their boxes; ``points`` has the id and ``point``."""
    dimensions = points.select(F.max(F.size("point"))).head()[0] or 1
    ends = points.select(F.posexplode("point").alias("i", "x")).groupBy("i").agg(F.min("x"), F.max("x")).collect()
    low, high = (np.array([r[k] for r in sorted(ends)] or [0] * dimensions) for k in (1, 2))
    if max(np.abs(low).max(), np.abs(high).max()) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} do not fit 64-bit squared distances")
    width = np.maximum(1, -(-(high - low + 1) // (1 << CURVE_BITS)))
    kind = points.schema[id_column].dataType

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            keys = hilbert_keys((values - low) // width, CURVE_BITS)
            made = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=["id", "point", "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                numbers = (values.astype("<i4"), values.min(axis=0), values.max(axis=0), values.sum(axis=0))
                columns = [[part.num_rows], [part.column(0).to_pylist()], *[[v.tobytes()] for v in numbers]]
                types = [pa.int32(), pa.list_(part.schema.field(0).type), *[pa.binary()] * 4]
                names = ["n", "ids", "vectors", "low", "high", "total"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    rows = points.select(F.col(id_column).alias("id"), "point")
    placed = rows.mapInArrow(keyed, f"id {kind.simpleString()}, point array<long>, key binary")
    # Equal vectors have equal keys; a number of no meaning lets the ranges cut through them.
    placed = placed.withColumn("any", F.monotonically_increasing_id())
    sorted_ = placed.repartitionByRange("key", "any").sortWithinPartitions("key", "any").select("id", "point")
    return written(sorted_.mapInArrow(packed, _BLOCKS.format(id=kind.simpleString())), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that can be nearest to a point of the box; ties stay."""
    below, above = low - centroids, centroids - high
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(nearest <= farthest.min())


def nearest(values: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of the centroids ``which``; the smaller number of equals."""
    apart = np.stack([((values - centroids[c]) ** 2).sum(axis=1) for c in which])
    best = apart.argmin(axis=0)
    return which[best], apart[best, np.arange(len(values))]


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """n, place in the batch, and a reader of the vectors, box and sum of each block."""
    at = {name: batch.schema.get_field_index(name) for name in ("n", "vectors", "low", "high", "total")}
    for i in range(batch.num_rows):
        n = batch.column(at["n"])[i].as_py()
        box = [np.frombuffer(batch.column(at[c])[i].as_buffer(), np.int64) for c in ("low", "high", "total")]
        vectors = batch.column(at["vectors"])[i]
        yield i, n, box, lambda v=vectors, n=n: np.frombuffer(v.as_buffer(), "<i4").reshape(n, -1).astype(np.int64)


def moved(made: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the exact floor of the mean of the vectors of each, or as before without any."""
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, n, (low, high, whole), values in _each(batch):
                which = candidates(low, high, centroids)
                if len(which) == 1:
                    total[which[0]] += whole
                    count[which[0]] += n
                    continue
                vectors = values()
                own = nearest(vectors, centroids, which)[0]
                for c in which:
                    total[c] += vectors[own == c].sum(axis=0)
                count += np.bincount(own, minlength=k)
        some = np.flatnonzero(count)
        columns = [pa.array(some, pa.int64()), pa.array([[*total[c], count[c]] for c in some], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "parts"])

    parts = made.select("n", "vectors", "low", "high", "total").mapInArrow(sums, "cluster long, parts array<long>")
    added = parts.select("cluster", F.posexplode("parts").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")))
    found = {(r[0], r[1]): int(r[2]) for r in added.collect()}  # clusters x (dimensions + 1) numbers
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, dimensions] for i in range(dimensions)]
    return out


def assigned(made: DataFrame, centroids: np.ndarray, id_column: str) -> DataFrame:
    """(id, cluster, distance) of every vector of the blocks."""
    kind = made.schema["ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for i, _, (low, high, _), values in _each(batch):
                own, apart = nearest(values(), centroids, candidates(low, high, centroids))
                columns = [ids[i].values, pa.array(own, pa.int32()), pa.array(apart, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "cluster", "distance"])

    return made.mapInArrow(rows, f"`{id_column}` {kind}, cluster int, distance long")


def clustered(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = 64,
    scale: int = 1024,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    order: Column | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every whole vector, and the final centroids.

    The first centroids are the ``k`` vectors first in ``order`` (by default the hash of the id), ties by the
    vector itself. Vectors of another length or with a null or non-finite component are left out; repeated rows
    and null ids (hashed like an empty id) count like any other; fewer than ``k`` vectors give fewer centroids,
    none give no rows. Columns other than the two are not read.
    """
    order = order if order is not None else F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    points = scaled(vectors.select(id_column, vector), vector, dimensions, scale).select(id_column, "point")
    first = [r[0] for r in points.orderBy(order, "point").limit(k).select("point").collect()]
    if not first:
        return points.select(id_column, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dimensions), np.int64)
    made, centroids = blocks(points, id_column), np.array(first, np.int64)
    for _ in range(rounds):
        centroids = moved(made, centroids)
    return assigned(made, centroids, id_column), centroids


def _oracle() -> str:
    """The rounds as a chain of tables; means are exact floors of whole-number sums."""
    near = """
assigned{i} AS MATERIALIZED (
  SELECT vec_id, v, d.cluster, d.distance FROM (
    SELECT vec_id, any_value(p.v) AS v, min({{'distance': list_sum(list_transform(list_zip(p.v, c.v), lambda e: (e[1] - e[2]) * (e[1] - e[2])))::BIGINT, 'cluster': c.cluster}}) AS d
    FROM points p CROSS JOIN c{i} c GROUP BY p.vec_id)
)"""
    mean = """
means{i} AS (
  SELECT cluster, j, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
    SELECT cluster, j, sum(v[j]) AS s, count(*) AS n FROM assigned{i}, range(1, 65) r(j) GROUP BY cluster, j)
), c{next} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c
  LEFT JOIN (SELECT cluster, list(x ORDER BY j) AS v FROM means{i} GROUP BY cluster) m USING (cluster)
)"""
    steps = [near.format(i=i) + "," + mean.format(i=i, next=i + 1) for i in range(ROUNDS)]
    return f"""
WITH points AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, v FROM points QUALIFY cluster < {CENTROIDS}
),{','.join(steps)},{near.format(i=ROUNDS)}
SELECT vec_id, cluster::INTEGER AS cluster, distance,
  (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM assigned{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)
"""


@query(_oracle())
def op13_centroids(spark, sf_dir):
    rows, centroids = clustered(spread(table(spark, sf_dir, "embeddings")))
    rows = written(rows, "assigned")
    digests = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    spent = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row per centroid
    spent = spent.crossJoin(F.broadcast(rows.agg(F.sum("distance").alias("inertia"))))
    # One row per centroid on the small side, whatever the input.
    return rows.join(F.broadcast(spent.join(named, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
