"""Exact duplicates: a new batch against an immutable snapshot.

Texts are equal if they are identical without the characters of [\\x20\\x09-\\x0D]; null counts as
empty. A text is known by the SHA-256 of what remains. The snapshot's distinct digests lie in buckets
by their first bits, each with a static binary fuse filter. The batch's distinct digests are grouped
on their own, then screened by the filter of their bucket: those that it rules out are new for
certain, the others join the snapshot's exact bucket. Every group of two or more rows is then checked
byte for byte; a pair of texts that shares a digest without being equal stops the job.

Of a group, the row of the longest original text in code points stays, then the smallest doc_id (null
last), then any one of the repeated rows: exactly one row of a group is kept.

What moves: one narrow row per document, one per distinct digest, and for the byte check the texts,
once, by digest. Counts and winners are aggregated before each shuffle, so a group that holds a third
of all rows costs one row per task; the byte check leaves such a group to the skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import fuse
from tracewell.llm.common import SPACES, documents, query, whole, written

BUCKET_DIGESTS = 16_384  # digests of a bucket, on average
FILTER = "bucket int, seed long, segment int, starts int, slots binary"


def normalised(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digested(docs: DataFrame) -> DataFrame:
    """One narrow row per document: row (its number), doc_id, n_points, digest, plus is_new if it is there."""
    extra = ["is_new"] if "is_new" in docs.columns else []
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.length(whole()).alias("n_points"),
        F.unhex(F.sha2(normalised(whole()), 256)).alias("digest"),
        *extra,
    )
    return written(rows, "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: its number of rows and the one that stays."""
    best = F.struct((-F.col("n_points")).alias("minus"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("best")
    return rows.select("digest", best).groupBy("digest").agg(F.count("*").alias("size"), F.min("best").alias("best"))


def bucketed(groups: DataFrame, n_buckets: int) -> DataFrame:
    """Groups with the first 64 bits of their digest as key, and the bucket that these choose."""
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    return groups.withColumn("key", key).withColumn("bucket", F.pmod("key", F.lit(n_buckets)).cast("int"))


def filters(groups: DataFrame) -> DataFrame:
    """One static filter per bucket of a snapshot's groups."""

    def one(keys: pd.DataFrame) -> pd.DataFrame:
        made = fuse.build(keys["key"].to_numpy().view(np.uint64))
        return pd.DataFrame(
            [[int(keys["bucket"].iloc[0]), made.seed, made.segment, made.starts, made.slots]],
            columns=["bucket", "seed", "segment", "starts", "slots"],
        )

    return groups.select("bucket", "key").groupBy("bucket").applyInPandas(one, FILTER)


def screened(groups: DataFrame, made: DataFrame) -> DataFrame:
    """(digest, maybe): whether the filter of its bucket holds the digest's key; no filter holds nothing."""

    def one(known: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(new), bool)
        if len(known):
            f = known.iloc[0]
            filter_ = fuse.Fuse(int(f["seed"]), int(f["segment"]), int(f["starts"]), f["slots"])
            maybe = filter_.contains(new["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"digest": new["digest"], "maybe": maybe})

    keys = groups.select("bucket", "key", "digest")
    return made.groupBy("bucket").cogroup(keys.groupBy("bucket")).applyInPandas(one, "digest binary, maybe boolean")


def same_bytes(docs: DataFrame, repeated: DataFrame) -> None:
    """Stop if two texts of one of the ``repeated`` digests differ in a byte after normalisation."""
    texts = docs.select(normalised(whole()).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    # Written, so that the least and greatest text of a large group come from many tasks.
    copies = written(texts.join(repeated, "digest"), "copies")
    ends = copies.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    odd = ends.filter(F.col("least") != F.col("most")).select(F.hex("digest")).head()
    if odd:
        raise ValueError(f"different texts share the SHA-256 {odd[0]}")


def decided(docs: DataFrame, is_new: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The narrow rows, and one row per digest with its size and the row that stays.

    ``is_new`` splits the rows into the snapshot (false or null) and the new batch; without it all are
    new. The result does not depend on the split, only the way to it.
    """
    split = is_new if is_new is not None else F.lit(True)
    docs = docs.select("doc_id", "text", F.coalesce(split, F.lit(False)).alias("is_new"))
    rows = digested(docs)
    known = written(grouped(rows.filter(~F.col("is_new"))), "known")
    new = written(grouped(rows.filter("is_new")), "new")
    n_buckets = max(1, -(-max(known.count(), new.count()) // BUCKET_DIGESTS))
    known, new = bucketed(known, n_buckets), bucketed(new, n_buckets)
    seen = screened(new, written(filters(known), "filters"))
    new = written(new.join(seen, "digest").select("digest", "size", "best", "maybe"), "screened")

    exact = known.select("digest", "size", "best").unionByName(new.filter("maybe").drop("maybe"))
    exact = exact.groupBy("digest").agg(F.sum("size").alias("size"), F.min("best").alias("best"))
    groups = written(exact.unionByName(new.filter("NOT maybe").drop("maybe")), "groups")
    same_bytes(docs, groups.filter("size > 1").select("digest"))
    return rows, groups


def deduplicate(docs: DataFrame, is_new: Column | None = None) -> DataFrame:
    """Every row with its group: doc_id, digest, size, keep_id, kept.

    An empty table gives no rows, empty and null texts form one group, and columns other than doc_id
    and text are not read.
    """
    rows, groups = decided(docs, is_new)
    best = groups.select("digest", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    joined = rows.select("row", "doc_id", "digest").join(best, "digest")
    return joined.select("doc_id", "digest", "size", "keep_id", (F.col("row") == F.col("keep_row")).alias("kept"))


def kept_documents(docs: DataFrame, is_new: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows alike in doc_id and text any one stays."""
    rows, groups = decided(docs, is_new)
    repeated = groups.filter("size > 1").select(
        F.col("digest").alias("own_digest"), F.col("best.doc_id").alias("own_id"), (-F.col("best.minus")).alias("own_points")
    )
    ties = rows.join(
        repeated,
        (F.col("digest") == F.col("own_digest"))
        & F.col("doc_id").eqNullSafe(F.col("own_id"))
        & (F.col("n_points") == F.col("own_points")),
    )
    ties = ties.groupBy("own_digest", "own_id", "own_points").agg(F.count("*").alias("own_ties"))
    plain = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    packed = docs.select(
        F.struct("*").alias("doc"),
        F.unhex(F.sha2(normalised(whole()), 256)).alias("digest"),
        F.length(whole()).alias("n_points"),
    )
    winners = written(ties, "winners")
    found = packed.join(winners, F.col("digest") == F.col("own_digest"), "left").filter(
        F.col("own_digest").isNull()
        | F.col("doc.doc_id").eqNullSafe(F.col("own_id")) & (F.col("n_points") == F.col("own_points"))
    )
    single = found.filter("coalesce(own_ties, 1) = 1").select(*plain)
    if not winners.filter("own_ties > 1").head(1):
        return single  # no winner is repeated, so the texts need not be grouped once more
    several = found.filter("own_ties > 1").groupBy("digest").agg(F.first("doc").alias("doc")).select(*plain)
    return single.unionByName(several)


@query("""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), n AS (
  SELECT doc_id, length(t) AS n_points, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM d
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
""")
def op4_exact_dedup(spark, sf_dir):
    """Documents whose number's checksum is odd arrive as a batch, the others are the snapshot."""
    docs = documents(spark, sf_dir)
    found = deduplicate(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 1)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
