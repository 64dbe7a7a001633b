"""SimHash near-duplicates with multi-index hashing.

The fingerprint of a text has a bit set if it is set in over half the hashes of its word shingles
(repeats included). Fingerprints that differ in at most two bits are linked, and components of links are
classes. Equal texts, and all texts of one fingerprint, are one node, so copies cost nothing further.

Search over distinct fingerprints: each is cut into two segments of 32 bits. Two bits can differ as
(0, 2), (1, 1) or (2, 0), so it is enough to probe the high segment's table with the Hamming ball of
radius one and the low segment's with radius zero, and to verify the whole distance of what is found.
Of a pair that differs in one high bit only the side that has the bit probes.

A segment value that many fingerprints share (more than ``CROWD``) would make all pairs of them; such a
bucket is never read. Its fingerprints enumerate the rest of the allowed ball instead, at most 528
whole fingerprints each, and look these up one by one: the same links, and no more rows than real links.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import documents, query, written
from tracewell.llm.components import components
from tracewell.llm.words import shingle_hashes

BITS = 2
CROWD = 512
_BLOCK = 1 << 15  # hashes whose bits are counted at once
_LOW = 0xFFFFFFFF


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; zero without hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprint of each text as a long; null, empty and blank texts have zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, words)) for t in texts], dtype="int64")

    return of(text)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(first: int, n: int, sizes: Iterable[int]) -> list[int]:
    """Masks of so many of the n bits from ``first`` on."""
    return [_signed(sum(1 << b for b in c)) for k in sizes for c in combinations(range(first, first + n), k)]


def links(prints: DataFrame) -> DataFrame:
    """(family, a, b): all pairs of distinct values of a family that differ in one or two bits, each pair once.

    ``prints`` has distinct rows (family, print): fingerprints of one kind are compared with each other.
    """
    p, other, low = F.col("print"), F.col("other"), F.col("print").bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(p, 32)

    def key(side: int, segment: Column) -> Column:
        return F.shiftleft(F.col("family") * 2 + side, 32).bitwiseOR(segment)

    index = prints.select("family", p.alias("other"), F.explode(F.array(key(0, high), key(1, low))).alias("key")).drop("family")
    # The side that has the differing bit probes; bit 0 stands for an equal segment.
    bit = F.explode(F.array(*[F.lit(m) for m in [0, *_flips(0, 32, [1])]])).alias("bit")
    ball = prints.select("family", "print", bit).filter(F.expr("bit = 0 OR (shiftrightunsigned(print, 32) & bit) != 0"))
    probes = ball.select("print", key(0, high).bitwiseXOR(F.col("bit")).alias("key"))
    probes = probes.union(prints.select("print", key(1, low)))
    crowds = written(index.groupBy("key").count().filter(F.col("count") > CROWD).select("key"), "crowds")

    family, is_low = F.shiftright("key", 33), F.shiftright("key", 32).bitwiseAND(F.lit(1)) == 1
    value = F.col("key").bitwiseAND(F.lit(_LOW))
    flipped = ~is_low & (value != high)
    # The low table is for pairs that differ in two high bits; the high table has the others.
    two_high = F.bit_count(high.bitwiseXOR(F.shiftrightunsigned("other", 32))) == 2
    found = probes.join(crowds, "key", "left_anti").join(index, "key")
    found = found.filter((F.bit_count(p.bitwiseXOR(other)) <= BITS) & (flipped | (p < other)) & (~is_low | two_high))

    many = probes.join(crowds, "key", "left_semi")

    def rest(which: Column, masks: list[int], start: Column) -> DataFrame:
        masks_ = F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")
        rows = many.filter(which).select("print", family.alias("family"), start.alias("start"), masks_)
        return rows.select("family", "print", F.col("start").bitwiseXOR(F.col("mask")).alias("other"))

    whole_pairs = rest(~is_low & ~flipped, _flips(0, 32, [1, 2]), p).union(rest(is_low, _flips(32, 32, [2]), p))
    guesses = whole_pairs.filter(p < other).union(
        rest(flipped, [0, *_flips(0, 32, [1])], F.shiftleft(value, 32).bitwiseOR(low))
    )
    hits = guesses.join(prints.select("family", p.alias("other")), ["family", "other"], "left_semi")
    return found.select(family.alias("family"), p.alias("a"), other.alias("b")).union(hits.select("family", "print", "other"))


def classes(rows: DataFrame) -> DataFrame:
    """(print, component_id): for each distinct ``rows.print`` the least ``rows.doc_id`` of its component."""
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")), "prints")
    pairs = written(links(prints.select(F.lit(0).cast("long").alias("family"), "print")), "links")
    found = components(pairs, "a", "b").withColumnRenamed("node", "print")
    joined = prints.join(found, "print", "left").withColumn("least", F.coalesce("least", "print"))
    smallest = joined.groupBy("least").agg(F.min("least_id").alias("component_id"))
    return joined.join(smallest, "least").select("print", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, print and component_id of every row.

    A component's id is the smallest doc_id in it (null if none of its rows has one). Rows without words
    have fingerprint zero and are linked like others; repeated rows and null ids give a row each. An empty
    table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = written(docs.select("doc_id", fingerprints(F.col("text"), words).alias("print")), "fingerprints")
    return rows.join(written(classes(rows), "classes"), "print")


def representatives(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component is kept, with their columns.

    The smallest doc_id stays (null last), of rows alike in it any one. Rows without words have fingerprint zero
    and form a class like others. No rows give no rows; columns keep their names, whatever they are.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), fingerprints(F.col("text"), words).alias("print"))
    packed = written(packed, "packed")
    own = F.col("doc.doc_id")
    rows = packed.select("row", "print", F.struct(own.isNull().alias("no_id"), own.alias("id"), "row").alias("doc_id"))
    found = rows.join(written(classes(rows.drop("row")), "classes"), "print")
    gone = found.filter(F.col("component_id.row") != F.col("row")).select("row")
    kept = packed.join(written(gone, "gone"), "row", "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


@query()
def op2_simhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
