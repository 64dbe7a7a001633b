"""Exact similarity of candidate pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import shingle_hashes

SHINGLE = 5
SIMILAR = 0.8


def jaccard(a: str | None, b: str | None) -> float:
    """Of the sets of five-word shingles; two texts without words are not similar."""
    x, y = set(shingle_hashes(a, SHINGLE).tolist()), set(shingle_hashes(b, SHINGLE).tolist())
    return len(x & y) / max(1, len(x | y))


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) for x, y in zip(left, right)], dtype="float64")

    return of(a, b)


def similar_pairs(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``candidates`` whose texts (id, body) are SIMILAR or more."""
    a = texts.select(F.col("id").alias("a"), F.col("body").alias("a_body"))
    b = texts.select(F.col("id").alias("b"), F.col("body").alias("b_body"))
    both = candidates.join(a, "a").join(b, "b")
    return both.filter(similarity(F.col("a_body"), F.col("b_body")) >= SIMILAR).select("a", "b")
