"""A training corpus from raw documents: five stages, each a written table that the next one reads.

Every stage works on all that the one before kept. The first four keep whole rows with all their columns;
the last adds what tokenization made of each text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from tracewell.llm.common import documents, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; fitted to the labelled rows outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.in_fold(1, 3))
    found = toxicity.scored(docs, model, "toxicity_score")
    return found.filter(F.col("toxicity_score") < toxicity.REJECT).drop("toxicity_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.kept_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 1)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints (three-word shingles) are linked by two bits or fewer."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids (little-endian unsigned 32-bit numbers), their number, and whether they decode to the text."""
    made = bpe.round_trip(docs, public_tokenizers.path(bpe.RANKS))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return made.withColumn("exact", same).drop("decoded", "begins")


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("bpe", tokenized),
]

#: A trained model and BPE decide rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
