"""The queries of this folder and their SQL."""

from tracewell.llm import bpe, centroids, decontaminate, exact_dedup, fim, language, passages, secrets, shards, simhash, suffixes, token_counts, toxicity  # noqa: F401
from tracewell.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
