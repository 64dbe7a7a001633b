"""Groups of equal texts against a plain grouping, and the filters."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import exact_dedup, fuse

ROWS = [
    (5, "a b", "x"), (3, "a  b", "x"), (4, "ab\n ", "x"), (9, "a  b", "y"), (7, None, "x"), (8, "", "x"), (6, " \t\x0b", "x"),
    (1, "é b", "x"), (2, "é b", "x"), (None, "é  b", "x"), (None, "q", "x"), (11, "a\u0085b", "x"), (12, "z" * 100_000, "x"),
    (20, "same", "x"), (20, "same", "x"), (20, "same", "z"),
]
SCHEMA = "doc_id long, text string, digest string"


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 20_000])
def test_fuse_filters_hold_their_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    made = fuse.build(np.concatenate([keys, keys]))
    assert made.contains(keys).all()
    assert made.contains(rng.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 1e-3


@pytest.mark.parametrize("split", [None, "odd"])
def test_groups(spark, split):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup.deduplicate(frame, F.col("doc_id") % 2 == 1 if split else None).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[plain(text)].append((-len(text or ""), doc_id is None, doc_id or 0))
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): sorted(g) for t, g in groups.items()}
    assert len(got) == len(ROWS)
    for r in got:
        group = by_digest[bytes(r.digest).hex()]
        assert r.size == len(group)
        assert r.keep_id == (None if group[0][1] else group[0][2])
    kept = defaultdict(int)
    for r in got:
        kept[bytes(r.digest)] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(by_digest)


def test_kept_documents_and_no_rows(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.kept_documents(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "6", "None", "None", "11", "12", "20"])
    assert exact_dedup.deduplicate(frame.limit(0)).count() == 0
    assert exact_dedup.kept_documents(frame.limit(0)).count() == 0


def test_different_texts_of_one_digest_stop_the_job(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    monkeypatch.setattr(F, "sha2", lambda column, bits: F.lit("00"))
    with pytest.raises(ValueError, match="share the SHA-256"):
        exact_dedup.deduplicate(frame)
