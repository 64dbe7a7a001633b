"""The stages on the smallest table."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_simhash import brute_classes, brute_print
from tracewell.llm.common import written

SMALLEST = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    made = corpus_pipeline.run(spark, SMALLEST)
    assert set(docs.columns) < set(made.columns)
    assert made.agg(F.min("exact")).head()[0]
    n = made.count()
    assert docs.count() * 0.6 < n < docs.count()
    assert made.join(docs, ["doc_id", "text"], "left_semi").count() == n


def test_stages_keep_columns_and_take_no_rows(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALLEST)
        assert out.columns == docs.columns, name
        assert out.count() == 0


def _exact(rows):
    best = {}
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        own = (-len(text or ""), doc_id, text)
        best[key] = min(best.get(key, own), own)
    return [(doc_id, text) for _, doc_id, text in best.values()]


def _near(rows):
    prints = {doc_id: brute_print(text) for doc_id, text in rows}
    least = brute_classes({p: p for p in prints.values()})
    stays = {}
    for doc_id, p in prints.items():
        stays[least[p]] = min(stays.get(least[p], doc_id), doc_id)
    return [(doc_id, text) for doc_id, text in rows if doc_id in stays.values()]


def _clean(rows, items):
    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    windows = set()
    for text in items:
        own = words(text)
        windows |= {tuple(own[i : i + 10]) for i in range(len(own) - 9)} if len(own) >= 10 else {tuple(own)} if own else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        own = words(text)
        return any(tuple(own[i : i + n]) in windows for n in sizes for i in range(len(own) - n + 1))

    return [(doc_id, text) for doc_id, text in rows if not hit(text)]


def test_stages_equal_a_plain_chain(spark):
    """Behind the trained stage every stage keeps what a plain version of it keeps."""
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
    now = written(corpus_pipeline.STAGES[0][1](spark, docs, SMALLEST), "toxicity")
    rows = [(r.doc_id, r.text) for r in now.collect()]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[1:4], (_exact, _near, lambda r: _clean(r, items))):
        now, rows = written(stage(spark, now, SMALLEST), name), plain(rows)
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(rows), name
