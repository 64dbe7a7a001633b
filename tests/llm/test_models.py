"""Held-out accuracy of the trained models, and their rows at the edges."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import language, toxicity

SMALL = "/root/testdata/sf0.01"
EDGE = [(None, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "the of and " * 15_000, "x"), (4, "the of and " * 15_000, "x")]


def brute_bits(train, text):
    """Code length of PPM with escape method C, walking contexts byte by byte."""
    pad = b"\n" * language.DEPTH
    tree = Counter()
    for t in train:
        data = pad + t
        for i in range(language.DEPTH, len(data)):
            for k in range(language.DEPTH + 1):
                tree[data[i - k : i], data[i]] += 1
    total, kinds = Counter(), Counter()
    for (context, _), n in tree.items():
        total[context] += n
        kinds[context] += 1
    bits, data = 0.0, pad + text
    for i in range(language.DEPTH, len(data)):
        for k in range(language.DEPTH, -1, -1):
            context = data[i - k : i]
            if n := tree[context, data[i]]:
                bits -= math.log2(n / (total[context] + kinds[context]))
                break
            if total[context]:
                bits -= math.log2(kinds[context] / (total[context] + kinds[context]))
        else:
            bits += 8
    return bits


def test_code_lengths(monkeypatch):
    monkeypatch.setattr(language, "_BLOCK", 7)
    sets = [[b"the cat and the hat", b"then"], [b"der hut und die maus", "über".encode()]]
    keys, counts = [], []
    for texts in sets:
        parts = [language.grams(np.frombuffer(b"\n" * language.DEPTH + t, np.uint8)) for t in texts]
        key, count = np.unique(np.concatenate(parts), return_counts=True)
        keys.append(key)
        counts.append(count.astype(float))
    model = language.freeze(["a", "b"], keys, counts)
    texts = [b"the hut", b"", b"zzz\xff", b"and then the cat sat on the mat" * 5, "über die".encode()]
    got = model.bits(texts)
    want = [[brute_bits(s, t) for s in sets] for t in texts]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, ~language.held_out())
    made = language.identified(docs, model)
    right = made.filter(language.held_out()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0]
    assert right > 0.97
    edge = language.identified(spark.createDataFrame(EDGE, "doc_id long, text string, score string"), model).collect()
    assert [r.lang_pred for r in edge][:3] == ["und"] * 3 and all(0 <= r.score <= 1 for r in edge)
    assert edge[3].lang_pred == edge[4].lang_pred == "en" and len(edge) == 5
    nothing = language.train(docs.limit(0), ~language.held_out())
    assert {r.lang_pred for r in language.identified(docs.limit(3), nothing).collect()} == {"und"}


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, ~toxicity.in_fold(1, 3))
    made = toxicity.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(toxicity.in_fold(1, 3))
    counts = {(r.toxic, r.p): r.n for r in made.groupBy("toxic", (F.col("score") >= 0.7).alias("p")).agg(F.count("*").alias("n")).collect()}
    assert counts.get((0, True), 0) <= 2
    assert counts[1, True] >= 3 * counts.get((1, False), 0)
    edge = toxicity.scored(spark.createDataFrame(EDGE, "doc_id long, text string, score string"), model).collect()
    assert len(edge) == 5 and all(0 <= r.score < 0.7 for r in edge)
    unlabelled = toxicity.train(docs, labels.limit(0), ~toxicity.in_fold(1, 3))
    assert toxicity.scored(docs.limit(5), unlabelled).agg(F.max("score")).head()[0] < 0.01
    odd = labels.select("doc_id", F.lit(None).cast("int").alias("toxic"), F.lit("x").alias("text"))
    assert toxicity.train(docs, odd, F.lit(True)).lexicon == []


def test_shared_evidence_counts_once():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    single = np.where(truth, rng.random(4000) < 0.6, rng.random(4000) < 0.1)
    other = np.where(truth, rng.random(4000) < 0.6, rng.random(4000) < 0.1)
    given = np.where(rng.random(4000) < 0.05, ~truth, truth).astype(float)
    votes = np.stack([single, single, single, other], axis=1).astype(float)
    p = toxicity.posterior(votes, given)
    assert ((p > 0.5) == truth).mean() > 0.94
