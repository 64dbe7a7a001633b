"""The lexical index: pruned ranking, storage by batch."""

import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.operators import lexical as L
from tracewell.sources import runs
from tracewell.sources.runs import RunTable
from tracewell.streaming import jobs


def by_force(docs, queries, k):
    """docs: (id, group, valid, text); queries: (id, group, as_of, text)."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    toks = {d[0]: split(d[3]) for d in docs}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, group, as_of, text in queries:
        scores = []
        for d, own, valid, _ in docs:
            if group not in (None, own) or as_of is not None and not valid <= as_of:
                continue
            s = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(toks[d]) / mean))
                for w in sorted(set(split(text))) if (c := toks[d].count(w))
            )
            if s:
                scores.append((-round(s, 6), d))
        out += [(q, d, i + 1) for i, (_, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400), rng.randrange(400))}"
    docs = [(f"d{i:04d}", rng.choice("xyz"), rng.randrange(100), " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    docs += [(f"e{i}", docs[i][1], docs[i][2], docs[i][3]) for i in range(20)] + [("empty", "x", 1, ""), ("null", "x", 1, None)]
    queries = [(f"q{i}", rng.choice(["x", "y", None]), rng.choice([None, 50]), " ".join(word() for _ in range(10))) for i in range(25)]
    return docs, queries + [("nothing", None, None, "--"), ("unknown", None, None, "zzz")]


def frames(spark, docs, queries):
    ddf = spark.createDataFrame(docs, "doc_id string, group_id string, t long, text string").withColumn("valid_at", F.timestamp_seconds("t")).drop("t")
    qdf = spark.createDataFrame(queries, "query_id string, group_id string, t long, text string").withColumn("as_of", F.timestamp_seconds("t")).drop("t")
    return ddf, qdf


def rows(ranked):
    return sorted((r.query_id, r.doc_id, r["rank"]) for r in ranked.collect())


@pytest.mark.parametrize("k,sent", [(1, 500_000), (5, 500_000), (40, 500_000), (1, 0), (6, 0)])
def test_pruned_ranking_equals_all_pairs(spark, k, sent):
    docs, queries = corpus(k)
    ddf, qdf = frames(spark, docs, queries)
    assert rows(L.bm25_topk(ddf, qdf, k, by_group=True, sent_terms=sent)) == by_force(docs, queries, k)
    plain = [(q, None, None, t) for q, _, _, t in queries]
    assert rows(L.bm25_topk(ddf.drop("valid_at"), qdf.drop("as_of"), k, sent_terms=sent)) == by_force(docs, plain, k)


def test_most_pairs_are_not_scored(spark):
    """Queries with a few rare terms among common ones look at few of the pairs that share a term."""
    rng = random.Random(4)
    docs = []
    for i in range(2000):
        words = [f"c{rng.randrange(12)}" for _ in range(30)] + [f"r{rng.randrange(600)}" for _ in range(4)]
        docs.append((f"d{i}", "x", 1, " ".join(words)))
    queries = [(f"q{i}", None, None, " ".join([f"r{rng.randrange(600)}" for _ in range(3)] + [f"c{j}" for j in range(6)])) for i in range(40)]
    ddf, qdf = frames(spark, docs, queries)
    asked, docs_ = qdf.drop("as_of"), ddf.drop("valid_at")
    want = by_force(docs, queries, 5)
    assert rows(L.bm25_topk(docs_, asked, 5)) == want == rows(L.bm25_topk(docs_, asked, 5, sent_terms=0))

    # Joined by terms.
    index = L.built(docs_, [])
    terms = L._asked(asked, False, False)
    held = index.by_term(terms.select("term").distinct()).withColumn("_part", F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / 34.0)))
    most = held.groupBy("term", "block").agg(F.max("_part").alias("_most"))
    idf = F.log(1 + (2000 - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(index.frequencies, "term").withColumns({"_idf": idf, "_df": F.col("df")})
    weights = weights.join(most.groupBy("term").agg(F.max("_most").alias("_most")), "term").cache()
    marked = L.essential(weights, L.bounds(held, weights, 5, False))
    met = L._met(held, marked.filter("_needed"), False).select("query_id", "doc_id").distinct().count()
    left = L.candidates(held, most, marked, False).count()
    assert met < 0.2 * 2000 * 40 and left <= met

    # In blocks: documents that share no rare term with a query stand in blocks that it does not look at.
    frame = weights.select("query_id", "term", "_idf").toPandas()
    blocks = L.Asked(frame)
    numbers = {t: i for i, t in enumerate(blocks.names.to_pylist())}
    held = []
    for doc_id, _, _, text in sorted(docs, key=lambda d: sorted(w for w in d[3].split() if w[0] == "r")):
        words = [w for w in text.split() if w in numbers]
        own = sorted({numbers[w] for w in words})
        held.append((doc_id, len(held), np.array(own), np.array([sum(numbers[w] == t for w in words) for t in own])))
    table = pd.DataFrame(held, columns=["doc_id", "length", "at", "tf"])
    best = L.Best(len(blocks.ids), 5)
    scored = L.score_blocks(blocks, table.assign(length=table.index / 1e6), best, (1.2, 0.75, 34.0))
    assert scored < 0.9 * 2000 * 40


def test_store_by_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "MOST", 2)
    docs, queries = corpus(9, 120)
    ddf, qdf = frames(spark, docs, queries)
    store = L.LexicalStore(spark, f"file://{tmp_path}/index")
    parts = [docs[i::5] for i in range(5)]
    for number, part in enumerate(parts):
        store.append(frames(spark, part, queries)[0], number)
    store.append(frames(spark, parts[4], queries)[0], 4)  # a replay
    assert rows(L.search(store.read(), qdf, 5, by_group=True)) == by_force(docs, queries, 5)
    assert max(len(store._tables()[0].runs(s)) for s in range(L.SLOTS)) <= 4

    scoped = [q for q in queries if q[1] == "x"]
    index = store.read(["x"])
    assert rows(L.search(index, frames(spark, docs, scoped)[1], 5, by_group=True)) == by_force(docs, scoped, 5)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*slot#", plan)
    earlier = store.read(before=2)
    assert rows(L.search(earlier, qdf, 5, by_group=True)) == by_force(parts[0] + parts[1], queries, 5)


def test_run_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "MOST", 3)
    table = RunTable(spark, f"file://{tmp_path}/t", "day", "id string", ("id",))
    assert table.read(["a"]).count() == 0
    for n in range(12):
        table.merge(["a", "b"], n)
        new = spark.createDataFrame([(f"i{n}", "a"), (f"j{n}", "b" if n % 3 else "c")], "id string, day string")
        table.append(new, n)
        table.append(new, n)
        assert len(table.runs("a")) <= 5
    assert {r.id for r in table.read(["a"]).collect()} == {f"i{n}" for n in range(12)} and table.read(["a"]).count() == 12
    assert {r.id for r in table.read(["c"], 4).collect()} == {"j0", "j3"}


def test_many_groups_are_joined(spark, tmp_path):
    """Groups come as a table: their names are neither collected nor literals of a plan."""
    docs, queries = corpus(5, 80)
    scoped = [q for q in queries if q[1] == "x"]
    ddf, qdf = frames(spark, docs, scoped)
    store = L.LexicalStore(spark, f"file://{tmp_path}/index")
    store.append(ddf, 0)
    groups = spark.range(3000).select(F.concat(F.lit("nobody-"), "id").alias("group_id")).union(spark.sql("SELECT 'x'"))
    index = store.read(groups)
    assert rows(L.search(index, qdf, 5, by_group=True)) == by_force(docs, scoped, 5)
    ddf.withColumn("slot", L.slot_of("group_id")).write.partitionBy("slot").parquet(f"{tmp_path}/facts")
    mine = jobs.of_groups(spark.read.parquet(f"{tmp_path}/facts"), groups)
    assert {r.doc_id for r in mine.collect()} == {d[0] for d in docs if d[1] == "x"}
    for found in (index.postings, mine):
        assert "nobody-17" not in found._jdf.queryExecution().toString()


def test_batches_are_taken_in_pieces(spark):
    """A task makes arrays of a bounded number of documents, whatever number of rows a batch has."""
    words = [["a", "b"], [], ["c"], ["a"], ["b", "b", "c"]]
    batch = pa.RecordBatch.from_pydict({"id": list(range(5)), "w": words})
    parts = list(L.pieces(iter([batch, batch.slice(0, 0)]), 2))
    assert [p.num_rows for p in parts] == [2, 2, 1]
    assert [len(p.column("w").flatten()) for p in parts] == [2, 2, 3]
    docs, queries = corpus(3, L.SCANNED + 500)  # more than one piece of either size, in one batch
    docs, queries = docs[: L.SCANNED + 300], queries[:6]
    ddf, qdf = frames(spark, docs, queries)
    assert rows(L.bm25_topk(ddf.coalesce(1), qdf, 5, by_group=True)) == by_force(docs, queries, 5)
