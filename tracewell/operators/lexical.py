"""Lexical (BM25) ranking over an index, exact and with most pairs of query and document never scored.

A search whose query terms fit a stated number of rows goes to the documents: each task takes its documents in blocks of
similar length and knows the greatest weight of each term in a block. The sum of these over a query's terms
bounds the score of every document of the block; a block whose bound is below the k-th best score that the task has
for the query is not scored (block-max pruning). Only the best ``k`` per query and task are shuffled.

A larger query table is joined by terms, with pairs ruled out in three steps, each by an exact bound:

1. The rarest terms of a query give it some documents, and their whole scores a lower bound for its k-th best.
2. Terms whose greatest weights, summed from the smallest up, stay below that bound cannot bring a document into
   the result by themselves; candidates come from the postings of the other terms only.
3. A candidate's score over these terms, plus the greatest weights that the other terms have in its block, must
   reach the bound; only then the postings of the other terms are looked up.

An index can be built for one search, or stored and appended to by batch (``LexicalStore``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.functions.text import terms
from tracewell.sources.runs import RunTable
from tracewell.storage import written

K1, B = 1.2, 0.75
SCORE_DIGITS = 6
SLACK = 1e-5  # more than what rounding and the order of sums can change
BLOCK = 128  # documents of a block
PIECE, SCANNED = 256, 4096  # documents that a task holds at once, as arrays of all words and of asked ones
SEEDS = 4  # times k: how many postings of rare terms are read for a first bound
SLOTS = 32  # folders of a stored index
#: Query terms (rows of query and term) that are sent to every task: some 100 bytes each.
SENT_TERMS = 500_000
#: Stands in a document's terms for the document itself, which may have no others.
DOCUMENT = ""


def dated(docs: DataFrame, queries: DataFrame) -> bool:
    """Whether queries say until when they look; then only documents valid by then are ranked for them."""
    return "valid_at" in docs.columns and "as_of" in queries.columns


def visible() -> Column:
    return F.col("as_of").isNull() | F.coalesce(F.col("valid_at") <= F.col("as_of"), F.lit(False))


def top_k(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` per query, ties by document. Spark cuts each partition to ``k`` per query first."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


class Best:
    """The best ``k`` of each query so far; equal scores go to the smaller document."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), None

    def least(self) -> np.ndarray:
        """What a new document must reach."""
        return self.scores[:, -1]

    def add(self, own: np.ndarray, made: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (columns, in order of their ids) for the queries ``own``; -inf for none."""
        if self.ids is None:
            self.ids = np.full(self.scores.shape, ids[0], dtype=ids.dtype)
        chosen = np.argsort(-made, axis=1, kind="stable")[:, : self.k]
        scores = np.hstack([self.scores[own], np.take_along_axis(made, chosen, axis=1)])
        found = np.hstack([self.ids[own], ids[chosen]])
        rank = np.unique(found, return_inverse=True)[1].reshape(found.shape)
        order = np.lexsort((rank, -scores), axis=-1)[:, : self.k]
        self.scores[own] = np.take_along_axis(scores, order, axis=1)
        self.ids[own] = np.take_along_axis(found, order, axis=1)

    def rows(self, query_ids: np.ndarray) -> Iterator[pd.DataFrame]:
        if self.ids is not None:
            columns = {"query_id": np.repeat(query_ids, self.k), "doc_id": self.ids.ravel(), "score": self.scores.ravel()}
            made = pd.DataFrame(columns)
            yield made[made.score > -np.inf]


@dataclass(frozen=True)
class Index:
    """``documents``: doc_id, length, the distinct terms and their counts, with group_id and valid_at where searches need
    them; or ``postings``: the same with a row per document and term (term, tf). ``frequencies``: term and df, summed
    over rows. ``n_docs`` and ``n_words`` of the corpus."""

    documents: DataFrame | None
    postings: DataFrame | None
    frequencies: DataFrame
    n_docs: int
    n_words: int

    @property
    def columns(self) -> list[str]:
        held = self.documents if self.documents is not None else self.postings
        return [c for c in ("group_id", "valid_at") if c in held.columns]

    def by_document(self, vocabulary: DataFrame) -> DataFrame:
        """A row per document; of the terms at least those of the vocabulary."""
        if self.documents is not None:
            return self.documents
        held = self.postings.join(vocabulary, "term", "left_semi")
        grouped = held.groupBy("doc_id", *self.columns, "length").agg(F.collect_list(F.struct("term", "tf")).alias("_p"))
        counts = F.col("_p.tf").cast("array<int>").alias("counts")
        return grouped.select("doc_id", *self.columns, "length", F.col("_p.term").alias("terms"), counts)

    def by_term(self, vocabulary: DataFrame) -> DataFrame:
        """A row per document and term of the vocabulary, with the block of the document."""
        rows = self.postings
        if rows is None:
            pair = F.explode(F.arrays_zip("terms", "counts")).alias("_p")
            rows = self.documents.select("doc_id", *self.columns, "length", pair)
            rows = rows.select("doc_id", *self.columns, "length", F.col("_p.terms").alias("term"), F.col("_p.counts").alias("tf"))
        # Documents of a block have similar lengths, so that the greatest weights of their terms are close bounds.
        steps = F.shiftleft(F.floor(2 * F.log2(F.col("length") + 1)).cast("long"), 32)
        block = steps + F.pmod(F.xxhash64("doc_id"), F.lit(max(1, self.n_docs // (4 * BLOCK))))
        return rows.join(vocabulary, "term", "left_semi").withColumn("block", block)


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The postings of ``docs(doc_id, text)``, with one row of the term ``DOCUMENT`` for each document.

    Terms are counted before the shuffle.
    """
    tokens = docs.select("doc_id", *keep, terms(F.coalesce("text", F.lit(""))).alias("_t"))
    rows = tokens.select("doc_id", *keep, F.size("_t").alias("length"), F.explode(F.concat("_t", F.array(F.lit(DOCUMENT)))).alias("term"))
    return rows.groupBy("doc_id", *keep, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def built(docs: DataFrame, keep: list[str], vocabulary: list[str] | None = None) -> Index:
    """An index of these documents, written once. With a vocabulary other terms are left out; lengths count all.

    Terms are counted where the texts are, in one pass and without a shuffle.
    """
    tokens = docs.select("doc_id", *keep, terms(F.coalesce("text", F.lit(""))).alias("_t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.drop("_t").schema)
    wanted = None if vocabulary is None else pa.array(vocabulary, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            held = batch.column(batch.num_columns - 1)
            lengths = np.diff(held.offsets.to_numpy())
            words = held.flatten()
            names = wanted if wanted is not None else pc.unique(words)
            at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy()
            keys = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) << 32 | at
            keys, n = np.unique(keys[at >= 0], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(lengths) + 1, dtype=np.int64) << 32).astype(np.int32))
            made = [pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(offsets, names.take(pa.array(keys & 0xFFFFFFFF)))]
            made.append(pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "length", "terms", "counts"])

    found = written(tokens.mapInArrow(count, f"{kinds}, length int, terms array<string>, counts array<int>"), "documents")
    n_docs, n_words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).head()
    frequencies = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(found, None, frequencies, n_docs, n_words)


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in views of ``size`` rows: Spark cuts batches by rows, and arrays over the words of long texts are large."""
    for batch in batches:
        for first in range(0, batch.num_rows, size):
            yield batch.slice(first, size)


@dataclass(frozen=True)
class LexicalStore:
    """A stored index of documents by group, appended to by batch.

    Postings lie by a slot of their group and term frequencies by a slot of the term, so a search reads the
    folders of its own groups and terms; corpus totals are a row per batch.
    """

    spark: SparkSession
    path: str

    def _tables(self) -> tuple[RunTable, RunTable, RunTable]:
        names = "doc_id string, group_id string, valid_at timestamp, term string, tf long, length int"
        return (
            RunTable(self.spark, f"{self.path}/postings", "slot", names, ("group_id", "term")),
            RunTable(self.spark, f"{self.path}/frequencies", "slot", "term string, df long", ("term",)),
            RunTable(self.spark, f"{self.path}/totals", "slot", "n_docs long, n_words long"),
        )

    def append(self, docs: DataFrame, batch: int) -> None:
        """Index ``docs(doc_id, group_id, valid_at, text)`` of a batch; a replayed batch replaces what it wrote."""
        postings, frequencies, totals = self._tables()
        found = written(counted(docs, ["group_id", "valid_at"]), "postings")
        sums = found.filter(F.col("term") == DOCUMENT).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_words"))
        n_docs = sums.head()["n_docs"]
        if not n_docs:
            return
        every = [str(s) for s in range(SLOTS)]
        for table, slots in ((postings, every), (frequencies, every), (totals, ["0"])):
            table.merge(slots, batch)
        rows = found.filter(F.col("term") != DOCUMENT)
        columns = ["doc_id", "group_id", "valid_at", "term", "tf", "length"]
        postings.append(rows.select(*columns, slot_of("group_id").alias("slot")), batch)
        counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        frequencies.append(counts.select("term", "df", slot_of("term").alias("slot")), batch)
        totals.append(sums.select("n_docs", "n_words", F.lit("0").alias("slot")), batch)

    def read(self, groups: list[str] | DataFrame | None = None, before: int | None = None) -> Index:
        """The index over the given groups (all without), whose folders alone are listed; totals are of the whole corpus.

        Many groups come as a table of ``group_id``.
        """
        postings, frequencies, totals = self._tables()
        every = [str(s) for s in range(SLOTS)]
        if groups is None:
            rows = postings.read(every, before)
        elif isinstance(groups, DataFrame):
            rows = postings.read(slots_of(groups), before).join(groups, "group_id", "left_semi")
        else:
            wanted = self.spark.createDataFrame([(g,) for g in groups], "group_id string")
            rows = postings.read(slots_of(wanted), before).filter(F.col("group_id").isin(groups))
        size = totals.read(["0"], before).agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).head()
        return Index(None, rows.drop("slot"), frequencies.read(every, before).drop("slot"), *size)


def slot_of(column: str) -> Column:
    """The folder of a stored table that a value lies in."""
    return F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("string")


def slots_of(groups: DataFrame) -> list[str]:
    """The folders that the rows of these groups lie in, at most ``SLOTS``."""
    return [r[0] for r in groups.select(slot_of("group_id")).distinct().collect()]


def joined(indexes: list[Index]) -> Index:
    """Several stored indexes of different documents as one."""
    first = indexes[0]
    for other in indexes[1:]:
        first = Index(
            None,
            first.postings.unionByName(other.postings),
            first.frequencies.unionByName(other.frequencies),
            first.n_docs + other.n_docs,
            first.n_words + other.n_words,
        )
    return first


def bm25_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    by_group: bool = False,
    k1: float = K1,
    b: float = B,
    sent_terms: int = SENT_TERMS,
) -> DataFrame:
    """Lexical ranking of ``docs(doc_id, text)`` for ``queries(query_id, text)``.

    With ``by_group`` both sides have ``group_id`` and a query only sees its group (a null group sees all). With
    ``valid_at`` and ``as_of`` a query sees what was valid by then. Scores are rounded before ranking, so equal
    texts tie. Null texts are empty.
    """
    by_time = dated(docs, queries)
    keep = [*(["group_id"] if by_group else []), *(["valid_at"] if by_time else [])]
    asked = _asked(queries, by_group, by_time)
    few = asked.limit(sent_terms + 1).count() <= sent_terms
    vocabulary = [r[0] for r in asked.select("term").distinct().collect()] if few else None
    return search(built(docs, keep, vocabulary), queries, k, by_group, k1, b, sent_terms)


def _asked(queries: DataFrame, by_group: bool, by_time: bool) -> DataFrame:
    return queries.select(
        "query_id",
        *([F.col("group_id").alias("_scope")] if by_group else []),
        *(["as_of"] if by_time else []),
        F.explode(F.array_distinct(terms(F.col("text")))).alias("term"),
    )


def search(
    index: Index,
    queries: DataFrame,
    k: int,
    by_group: bool = False,
    k1: float = K1,
    b: float = B,
    sent_terms: int = SENT_TERMS,
) -> DataFrame:
    """query_id, doc_id, score and rank of the best ``k`` documents of an index for each query; see ``bm25_topk``."""
    by_time = "valid_at" in index.columns and "as_of" in queries.columns
    asked = _asked(queries, by_group, by_time)
    vocabulary = asked.select("term").distinct()
    df = index.frequencies.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("_df"))
    idf = F.log(1 + (index.n_docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = written(asked.join(df, "term").withColumn("_idf", idf), "weights")
    mean = index.n_words / max(index.n_docs, 1) or 1.0
    if weights.limit(sent_terms + 1).count() <= sent_terms:
        found = _scanned(index.by_document(vocabulary), weights, k, by_group, by_time, (k1, b, mean), queries.schema["query_id"])
        return top_k(found, k)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    held = index.by_term(vocabulary).select("doc_id", *index.columns, "block", "term", part.alias("_part"))
    held = written(held, "held")
    most = written(held.groupBy("term", "block").agg(F.max("_part").alias("_most")), "most")
    reach = most.groupBy("term").agg(F.max("_most").alias("_most"))
    return top_k(_scores(held, most, written(weights.join(reach, "term"), "weights"), k, by_group), k)


class Asked:
    """The query terms of a search as arrays: query by query, the numbers and weights of its terms."""

    def __init__(self, weights: pd.DataFrame):
        weights = weights.sort_values(["query_id", "term"], ignore_index=True)
        names, self.term = np.unique(weights.term.to_numpy(), return_inverse=True)
        self.names, self.idf = pa.array(names, pa.string()), weights._idf.to_numpy()
        first = np.flatnonzero(~weights.query_id.duplicated().to_numpy())
        self.starts, self.ids = first, weights.query_id.to_numpy()[first]
        self.stops = np.append(first[1:], len(weights))
        one = weights.iloc[first]
        self.scope = one["_scope"].to_numpy() if "_scope" in weights else None
        self.free = one["_scope"].isna().to_numpy() if "_scope" in weights else None
        self.as_of = one["as_of"].to_numpy() if "as_of" in weights else None

    def bounds(self, most: np.ndarray) -> np.ndarray:
        """Of each query the sum of the greatest weights that its terms have in a block."""
        return np.add.reduceat(self.idf * most[self.term], self.starts)

    def scores(self, own: np.ndarray, local: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Scores of the documents of a block (columns of ``parts``; its rows are the terms at ``local``)."""
        return np.stack([self.idf[a:z] @ parts[local[self.term[a:z]]] for a, z in zip(self.starts[own], self.stops[own])])


def score_blocks(asked: Asked, docs: pd.DataFrame, best: Best, constants: tuple[float, float, float]) -> int:
    """Score documents block by block; the number of pairs that were scored.

    ``docs``: doc_id, length, and arrays ``at`` (numbers of asked terms) and ``tf``, with group_id and valid_at.
    """
    k1, b, mean = constants
    by = [*(["group_id"] if asked.scope is not None else []), "length"]
    docs, scored = docs.sort_values(by, ignore_index=True), 0
    for first in range(0, len(docs), BLOCK):
        block = docs.iloc[first : first + BLOCK].sort_values("doc_id", ignore_index=True)
        sizes = block["at"].map(len).to_numpy()
        at, tf = np.concatenate(block["at"].to_list()), np.concatenate(block["tf"].to_list()).astype(float)
        length = np.repeat(block.length.to_numpy(), sizes)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        here, local_at = np.unique(at, return_inverse=True)
        parts = np.zeros((len(here) + 1, len(block)))  # the last row is for terms that the block does not have
        parts[local_at, np.repeat(np.arange(len(block)), sizes)] = part
        most, local = np.zeros(len(asked.names)), np.full(len(asked.names), len(here))
        most[here], local[here] = parts[:-1].max(axis=1), np.arange(len(here))
        bound = asked.bounds(most)
        hopeful = (bound > 0) & (bound >= best.least() - SLACK)
        if asked.scope is not None:
            groups = block.group_id.to_numpy()
            hopeful &= asked.free | np.isin(asked.scope.astype(str), groups.astype(str))
        own = np.flatnonzero(hopeful)
        if not len(own):
            continue
        raw = asked.scores(own, local, parts)
        made = np.where(raw > 0, np.round(raw, SCORE_DIGITS), -np.inf)
        if asked.scope is not None:
            made[~(asked.free[own][:, None] | (asked.scope[own][:, None] == groups[None, :]))] = -np.inf
        if asked.as_of is not None:
            as_of = asked.as_of[own][:, None]
            made[~(np.isnat(as_of) | (block.valid_at.to_numpy()[None, :] <= as_of))] = -np.inf
        best.add(own, made, block.doc_id.to_numpy())
        scored += made.size
    return scored


def _scanned(documents, weights, k, by_group, by_time, constants, query_field) -> DataFrame:
    columns = ["query_id", "term", "_idf", *(["_scope"] if by_group else []), *(["as_of"] if by_time else [])]
    asked = Asked(weights.select(*columns).toPandas())  # counted before
    schema = T.StructType([query_field, documents.schema["doc_id"], T.StructField("score", T.DoubleType())])
    keep = [*(["group_id"] if by_group else []), *(["valid_at"] if by_time else [])]

    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked.ids), k)
        for batch in pieces(batches, SCANNED) if len(asked.ids) else ():
            words, tf = batch.column("terms"), batch.column("counts").flatten().to_numpy()
            at = pc.fill_null(pc.index_in(words.flatten(), value_set=asked.names), -1).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))[at >= 0]
            held = np.unique(row)
            if not len(held):
                continue
            cut = np.searchsorted(row, held[1:])
            docs = batch.select(["doc_id", "length", *keep]).take(pa.array(held)).to_pandas()
            docs = docs.assign(at=np.split(at[at >= 0], cut), tf=np.split(tf[at >= 0], cut))
            if by_time:
                docs["valid_at"] = docs.valid_at.dt.tz_localize(None)
            score_blocks(asked, docs, best, constants)
        for found in best.rows(asked.ids):
            yield pa.RecordBatch.from_pandas(found, arrow, preserve_index=False)

    return documents.select("doc_id", "length", "terms", "counts", *keep).mapInArrow(scan, schema)


def _met(held: DataFrame, weights: DataFrame, by_group: bool) -> DataFrame:
    """Postings with the query terms they match; a scoped query only meets its own group, a dated one its past."""
    columns = ["query_id", "doc_id", "block", "_idf", "_part"]
    parts = [(weights, ["term"])]
    if by_group:
        scoped = weights.filter(F.col("_scope").isNotNull()).withColumnRenamed("_scope", "group_id")
        parts = [(scoped, ["group_id", "term"]), (weights.filter(F.col("_scope").isNull()).drop("_scope"), ["term"])]
    found = None
    for some, keys in parts:
        met = held.join(some, keys)
        met = (met.filter(visible()) if "as_of" in weights.columns else met).select(*columns)
        found = met if found is None else found.unionByName(met)
    return found


def _sum() -> Column:
    return F.sum(F.col("_idf") * F.col("_part"))


def _completed(pairs: DataFrame, held: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, doc_id and the sum over the query's ``weights`` for each pair that has some."""
    asked = pairs.select("query_id", "doc_id").join(weights.select("query_id", "term", "_idf"), "query_id")
    return asked.join(held.select("doc_id", "term", "_part"), ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(_sum().alias("_sum"))


def bounds(held: DataFrame, weights: DataFrame, k: int, by_group: bool) -> DataFrame:
    """query_id and a score that its k-th best document reaches at least, for queries that have as many seeds."""
    rarest = Window.partitionBy("query_id").orderBy("_df", "term").rowsBetween(Window.unboundedPreceding, -1)
    few = weights.withColumn("_before", F.coalesce(F.sum("_df").over(rarest), F.lit(0))).filter(F.col("_before") < SEEDS * k)
    seeds = top_k(_met(held, few, by_group).groupBy("query_id", "doc_id").agg(_sum().alias("score")), 2 * k)
    whole = _completed(written(seeds.select("query_id", "doc_id"), "seeds"), held, weights)
    best = top_k(whole.withColumnRenamed("_sum", "score"), k)
    return best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_bound")).filter(F.col("_n") == k).drop("_n")


def essential(weights: DataFrame, least: DataFrame) -> DataFrame:
    """The query terms with ``_needed``: whether a document without any other term can reach the bound."""
    rising = Window.partitionBy("query_id").orderBy("_reach", "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = weights.withColumn("_reach", F.col("_idf") * F.col("_most"))
    summed = reach.withColumn("_sum", F.sum("_reach").over(rising)).join(least, "query_id", "left")
    return summed.withColumn("_needed", F.col("_bound").isNull() | (F.col("_sum") >= F.col("_bound") - SLACK)).drop("_reach", "_sum")


def candidates(held: DataFrame, most: DataFrame, marked: DataFrame, by_group: bool) -> DataFrame:
    """query_id, doc_id and the sum over needed terms of the pairs that can reach their query's bound."""
    needed = marked.filter("_needed").drop("_needed", "_bound")
    met = _met(held, needed, by_group).groupBy("query_id", "doc_id", "block").agg(_sum().alias("_sum"))
    met = met.join(marked.groupBy("query_id").agg(F.first("_bound").alias("_bound")), "query_id")
    others = marked.filter("NOT _needed").select("query_id", "term", "_idf")
    reached = others.join(most, "term").groupBy("query_id", "block").agg(F.sum(F.col("_idf") * F.col("_most")).alias("_rest"))
    reaching = met.join(reached, ["query_id", "block"], "left")
    enough = F.col("_bound").isNull() | (F.col("_sum") + F.coalesce("_rest", F.lit(0.0)) >= F.col("_bound") - SLACK)
    return reaching.filter(enough).select("query_id", "doc_id", "_sum")


def _scores(held: DataFrame, most: DataFrame, weights: DataFrame, k: int, by_group: bool) -> DataFrame:
    marked = written(essential(weights, bounds(held, weights, k, by_group)), "marked")
    found = written(candidates(held, most, marked, by_group), "candidates")
    rest = _completed(found, held, marked.filter("NOT _needed"))
    every = found.unionByName(rest).groupBy("query_id", "doc_id").agg(F.sum("_sum").alias("_sum"))
    return every.select("query_id", "doc_id", F.round("_sum", SCORE_DIGITS).alias("score"))
