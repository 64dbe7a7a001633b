"""Hybrid search over a table of facts for a table of queries.

Rankings (lexical, dense, shared entities) each give the best ``k`` documents per query as
``query_id, doc_id, rank`` (from 1); fusion, type filter and rerank work on those short lists only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import terms
from tracewell.operators.lexical import SCORE_DIGITS, Best, Index, bm25_topk, dated, search, top_k, visible
from tracewell.schemas import EPISODE_TYPES, HYBRID_CANDIDATES
from tracewell.storage import written

RRF_CONSTANT = 60
# Rows per side of one block of the dense ranking: 4096 x 4096 scores are 128 MB.
BLOCK_ROWS = 4096
# What the vectors of a query table that goes to every task may take; rows that a task multiplies with it at once.
BROADCAST_BYTES = 32 << 20
SCAN_ROWS = 1024


def cosine_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    by_group: bool = False,
    block_rows: int = BLOCK_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Dense ranking of ``docs(doc_id, embedding)`` for ``queries(query_id, embedding)``.

    Queries are counted first. Where their vectors take at most ``broadcast_bytes`` they go to every task; a task scans its
    documents where they are and holds the best ``k`` per query, so no document is shuffled. A larger query table
    is cut into blocks of about ``block_rows`` like the documents (a hot group just has more blocks), and a task
    multiplies two blocks. No table of pairs ever exists, and both ways are exact.
    """
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).head()
    if n * max(width, 1) * 8 <= broadcast_bytes:
        return top_k(_scanned(docs, queries, k, by_group), k)
    if by_group:
        scoped = queries.filter(F.col("group_id").isNotNull())
        found = [_blocked(docs, scoped, ["group_id"], k, block_rows)]
        found.append(_blocked(docs, queries.filter(F.col("group_id").isNull()), [], k, block_rows))
        return top_k(found[0].unionByName(found[1]), k)
    return top_k(_blocked(docs, queries, [], k, block_rows), k)


def _scanned(docs: DataFrame, queries: DataFrame, k: int, by_group: bool) -> DataFrame:
    by_time = dated(docs, queries)
    group = ["group_id"] if by_group else []
    asked = queries.select("query_id", "embedding", *group, *(["as_of"] if by_time else [])).toPandas()  # counted
    schema = T.StructType([queries.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    every = np.arange(len(asked))
    unit = _unit(asked.embedding) if len(asked) else np.empty((0, 1))
    scopes = asked.group_id if by_group else pd.Series([None] * len(asked))
    free, scoped = every[scopes.isna()], {g: every[scopes == g] for g in scopes.dropna().unique()}

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(asked), k)
        for frame in frames:
            for at in range(0, len(frame), SCAN_ROWS):
                block = frame.iloc[at : at + SCAN_ROWS].sort_values("doc_id", ignore_index=True)
                matrix, ids = _unit(block.embedding), block.doc_id.to_numpy()
                parts = block.groupby("group_id", dropna=False).indices if scoped else {None: np.arange(len(block))}
                for name, rows in parts.items():
                    own = np.concatenate([free, scoped.get(name, every[:0])])
                    made = np.round(unit[own] @ matrix[rows].T, SCORE_DIGITS) + 0.0
                    if by_time:
                        as_of, valid = asked.as_of.to_numpy()[own][:, None], block.valid_at.to_numpy()[rows][None, :]
                        made = np.where(np.isnat(as_of) | (valid <= as_of), made, -np.inf)
                    best.add(own, made, ids[rows])
        yield from best.rows(asked.query_id.to_numpy())

    columns = ["doc_id", "embedding", *group, *(["valid_at"] if by_time else [])]
    return docs.select(*columns).mapInPandas(scan, schema)


def _blocked(docs: DataFrame, queries: DataFrame, group: list[str], k: int, block_rows: int) -> DataFrame:
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    def spread(df: DataFrame, identity: str, own: str, other: str) -> DataFrame:
        """Each row in its own block, once per block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64(identity), F.col(f"{own}s")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))
        )

    by_time = dated(docs, queries)
    # Fresh column ids: both sides may come from one table.
    queries = queries.select(*[F.col(c).alias(c) for c in [*group, "query_id", "embedding", *(["as_of"] if by_time else [])]])
    counts = [blocks(docs, "_ds"), blocks(queries, "_qs")]
    if group:
        both = counts[0].join(counts[1], group)
        left, right = docs.join(both, group), queries.join(both, group)
    else:
        # No group: one row of counts each, read as scalars.
        nd, nq = (F.greatest(c.scalar(), F.lit(1)) for c in counts)
        left, right = (df.withColumns({"_ds": nd, "_qs": nq}) for df in (docs, queries))
    key = [*group, "_d", "_q"]
    left = spread(left, "doc_id", "_d", "_q").select(*key, "doc_id", "embedding", *(["valid_at"] if by_time else []))
    right = spread(right, "query_id", "_q", "_d").select(*key, "query_id", "embedding", *(["as_of"] if by_time else []))
    fields = [queries.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_best_in_block(k), schema)


def _best_in_block(k: int):
    def best(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or queries.empty:
            return pd.DataFrame({"query_id": queries.query_id[:0], "doc_id": docs.doc_id[:0], "score": np.empty(0)})
        docs = docs.sort_values("doc_id", ignore_index=True)
        scores = np.round(_unit(queries.embedding) @ _unit(docs.embedding).T, SCORE_DIGITS)
        if "as_of" in queries.columns:
            as_of, valid = queries.as_of.to_numpy()[:, None], docs.valid_at.to_numpy()[None, :]
            scores = np.where(np.isnat(as_of) | (valid <= as_of), scores, -np.inf)
        # Stable, so equal scores stay in document order.
        chosen = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        width = chosen.shape[1]
        found = pd.DataFrame(
            {
                "query_id": np.repeat(queries.query_id.to_numpy(), width),
                "doc_id": docs.doc_id.to_numpy()[chosen.ravel()],
                "score": np.take_along_axis(scores, chosen, axis=1).ravel() + 0.0,
            }
        )
        return found[found.score > -np.inf]

    return best


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_list()).astype(np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def shared_entity_topk(query_entities: DataFrame, doc_entities: DataFrame, k: int) -> DataFrame:
    """Documents ranked by how many entities they share with the query.

    Documents with the same set of asked-for entities score the same for every query, so only the
    first ``k`` of each such set can appear in a result; the others never meet a query.
    """
    if dated(doc_entities, query_entities):
        # What a query may see differs, so a document of every set may count.
        held = doc_entities.select("doc_id", "entity", "valid_at").distinct()
        met = held.join(query_entities.select("query_id", "entity", "as_of").distinct(), "entity").filter(visible())
        return top_k(met.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("score")), k)
    asked = query_entities.select("query_id", "entity").distinct()
    relevant = doc_entities.select("doc_id", "entity").join(asked.select("entity").distinct(), "entity", "left_semi")
    sets = relevant.groupBy("doc_id").agg(F.sort_array(F.collect_set("entity")).alias("_set"))
    in_set = Window.partitionBy("_set").orderBy("doc_id")
    kept = sets.withColumn("_n", F.row_number().over(in_set)).filter(F.col("_n") <= k)
    shared = (
        kept.select("doc_id", F.explode("_set").alias("entity"))
        .join(asked, "entity")
        .groupBy("query_id", "doc_id")
        .agg(F.count(F.lit(1)).cast("double").alias("score"))
    )
    return top_k(shared, k)


def fuse_rankings(rankings: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (60 + rank) over the rankings that hold a document."""
    parts = rankings[0].select("query_id", "doc_id", "rank")
    for other in rankings[1:]:
        parts = parts.unionByName(other.select("query_id", "doc_id", "rank"))
    fused = parts.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (RRF_CONSTANT + F.col("rank"))), 9).alias("score")
    )
    return top_k(fused, k)


def known_types(wanted: list[str]) -> list[str]:
    """``wanted``, or an error for a name that would silently match nothing."""
    unknown = sorted(set(wanted) - set(EPISODE_TYPES))
    if unknown:
        raise ValueError(f"unknown episode types {unknown}; known are {sorted(EPISODE_TYPES)}")
    return wanted


def with_episode_type(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Add ``episode_type``: the type of the first source episode, by position, that is known."""
    sources = facts.select("fact_id", F.posexplode("episodes").alias("_pos", "episode_id"))
    kinds = episodes.filter(F.col("episode_type").isin(EPISODE_TYPES)).select("episode_id", "episode_type")
    resolved = (
        sources.join(kinds, "episode_id").groupBy("fact_id").agg(F.min_by("episode_type", "_pos").alias("episode_type"))
    )
    return facts.join(resolved, "fact_id", "left")


def term_overlap(query: Column, text: Column) -> Column:
    """The offline scorer: shared distinct terms over the geometric mean of both counts."""
    left, right = F.array_distinct(terms(query)), F.array_distinct(terms(text))
    both = F.sqrt((F.size(left) * F.size(right)).cast("double"))
    return F.coalesce(F.size(F.array_intersect(left, right)) / F.nullif(both, F.lit(0.0)), F.lit(0.0))


Scorer = Callable[[Column, Column], Column]


TEXTS = ["query_text", "content"]


def rerank(candidates: DataFrame, scorer: Scorer = term_overlap, k: int | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """Order candidates by ``scorer(query_text, content)``; ties keep the retrieval order.

    ``scorer`` maps two text columns to a score column, for instance a pandas UDF around a model. Scores are
    made where the texts are; the texts stay there, and only ids, scores and the other columns are sorted.
    """
    scored = candidates.withColumn("reranker_score", F.round(scorer(F.col("query_text"), F.col("content")), SCORE_DIGITS)).drop(*TEXTS)
    best = Window.partitionBy("query_id", *per).orderBy(F.desc("reranker_score"), F.asc("retrieval_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def hybrid_candidates(
    queries: DataFrame,
    facts: DataFrame,
    query_entities: DataFrame | None = None,
    fact_entities: DataFrame | None = None,
    limit: int = HYBRID_CANDIDATES,
    index: Index | None = None,
) -> DataFrame:
    """The best ``limit`` facts per query over the signals the inputs allow.

    Always lexical; dense if both sides have ``embedding``; shared entities if both entity tables
    are given. ``retrieval_rank`` counts from 0. A query with ``group_id`` sees its group only, and
    one with ``as_of`` only what was valid by then: later facts take no place in any ranking. (Their
    words still count in the corpus statistics of the lexical one.) With ``index`` the lexical ranking
    reads it instead of the facts; it holds the same ones or at least those of the queries' groups.
    """
    docs = facts.select(
        F.col("fact_id").alias("doc_id"),
        F.col("fact").alias("text"),
        "group_id",
        *[c for c in ("embedding", "valid_at") if c in facts.columns],
    )
    lexical = search(index, queries, limit, True) if index is not None else bm25_topk(docs, queries, limit, by_group=True)
    rankings = [lexical]
    if "embedding" in facts.columns and "embedding" in queries.columns:
        rankings.append(cosine_topk(docs, queries, limit, by_group=True))
    if query_entities is not None and fact_entities is not None:
        scoped_asks, scoped_docs = _scoped_entities(queries, facts, query_entities, fact_entities)
        rankings.append(shared_entity_topk(scoped_asks, scoped_docs, limit))
    fused = written(fuse_rankings(rankings, limit).select("query_id", "doc_id", "rank"), "fused")
    asked = queries.select("query_id", F.col("text").alias("query_text"), *(["as_of"] if "as_of" in queries.columns else []))
    found = (
        fused.select("query_id", F.col("doc_id").alias("fact_id"), (F.col("rank") - 1).alias("retrieval_rank"))
        .join(asked, "query_id")
        .join(facts, "fact_id")
        .withColumnRenamed("fact", "content")
    )
    return found


def _scoped_entities(queries, facts, query_entities, fact_entities):
    """Entities tagged with their group, so that a scoped query only meets facts of its group."""
    everywhere = F.lit("*")
    until, since = (["as_of"], ["valid_at"]) if dated(facts, queries) else ([], [])
    asks = query_entities.join(queries.select("query_id", "group_id", *until), "query_id")
    asks = asks.select("query_id", F.struct(F.coalesce("group_id", everywhere).alias("g"), "entity").alias("entity"), *until)
    held = fact_entities.join(facts.select("fact_id", "group_id", *since), "fact_id")
    scopes = F.explode(F.array(F.col("group_id"), everywhere)).alias("g")
    held = held.select(F.col("fact_id").alias("doc_id"), scopes, "entity", *since)
    return asks, held.select("doc_id", F.struct("g", "entity").alias("entity"), *since)


def search_history(
    queries: DataFrame,
    facts: DataFrame,
    episodes: DataFrame,
    k: int = 5,
    episode_types: list[str] | None = None,
    scorer: Scorer = term_overlap,
    **signals,
) -> DataFrame:
    """Prior memory for every query: candidates, then the type filter, then the rerank.

    The candidate cut comes before the type filter, so fewer than ``k`` may remain.
    """
    if episode_types is not None:
        known_types(episode_types)
    of, asked, signals = _once(queries, signals)
    found = _typed(hybrid_candidates(asked, facts, **signals), facts, episodes)
    if episode_types is not None:
        found = found.filter(F.col("episode_type").isin(episode_types))
    return _results(rerank(found, scorer, k), facts, of)


def _once(queries: DataFrame, signals: dict) -> tuple[DataFrame, DataFrame, dict]:
    """(query_id, asked_id), the queries of the asked ids, and the signals: queries alike in all that they ask are asked once."""
    what = [c for c in ("group_id", "text", "as_of", "embedding") if c in queries.columns]
    named, entities = queries, signals.get("query_entities")
    if entities is not None:
        sets = entities.groupBy("query_id").agg(F.sort_array(F.collect_set("entity")).alias("_entities"))
        named, what = queries.join(sets, "query_id", "left"), [*what, "_entities"]
    # A hash of all the columns, as JSON that keeps nulls.
    same = F.sha2(F.to_json(F.struct(*what), {"ignoreNullFields": "false"}), 256)
    named = written(named.select("query_id", same.alias("_same")), "same")
    first = named.groupBy("_same").agg(F.min("query_id").alias("asked_id"))
    of = written(named.join(first, "_same").select("query_id", "asked_id"), "asked")
    asked = of.filter(F.col("query_id") == F.col("asked_id")).select("query_id")
    queries = queries.join(asked, "query_id", "left_semi")
    if entities is not None:
        signals = {**signals, "query_entities": entities.join(asked, "query_id", "left_semi")}
    return of, queries, signals


def _typed(candidates: DataFrame, facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Candidates with the type of their fact; types are looked up for facts that are candidates only."""
    wanted = facts.select("fact_id", "episodes").join(candidates.select("fact_id").distinct(), "fact_id", "left_semi")
    return candidates.join(with_episode_type(wanted, episodes).select("fact_id", "episode_type"), "fact_id", "left")


TIERS = [(["pattern_occurrence", "intervention", "outcome"], 4), (["agent_alert"], 1)]


def two_tier_history(
    queries: DataFrame,
    facts: DataFrame,
    episodes: DataFrame,
    tiers: list[tuple[list[str], int]] | None = None,
    scorer: Scorer = term_overlap,
    **signals,
) -> DataFrame:
    """One search per tier, tiers in order. The candidates are the same, so they are found once."""
    of, asked, signals = _once(queries, signals)
    found = _typed(hybrid_candidates(asked, facts, **signals), facts, episodes)
    return _results(in_tiers(found, tiers or TIERS, scorer), facts, of, ["tier"])


def in_tiers(candidates: DataFrame, tiers: list[tuple[list[str], int]], scorer: Scorer = term_overlap) -> DataFrame:
    """The best candidates of each tier's types, at most the tier's count."""
    kind = F.col("episode_type")
    tier = F.coalesce(*[F.when(kind.isin(known_types(types)), i + 1) for i, (types, _) in enumerate(tiers)])
    limit = F.coalesce(*[F.when(F.col("tier") == i + 1, n) for i, (_, n) in enumerate(tiers)])
    ranked = rerank(candidates.withColumn("tier", tier).filter(F.col("tier").isNotNull()), scorer, None, ("tier",))
    return ranked.filter((F.col("rank") <= limit) & (F.col("rank") <= max(n for _, n in tiers)))


def _results(ranked: DataFrame, facts: DataFrame, of: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The results of every query, from those of the asked ones; texts are read for these alone."""
    texts = facts.select("fact_id", F.col("fact").alias("content"))
    found = ranked.withColumnRenamed("query_id", "asked_id").join(texts, "fact_id").join(of, "asked_id")
    return found.select(
        "query_id",
        *(extra or []),
        "rank",
        "content",
        F.coalesce(F.nullif("name", F.lit("")), F.lit("fact")).alias("name"),
        F.col("valid_at").alias("occurred_at"),
        "reranker_score",
        "retrieval_rank",
        "episode_type",
        F.struct(F.col("fact_id").alias("edge_uuid"), F.col("episodes").alias("source_episode_uuids")).alias("metadata"),
    )


def attach_history(matches: DataFrame, results: DataFrame, query_id: str = "match_id") -> DataFrame:
    """Add ``retrieved_episodes``, the results of each match in tier and rank order."""
    item = F.struct(
        "tier", "rank", "name", "content", "episode_type", "occurred_at", "reranker_score", "retrieval_rank", "metadata"
    )
    held = results.groupBy(F.col("query_id").alias(query_id)).agg(F.sort_array(F.collect_list(item)).alias("_h"))
    joined = matches.join(held, query_id, "left")
    names = ["name", "content", "episode_type", "occurred_at", "reranker_score", "retrieval_rank", "metadata"]
    listed = F.transform("_h", lambda e: F.struct(*[e[n].alias(n) for n in names]))
    none = F.array().cast(joined.select(listed.alias("x")).schema["x"].dataType)
    return joined.withColumn("retrieved_episodes", F.coalesce(listed, none)).drop("_h")
