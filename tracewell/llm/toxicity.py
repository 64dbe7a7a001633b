"""Toxicity by weak supervision.

Voters look for words, word beginnings and patterns; each fires or does not. The lexicon part is mined
from the labelled training rows: words and beginnings of words that toxic rows have far more often. A
generative model with the true label hidden explains the votes and the given label (one more voter, which
may err): expectation maximisation finds how often each voter fires on either side, and voters that
still fire together within a side count for less, by their correlation. Its posterior labels then train
a logistic regression on what fired and how densely, and that alone scores texts.

The fit uses a bounded sample of labelled rows: ``SAMPLE`` expected rows, chosen by a hash of doc_id, whole
texts. Counting words over it runs on Spark; only the votes of the sample and at most ``VOTERS`` lexicon
entries reach the driver. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import documents, query, table, whole, written

SAMPLE = 12_000
VOTERS = 240
REJECT = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (5, 6, 7, 8)
_LEAST_DOCS = 4  # toxic rows that a lexicon entry must occur in
_ROUNDS = 40
#: Insults of general use, one voter for all; a corpus without labels for them still gets a vote.
SEED_WORDS = frozenset("idiot moron imbecile bastard bitch scum asshole arschloch idiota imbécil salaud connard".split())
_MEMO = 200_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def entries(word: str) -> Iterator[str]:
    """The word and its beginnings (with a star) as lexicon entries."""
    yield word
    for k in _PREFIXES:
        if len(word) >= k:
            yield word[:k] + "*"


def _patterns(text: str, tokens: list[str]) -> list[bool]:
    n = max(1, len(text))
    return [
        not SEED_WORDS.isdisjoint(tokens),
        text == text.upper() != text.lower(),
        text.count("!") / n > 0.02,
    ]


N_PATTERNS = 3
N_DENSE = 3


@dataclass
class Model:
    lexicon: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_PATTERNS + N_DENSE))
    bias: float = -30.0
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def fired(self, word: str) -> tuple[int, ...]:
        if (got := self.memo.get(word)) is None:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            place = self.memo.setdefault("", {e: i for i, e in enumerate(self.lexicon)})
            got = self.memo[word] = tuple(place[e] for e in entries(word) if e in place)
        return got

    def features(self, texts: list[str]) -> np.ndarray:
        """Votes of the lexicon and of the patterns, then how densely the lexicon fires."""
        n_lexicon = len(self.lexicon)
        out = np.zeros((len(texts), n_lexicon + N_PATTERNS + N_DENSE), np.float32)
        for row, text in zip(out, texts):
            tokens = words(text)
            counts, hits, kinds = Counter(tokens), 0, 0
            for word, n in counts.items():
                if at := self.fired(word):
                    row[list(at)] = 1
                    hits += n
                    kinds += 1
            row[n_lexicon : n_lexicon + N_PATTERNS] = _patterns(text, tokens)
            row[n_lexicon + N_PATTERNS :] = (min(kinds, 4) / 4, min(1.0, 50 * hits / max(1, len(tokens))), hits > 0)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.features(texts) @ self.weights + self.bias if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def posterior(votes: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The probability of the hidden label of each row, from votes (0 or 1) and the given labels."""
    q = np.where(given > 0, 0.95, 0.05)
    for _ in range(_ROUNDS):
        on, off = q.sum(), (1 - q).sum()
        base = np.clip(on / len(q), 1e-4, 1 - 1e-4)
        hit = (votes.T @ q + 0.5) / (on + 1)
        noise = (votes.T @ (1 - q) + 0.5 * votes.mean(axis=0)) / (off + 1)
        noise = np.clip(noise, 1e-5, 1 - 1e-5)
        right = np.clip((given @ q + 8) / (on + 10), 0.7, 0.995)
        wrong = np.clip((given @ (1 - q) + 0.2) / (off + 10), 0.002, 0.3)
        # What voters still share within each side, weighted: that part of a vote is not new evidence.
        share = _shared(votes, q, hit) * base + _shared(votes, 1 - q, noise) * (1 - base)
        weight = 1 / (1 + share)
        llr = votes @ (weight * np.log(hit / noise)) + (1 - votes) @ (weight * np.log((1 - hit) / (1 - noise)))
        llr += np.where(given > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        new = 1 / (1 + np.exp(-np.clip(llr + np.log(base / (1 - base)), -40, 40)))
        if np.abs(new - q).max() < 1e-4:
            return new
        q = new
    return q


def _shared(votes: np.ndarray, q: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """For each voter the sum of its positive correlations with the others on the rows weighted by ``q``."""
    centred = (votes - rate) * np.sqrt(q)[:, None]
    cov = centred.T @ centred / max(q.sum(), 1e-9)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.clip(cov / np.outer(scale, scale), 0, 1)
    return corr.sum(axis=1) - np.diag(corr)


def logistic(x: np.ndarray, soft: np.ndarray, ridge: float = 0.15) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on probabilities as labels, by Newton steps."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w, cost = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    cost[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = np.maximum(p * (1 - p), 1e-5)
        step = np.linalg.solve((x.T * curve) @ x + np.diag(cost), x.T @ (soft - p) - cost * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """(text, toxic): about SAMPLE labelled rows; labels that disagree about a doc_id count as their mean."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic").filter(allowed)
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("toxic"))
    n = known.count()
    if n > SAMPLE:
        cells = 1 << 20
        known = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(cells)) < int(cells * SAMPLE / n))
    # SAMPLE bounds the rows that are broadcast.
    return docs.select("doc_id", whole().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def mined(rows: DataFrame, n_toxic: float, n_clean: float) -> list[str]:
    """Lexicon entries that tell toxic rows from others, at most VOTERS; a longer entry only if it adds something."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                sums[int(toxic)].update({e for w in set(words(text)) for e in entries(w)})
        keys = list(sums[0].keys() | sums[1].keys())
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pd.DataFrame(
                {
                    "entry": pd.Series(some, dtype=object),
                    "clean": [sums[0][k] for k in some],
                    "toxic": [sums[1][k] for k in some],
                }
            )

    counts = rows.mapInPandas(counted, "entry string, clean long, toxic long")
    counts = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    gain = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    strong = counts.filter((F.col("toxic") >= _LEAST_DOCS) & (gain > 2)).withColumn("worth", F.col("toxic") * gain)
    best = strong.orderBy(F.desc("worth"), "entry").limit(8 * VOTERS).collect()
    chosen: dict[str, tuple[int, int]] = {}
    for r in best:
        stem = r.entry.rstrip("*")
        shorter = [chosen[s] for k in _PREFIXES if k <= len(stem) and (s := stem[:k] + "*") != r.entry and s in chosen]
        # A longer entry is worth a place only where its shorter form also fires on clean rows.
        if all(clean > 0 and r.clean == 0 for _, clean in shorter) and len(chosen) < VOTERS:
            chosen[r.entry] = (r.toxic, r.clean)
    return list(chosen)


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """The model fitted to labelled rows whose doc_id meets ``allowed``; one that scores 0 if there are none."""
    rows = written(training_rows(docs, labels, allowed), "labelled")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).head()
    if not n:
        return Model()
    model = Model(mined(rows, n_toxic, n - n_toxic))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = model.features(batch["text"].tolist())
            yield pd.DataFrame({"f": list(made), "toxic": batch["toxic"]})

    frame = rows.mapInPandas(votes, "f array<float>, toxic double").toPandas()
    x = np.stack(frame["f"]).astype(np.float64)
    order = np.lexsort([*x.T[::-1], frame["toxic"]])  # the same sums whatever order the rows came in
    x, given = x[order], frame["toxic"].to_numpy()[order]
    model.weights, model.bias = logistic(x, posterior(x[:, :-N_DENSE], given))
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each text; null and empty texts get the score of no votes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    return docs.withColumn(name, score(whole()))


def in_fold(fold: int, n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n == fold


@query()
def op9_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~in_fold(1, 3))
    found = scored(docs, model)
    held_out = F.coalesce(in_fold(1, 3), F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
