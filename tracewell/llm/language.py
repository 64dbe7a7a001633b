"""Language identification by prediction with partial matching.

For each language a tree of byte contexts of up to four bytes holds how often each byte followed. The code
length of a byte is the one its longest known context gives it; where a context has not seen the byte, its
escape probability is paid and the next shorter context is asked, down to a uniform byte (escape method C,
without exclusion). A text's language is the one whose frozen counts give the shortest code for all of it.

All languages share one table per context length: the grams that any of them has seen, with each
language's finished code length. So a byte costs one look-up for all languages, and only bytes that no
language has seen after that context look further.

The counts are a classifier fitted to a bounded sample of labelled rows: ``SAMPLE`` expected rows per
language, chosen by a hash of doc_id among those of at most ``LONGEST`` code points (all, if it has none of these), whole texts. Counting
runs on Spark; the tree, bounded by the sample, is broadcast. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import documents, query, texts_mapped

DEPTH = 4
SAMPLE = 400
LONGEST = 20_000
_PAD = b"\n" * DEPTH
_BLOCK = 1 << 18  # bytes looked up at once
UNKNOWN = "und"


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte after the first DEPTH with the DEPTH before it, packed into a number, the byte itself lowest."""
    n = len(data) - DEPTH
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(DEPTH + 1):
        out = out << np.uint64(8) | data[k : k + n].astype(np.uint64)
    return out


class Index:
    """Places of sorted distinct keys, by hashed buckets."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        hashed = self._hash(keys)
        self.order = np.argsort(hashed, kind="stable")
        self.keys = np.append(keys[self.order], np.uint64(2**64 - 1))
        self.first = np.searchsorted(hashed[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(keys) else 0

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each key in ``keys`` as stored here, -1 if it is not there."""
        at = self.first[self._hash(wanted)]
        found = self.keys[at] == wanted
        out = np.where(found, at, -1)
        left = np.flatnonzero(~found)
        for step in range(1, self.longest):
            place = np.minimum(at[left] + step, len(self.keys) - 1)
            hit = self.keys[place] == wanted[left]
            out[left[hit]] = place[hit]
            left = left[~hit]
        return out


@dataclass
class Model:
    """``codes[k]``: bits of each gram with k bytes of context; ``escapes[k]``: bits of leaving each context."""

    languages: list[str]
    grams: list[Index]
    codes: list[np.ndarray]
    contexts: list[Index]
    escapes: list[np.ndarray]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        joined = np.frombuffer(b"".join(x for t in texts for x in (_PAD, t)), np.uint8)
        lengths = np.array([len(t) + DEPTH for t in texts], np.int64)
        owner_end = np.cumsum(lengths)
        for at in range(DEPTH, len(joined), _BLOCK):
            block = joined[at - DEPTH : at + _BLOCK]
            wanted = grams(block)
            owner = np.searchsorted(owner_end, np.arange(at, at + len(wanted)), side="right")
            inside = np.arange(at, at + len(wanted)) >= (owner_end - lengths)[owner] + DEPTH  # padding costs nothing
            wanted, owner = wanted[inside], owner[inside]
            for k in range(DEPTH, -1, -1):
                mask = np.uint64((1 << 8 * (k + 1)) - 1)
                row = self.grams[k].find(wanted & mask)
                hit = row >= 0
                self._add(out, owner[hit], self.codes[k][row[hit]])
                wanted, owner = wanted[~hit], owner[~hit]
                context = self.contexts[k].find((wanted & mask) >> np.uint64(8))
                known = context >= 0
                self._add(out, owner[known], self.escapes[k][context[known]])
            np.add.at(out, owner, 8.0)
        return out

    @staticmethod
    def _add(out: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
        if len(owner):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[starts]] += np.add.reduceat(values, starts, axis=0, dtype=np.float64)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the likelihood; ``und`` and 0 without letters or languages."""
        letters = [any(map(str.isalpha, t)) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        bits = self.bits([t.encode() if some else b"" for t, some in zip(texts, letters)])
        best = bits.argmin(axis=1)  # the first of equal ones, in the order of names
        share = 1 / np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0)).sum(axis=1)
        names = [self.languages[b] if some else UNKNOWN for b, some in zip(best, letters)]
        return names, [float(s) if some else 0.0 for s, some in zip(share, letters)]


def freeze(languages: list[str], keys: list[np.ndarray], counts: list[np.ndarray]) -> Model:
    """The model of each language's distinct grams (with DEPTH bytes of context) and their counts."""
    model = Model(languages, [], [], [], [])
    below = np.full((1, len(languages)), 8.0)
    below_index, below_keys = None, None
    for k in range(DEPTH + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        seen = []
        for key, count in zip(keys, counts):
            gram, inverse = np.unique(key & mask, return_inverse=True)
            seen.append((gram, np.bincount(inverse, weights=count, minlength=len(gram))))
        union = np.unique(np.concatenate([g for g, _ in seen]))
        contexts = np.unique(union >> np.uint64(8))
        codes, escapes = np.zeros((len(union), len(languages))), np.zeros((len(contexts), len(languages)))
        context_of = np.searchsorted(contexts, union >> np.uint64(8))
        for column, (gram, count) in enumerate(seen):
            at = np.searchsorted(contexts, gram >> np.uint64(8))
            total = np.bincount(at, weights=count, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            used = kinds > 0
            escapes[used, column] = np.log2((total[used] + kinds[used]) / kinds[used])
            shorter = below[0 if below_index is None else below_index.find(union & (mask >> np.uint64(8))), column]
            codes[:, column] = escapes[context_of, column] + shorter
            codes[np.searchsorted(union, gram), column] = np.log2((total + kinds)[at] / count)
        index, context_index = Index(union), Index(contexts)
        model.grams.append(index)
        model.contexts.append(context_index)
        below, below_index = codes[index.order].astype(np.float32), index
        model.codes.append(below)
        model.escapes.append(escapes[context_index.order].astype(np.float32))
    return model


def sampled(docs: DataFrame, allowed: Column) -> DataFrame:
    """(lang, text) of about SAMPLE rows per language, whole texts."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    short = F.length("text") <= LONGEST
    rows = rows.filter(allowed).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("short"), F.count("*").alias("n")).collect()
    # A language without a shorter text is learned from its longer ones.
    only_long = [r.lang for r in counts if not r.short]
    rows = rows.filter(short | F.col("lang").isin(only_long)) if only_long else rows.filter(short)
    sizes = {r.lang: r.short or r.n for r in counts}
    if not sizes:
        return rows.select("lang", "text")
    cells = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(cells, int(cells * SAMPLE / n) + 1))])
    cell = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(cells))
    return rows.filter(cell < F.element_at(share, F.col("lang"))).select("lang", "text")


def train(docs: DataFrame, allowed: Column) -> Model:
    """The frozen counts of labelled rows that meet ``allowed``; without any, a model that knows no language."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                pieces = [grams(np.frombuffer(_PAD + t.encode(), np.uint8)) for t in rows["text"]]
                key, count = np.unique(np.concatenate(pieces), return_counts=True)
                yield pd.DataFrame({"lang": pd.Series([lang] * len(key), dtype=object), "gram": key.view(np.int64), "n": count})

    found = sampled(docs, allowed).mapInPandas(counted, "lang string, gram long, n long")
    frame = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(frame["lang"].unique())
    if not languages:
        return Model([], [], [], [], [])
    parts = [frame[frame["lang"] == lang] for lang in languages]
    return freeze(languages, [p["gram"].to_numpy().view(np.uint64) for p in parts], [p["n"].to_numpy(np.float64) for p in parts])


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). Null texts and texts without a letter are ``und`` with score 0.

    Rows are independent; no rows give no rows. Existing columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())}
    return texts_mapped(docs, text, added, lambda texts: list(shared.value.predict(texts)))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@query()
def op7_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    made = identified(docs.select("doc_id", "text"), train(docs, ~held_out()))
    return made.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
