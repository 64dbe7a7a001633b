"""Byte-level BPE: exact encoding by a rank file, and decoding.

Pieces come from the scan in ``pretokens``; each distinct piece is merged once per worker and cached as
its ids. The cache is emptied when it holds ``CACHED`` pieces, and texts go through in slabs of about
``SLAB`` code points, so the memory of a worker has a bound that does not grow with the input. A longer
text is cut where a piece begins in any context: at a space before something that is not white space.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import pretokens
from tracewell.llm.common import documents, query, texts_mapped

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED = 400_000
SLAB = 1 << 19
_SHORT = 48  # bytes up to which a plain scan for the next merge is quicker than a heap


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)  # the leftmost of equal ones
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a heap of candidate merges over a linked list of parts."""
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of the two parts has been merged since
        end[i], end[j], right[i] = stop, 0, right[j]
        if right[j] < n:
            left[right[j]] = i
        for a in (left[i], i):
            if a >= 0 and (b := right[a]) < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


def slabs(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (number of the text, code points before, part of it), each list of about ``SLAB`` code points."""
    slab, room = [], SLAB
    for number, text in enumerate(texts):
        at = 0
        while len(text) - at > SLAB:
            cut = text.find(" ", at + SLAB // 2)
            while cut >= 0 and (cut + 1 == len(text) or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield [(number, at, text[at:cut])]
            at = cut
        part = text[at:] if at else text
        slab.append((number, at, part))
        room -= len(part)
        if room <= 0:
            yield slab
            slab, room = [], SLAB
    if slab:
        yield slab


class Vocabulary:
    """The ranks of one file, and what has been merged with them so far."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        if (whole_piece := self.ranks.get(piece)) is not None:
            return [whole_piece]
        return (_merged_short if len(piece) <= _SHORT else _merged_long)(piece, self.ranks)

    def lookup(self, pieces: list[str]) -> dict[str, bytes]:
        """A mapping that holds the ids (little-endian, 32 bits) of all these pieces."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        cached = self.cache
        for piece in set(pieces).difference(cached):
            cached[piece] = np.array(self.merge(piece.encode()), "<u4").tobytes()
        return cached

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids as little-endian 32-bit numbers, and the code points where its pieces begin."""
        ids: list[list[bytes]] = [[] for _ in texts]
        begins: list[list[np.ndarray]] = [[] for _ in texts]
        for slab in slabs(texts):
            joined = "".join(part for _, _, part in slab)
            first, last, owner = pretokens.starts([part for _, _, part in slab])
            pieces = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
            found = list(map(self.lookup(pieces).__getitem__, pieces))
            bounds = np.searchsorted(owner, np.arange(len(slab) + 1)).tolist()
            base = 0
            for k, (number, offset, part) in enumerate(slab):
                a, b = bounds[k], bounds[k + 1]
                ids[number].append(b"".join(found[a:b]))
                begins[number].append(first[a:b] - base + offset)
                base += len(part)
        none = np.empty(0, np.int64)
        return [(b"".join(i), np.concatenate(s) if s else none) for i, s in zip(ids, begins)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


IDS, BEGINS = ("binary", pa.binary()), ("array<int>", pa.list_(pa.int32()))


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit numbers), begins (code points where pieces begin) and n_tokens."""

    def make(texts: list[str]) -> list:
        pairs = vocabulary(path).encode(texts)
        return [[i for i, _ in pairs], [s for _, s in pairs], [len(i) // 4 for i, _ in pairs]]

    return texts_mapped(docs, text, {"ids": IDS, "begins": BEGINS, "n_tokens": ("long", pa.int64())}, make)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that the ids stand for; null stays null."""

    @F.pandas_udf("binary")
    def of(batch: pd.Series) -> pd.Series:
        decode = vocabulary(path).decode
        return pd.Series([None if i is None else decode(np.frombuffer(i, "<u4")) for i in batch], dtype=object)

    return of(ids)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """As ``encoded``, with decoded (binary) made from the ids in the same pass.

    Null and empty texts have no ids and decode to no bytes. Every row is its own: repeated rows and null
    keys need no care, and an empty table gives no rows. Existing columns of the four names are replaced.
    """

    def make(texts: list[str]) -> list:
        known = vocabulary(path)
        pairs = known.encode(texts)
        ids = [i for i, _ in pairs]
        return [ids, [s for _, s in pairs], [len(i) // 4 for i in ids], [known.decode(np.frombuffer(i, "<u4")) for i in ids]]

    added = {"ids": IDS, "begins": BEGINS, "n_tokens": ("long", pa.int64()), "decoded": ("binary", pa.binary())}
    return texts_mapped(docs, text, added, make)


@query()
def op6_byte_bpe(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = round_trip(docs, public_tokenizers.path(RANKS))
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
