"""Token counts of whole texts as the tokenizer library gives them, for a byte-level BPE file.

Special strings are cut out first and count one each, as the library does by default. Pieces come from the
transition scan of ``pretokens``; the library itself encodes each distinct piece once per worker, and a
bounded cache keeps the numbers.

A text of more than ``HUGE`` code points is never encoded at once. Overlapping chunks are, each with the
offsets of its pieces, and neighbours are spliced at a common boundary that is proven stable: both chunks
begin a piece there, and it is white space before something else outside special strings, which begins a
piece whatever stands to its left. If an overlap has no such place, it is widened, twice as far each time,
until one is found or the chunk reaches the end of the text.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import pretokens
from tracewell.llm.common import documents, query, texts_mapped, whole

FILE = "byte_bpe_50k.json"
HUGE = 1 << 16
CHUNK = 1 << 15
OVERLAP = 256
CACHED = 400_000
LIMIT = 512


class Counter:
    """Counts with one tokenizer file."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.cache: dict[str, int] = {}
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.widened = 0  # how often an overlap was too narrow

    def _of_pieces(self, pieces: list[str]) -> np.ndarray:
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = list(set(pieces).difference(self.cache))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for piece, made in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[piece] = len(made)
        return np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, number of tokens and text of each piece, special strings among them."""
        segments, owners, offsets, extra = [], [], [], []
        base = 0
        for number, text in enumerate(texts):
            at = 0
            for m in self.special.finditer(text):
                segments.append(text[at : m.start()])
                owners.append(number)
                offsets.append(base + at)
                extra.append((base + m.start(), number))
                at = m.end()
            segments.append(text[at:])
            owners.append(number)
            offsets.append(base + at)
            base += len(text)
        joined = "".join(segments)
        first, last, owner = pretokens.starts(segments)
        tokens = self._of_pieces([joined[a:b] for a, b in zip(first.tolist(), last.tolist())])
        lengths = np.array([len(s) for s in segments])
        begin = first - (np.cumsum(lengths) - lengths)[owner] + np.array(offsets)[owner]
        text_of = np.array(owners)[owner]
        if extra:
            begin = np.append(begin, [p for p, _ in extra])
            tokens = np.append(tokens, np.ones(len(extra), np.int64))
            text_of = np.append(text_of, [n for _, n in extra])
        return begin, tokens, text_of

    def _stable(self, text: str, start: int, stop: int) -> np.ndarray:
        """The places in [start, stop) where a piece begins in any context."""
        part = np.frombuffer(text[start : stop + 1].encode("utf-32-le"), "<u4")
        space = pretokens.table()[part] == pretokens.SPACE_RUN
        places = np.flatnonzero(space[:-1] & ~space[1:]) + start
        spans = [(m.start(), m.end()) for m in self.special.finditer(text, max(0, start - 4096), min(len(text), stop + 4096))]
        for a, b in spans:
            places = places[(places + 1 < a) | (places >= b)]
        return places

    def huge_count(self, text: str) -> int:
        total, start, begun = 0, 0, 0  # the chunk's start, and from where its pieces count
        while True:
            overlap = self.overlap
            while True:
                stop = min(len(text), start + self.chunk + overlap)
                begin, tokens, _ = self._pieces([text[start:stop]])
                begin = begin + start
                if stop == len(text):
                    return total + int(tokens[begin >= begun].sum())
                following = start + self.chunk
                after, _, _ = self._pieces([text[following : stop + self.chunk]])
                # Not the last code point of the overlap: what follows it must be there for the left chunk too.
                common = np.intersect1d(np.intersect1d(begin, after + following), self._stable(text, following, stop - 1))
                common = common[common > begun]
                if len(common):
                    break
                overlap *= 2
                self.widened += 1
            splice = int(common[0])
            total += int(tokens[(begin >= begun) & (begin < splice)].sum())
            start, begun = following, splice

    def counts(self, texts: list[str]) -> list[int]:
        small = [t if len(t) <= self.huge else "" for t in texts]
        _, tokens, owner = self._pieces(small)
        sums = np.bincount(owner, weights=tokens, minlength=len(texts)).astype(np.int64).tolist()
        return [n if len(t) <= self.huge else self.huge_count(t) for n, t in zip(sums, texts)]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def counted(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens of each whole text; null and empty texts have none.

    Rows are independent: repeated rows and null keys need no care, and no rows give no rows. An existing
    column n_tokens is replaced.
    """
    return texts_mapped(docs, text, {"n_tokens": ("long", pa.int64())}, lambda texts: [counter(path).counts(texts)])


@query()
def op10_token_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = counted(docs, public_tokenizers.path(FILE))
    return made.select(
        "doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit")
    )
