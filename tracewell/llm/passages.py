"""Repeated passages: paragraph MinHash with banding, and shared passages inside other paragraphs.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; shingles have five words. Two kinds of units are taken
from each whole text:

* paragraphs, the lines of at least ``LEAST_WORDS`` words. MinHash bands, tuned for recall, make candidates,
  the exact Jaccard similarity of shingle sets verifies them (``SIMILAR`` or more), components are classes.
* passages that stand inside different paragraphs, where no paragraph is alike. Blocks of ``BLOCK`` words are the
  seeds: one begins at the least shingle hash of each window of ``REACH`` places, so wherever two texts share
  BLOCK + REACH words (51) or more, they have a block in common within REACH places of each place. A seed knows the
  words up to REACH places before and after it by hashes. Places of a seed with the same words there are one class;
  only the first place of each class is compared with the others word by word, as far as they agree. Pieces that
  follow each other in a text and in the kept one are one span, so the spans cover every word of a shared passage.

Equal units are one node before anything is compared, paragraphs by 64 bits of a hash of their words, pieces of
passages by 128. A bucket of a band does not make all its pairs: each member is verified with the bucket's leader,
and the members that are then of another class than the leader with the whole bucket, block by block inside
tasks. Pairs inside a class need no check, so no class is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import SLICE, documents, query, whole, written
from tracewell.llm.components import components
from tracewell.llm.fuse import mix
from tracewell.llm.verify import SHINGLE, SIMILAR, similar_pairs
from tracewell.llm.words import LOWER, shingle_hashes, single_spaced

LEAST_WORDS = 20
BLOCK, REACH = 16, 35
RECALL = 0.99
HASHES = 48
CROWD, CROWD_BYTES = 1024, 8 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
MANY = 1 << 14  # first places of one seed that one task compares
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_VALUES = mix(np.arange(256, dtype=np.uint64), 3)  # of each byte
_SPACED = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else b for b in LOWER)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UNITS = """doc_id long, text_hash long, kind string, word int, start int, stop int, n_words int, u1 long,
    bands array<long>, before long, after long, block_stop int, before_start int"""
_UNIT_NAMES = [c.split()[0] for c in _UNITS.split(",")]
_UNIT_TYPES = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_CONTEXTS = "u1 long, right boolean, doc_id long, text_hash long, word int, at int, crowded boolean, body string"
_PIECE = "doc_id long, text_hash long, word int, n_words int, start int, stop int"
_PIECES = f"{_PIECE}, keep_doc_id long, keep_hash long, keep_word int, keep_start int, keep_stop int"
_PIECE_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]


def tuned(similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows of a band): the most selective banding of at most so many hashes that finds a pair of the
    given similarity with the given probability."""
    for rows in range(hashes, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similar**rows))) if similar < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hashes for that recall")


BANDS, ROWS = tuned()


def signatures(hashes: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The band keys (one row per unit) of units whose shingle hashes follow each other, from ``starts`` on."""
    out = np.empty((len(starts), bands), np.uint64)
    # Some units at a time, so that their hashes stay in the processor's cache.
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(hashes), 1 << 14)), len(starts)))
    for a, b in zip(cuts, cuts[1:]):
        part = hashes[starts[a] : starts[b] if b < len(starts) else None]
        for band in range(bands):
            key = np.full(b - a, band + 1, np.uint64)
            for row in range(rows):
                least = np.minimum.reduceat(mix(part, 1000 + band * rows + row), starts[a:b] - starts[a])
                key = mix(key ^ least, 7)
            out[a:b, band] = key
    return out


class _Joined:
    """Some texts as one, with a line feed after each; places are those of the whole."""

    def __init__(self, texts: list[str]):
        parts = [text.encode() for text in texts]
        self.raw = b"\n".join([*parts, b""])
        self.data = np.frombuffer(self.raw, np.uint8)
        #: First and last byte (end exclusive) of each word.
        self.first, self.last = _edges(self.data)
        begin = np.cumsum([0, *[len(part) + 1 for part in parts]])
        #: The first word of each text, and the number of words at the end.
        self.words = np.searchsorted(self.first, begin)
        new = (self.data & 0xC0) != 0x80
        #: The code point of each byte, and the first of each text.
        self.point = np.cumsum(new) - new
        self.origin = self.point[begin[:-1]] if len(parts) else begin[:0]


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (end exclusive) of each word."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def run_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``size`` words by their bytes ``starts`` to ``ends``; none for the last ones, which have too few after them.

    A word is a sum of its bytes' values times powers of an odd number, mixed; a run is a weighted sum of words, mixed.
    """
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        # Some words at a time, so that what they need stays in the processor's cache.
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(body), 1 << 16)), len(starts)))
        for a, b in zip(cuts, cuts[1:]):
            base = starts[a]
            first, last = starts[a:b] - base, ends[a:b] - base
            up = np.cumprod(np.full(last[-1], _ODD))
            sums = np.append(np.uint64(0), np.cumsum(_VALUES[body[base : ends[b - 1]]] * up))
            down = np.cumprod(np.full(first[-1] + 1, _INVERSE))
            out[a:b] = (sums[last] - sums[first]) * down[first]
        out = mix(out, 5)
        n = max(0, len(out) - size + 1)
        runs = out[:n].copy()
        for place in range(1, size):
            runs = runs * _ODD + out[place : place + n]
    return mix(runs, 6)


def block_starts(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words at which the blocks of texts begin; a text has ``counts`` words (BLOCK or more) from ``firsts`` on.

    A block begins at the first least hash of each window of REACH places; a text of fewer places is one window.
    """
    places = counts - BLOCK + 1
    single = [f + hashes[f : f + n].argmin() for f, n in zip(firsts.tolist(), places.tolist()) if n < REACH]
    # The place of the least hash of 2, 4 ... 32 places from each on, then of REACH; the earlier one of equals.
    least, values, reach = np.arange(len(hashes)), hashes, 1
    while reach < REACH:
        step = min(reach, REACH - reach)
        later = values[step:] < values[:-step]
        least = np.where(later, least[step:], least[:-step])
        values = np.where(later, values[step:], values[:-step])
        reach += step
    # Windows that cross the end of a text are left out.
    text = np.searchsorted(firsts, np.arange(len(least)), "right") - 1
    inside = (text >= 0) & (np.arange(len(least)) + REACH <= (firsts + places)[text])
    return np.unique(np.append(least[inside], np.array(single, np.int64)))


def units(docs: DataFrame) -> DataFrame:
    """The paragraphs and blocks of each text of ``keyed`` documents.

    Paragraphs have band keys. A block has hashes of the words up to REACH places before and after it, itself
    included; ``n_words`` and ``stop`` are those of the block with the words after it.
    """

    def batch(kind: str, own: list[tuple[int, int, int]], columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        """``own``: doc_id, text_hash and number of rows of each text."""
        at = pa.array(np.repeat(np.arange(len(own)), [n for _, _, n in own]))
        made = {"doc_id": pa.array([d for d, _, _ in own], pa.int64()).take(at), "text_hash": pa.array([t for _, t, _ in own], pa.int64()).take(at)}
        made["kind"] = pa.repeat(pa.scalar(kind), len(at))
        arrays = []
        for name, to in zip(_UNIT_NAMES, _UNIT_TYPES):
            if name in made:
                arrays.append(made[name])
            elif name in columns:
                arrays.append(pa.array(columns[name], to))
            else:
                arrays.append(pa.nulls(len(at), to))
        if kind == "paragraph":
            hashes, sizes = columns["hashes"], columns["sizes"]
            keys = signatures(hashes, np.cumsum(np.append(0, sizes[:-1]))).view(np.int64)
            arrays[_UNIT_NAMES.index("bands")] = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, keys.ravel())
        return pa.RecordBatch.from_arrays(arrays, names=_UNIT_NAMES)

    def of(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        wide, short = xxhash.xxh3_128_intdigest, xxhash.xxh3_64_digest
        all_ = _Joined([text for _, text, _ in some])
        data, first, last, point = all_.data, all_.first, all_.last, all_.point
        enough = np.flatnonzero(np.diff(all_.words) >= BLOCK)
        if not len(enough):
            return
        counts, firsts = np.diff(all_.words)[enough], all_.words[enough]
        line = np.searchsorted(np.flatnonzero(data == 0x0A), first)
        # The lower-cased words with one space after each.
        kept = ~_SPACE[data]
        kept[last] = True
        body = np.frombuffer(all_.raw.translate(_SPACED), np.uint8)[kept]
        ends = np.cumsum(last - first + 1) - 1
        starts = ends - (last - first)
        hashes = run_hashes(body, starts, ends)
        body = body.tobytes()

        def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            digests = [short(body[x:y]) for x, y in zip(starts[a].tolist(), ends[b - 1].tolist())]
            return np.frombuffer(b"".join(digests), "<i8")

        def rows(a: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
            """(doc_id, text_hash, rows) of each text; the first word of the text of each place, its first code point"""
            of = np.searchsorted(firsts, a, "right") - 1
            sizes = np.bincount(of, minlength=len(enough)).tolist()
            own = [(some[t][0], some[t][2], n) for t, n in zip(enough.tolist(), sizes)]
            return own, firsts[of], all_.origin[enough][of]

        edges = np.append(np.append(0, np.flatnonzero(line[1:] != line[:-1]) + 1), len(first))
        long = np.flatnonzero(np.diff(edges) >= LEAST_WORDS)
        if len(long):
            a, b = edges[long], edges[long + 1]
            own, base, origin = rows(a)
            u = [(wide(body[x:y]) >> 64) - (1 << 63) for x, y in zip(starts[a].tolist(), ends[b - 1].tolist())]
            sizes = b - a - SHINGLE + 1
            inside = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            names = ("word", "start", "stop", "n_words", "u1", "hashes", "sizes")
            values = (a - base, point[first[a]] - origin, point[last[b - 1]] - origin, b - a, np.array(u, np.int64), hashes[inside], sizes)
            yield batch("paragraph", own, dict(zip(names, values)))
        at = block_starts(hashes, firsts, counts)
        own, base, origin = rows(at)
        to = np.minimum(at + BLOCK + REACH, base + np.repeat(counts, [n for _, _, n in own]))
        back = np.maximum(at - REACH, base)
        hashes_of = hashed(at, at + BLOCK), hashed(back, at + BLOCK), hashed(at, to)
        names = ("word", "start", "stop", "n_words", "u1", "before", "after", "block_stop", "before_start")
        values = (at - base, point[first[at]] - origin, point[last[to - 1]] - origin, to - at, *hashes_of, point[last[at + BLOCK - 1]] - origin, point[first[back]] - origin)
        yield batch("block", own, dict(zip(names, values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, room = [], SLICE
        for batch in batches:
            for row in zip(*(column for column in batch.columns)):
                some.append(tuple(x.as_py() for x in row))
                room -= len(some[-1][1])
                if room <= 0:
                    yield from of(some)
                    some, room = [], SLICE
        if some:
            yield from of(some)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, _UNITS)


def _holding(rows: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """``rows`` without most of those whose columns ``by`` are not in ``wanted`` (its columns in that order), before anything is shuffled.

    Bits of a hash, some 16 for each wanted row, go to every task: two bytes a row.
    """
    bits = 1 << max(15, 4 + wanted.count().bit_length())
    of = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    place = of(wanted.columns)
    maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_map"))
    own = of(by)
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(own)).withColumn("_bit", bit).join(F.broadcast(maps), "_bucket")
    return met.filter(F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def contexts(docs: DataFrame) -> DataFrame:
    """The words before or after seeds, from ``keyed`` documents with an array ``asked`` (u1, word, right, crowded);
    of rows alike in doc_id and text one per task."""
    names = [c.split()[0] for c in _CONTEXTS.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]

    def of(some: list[tuple], asked: list[pa.StructArray]) -> pa.RecordBatch:
        all_ = _Joined([text for _, text, _ in some])
        text = np.repeat(np.arange(len(some)), [len(a) for a in asked])
        u1, word, right, crowded = pa.concat_arrays(asked).flatten()
        from_left = ~right.to_numpy(zero_copy_only=False)
        at = all_.words[text] + word.to_numpy()
        a = np.where(from_left, np.maximum(at - REACH, all_.words[text]), at)
        b = np.where(from_left, at + BLOCK, np.minimum(at + BLOCK + REACH, all_.words[text + 1]))
        starts, stops = all_.point[all_.first[a]] - all_.origin[text], all_.point[all_.last[b - 1]] - all_.origin[text]
        bodies = [some[t][1][x:y] for t, x, y in zip(text.tolist(), starts.tolist(), stops.tolist())]
        own = [pa.array([row[c] for row in some], pa.int64()).take(pa.array(text)) for c in (0, 2)]
        columns = [u1, right, *own, word, pa.array(starts, pa.int32()), crowded, pa.array(bodies, pa.string())]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, some, lists, room = set(), [], [], SLICE
        for batch in batches:
            asked = batch.column(3)
            for row, (doc_id, text, text_hash) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                if (doc_id, text_hash) in seen:
                    continue
                seen.add((doc_id, text_hash))
                some.append((doc_id, text, text_hash))
                lists.append(asked[row].values)
                room -= len(text)
                if room <= 0:
                    yield of(some, lists)
                    some, lists, room = [], [], SLICE
        if some:
            yield of(some, lists)

    return docs.select("doc_id", "text", "text_hash", "asked").mapInArrow(run, _CONTEXTS)


def _ladder(right: bool, word: int, at: int, text: str) -> list[tuple[bytes, int, int, int, int]]:
    """(hash, word, n_words, start, stop) of the block of a context, then with one more word each."""
    body, starts, ends = single_spaced(text)
    all_ = _Joined([text])
    first, last = all_.point[all_.first], all_.point[all_.last]
    n, out = len(starts), []
    for more in range(n - BLOCK + 1):
        a, b = (0, BLOCK + more) if right else (n - BLOCK - more, n)
        h = xxhash.xxh3_64_digest(body[starts[a] : ends[b - 1]])
        out.append((h, word if right else word - more, BLOCK + more, at + int(first[a]), at + int(last[b - 1])))
    return out


def _edge(text: str, right: bool, n: int) -> int:
    """Where the first ``n`` words of a text end, or its last ``n`` begin, in code points."""
    if right:
        return next(islice(_WORD.finditer(text), n - 1, None)).end()
    return [m.start() for m in _WORD.finditer(text)][-n]


def agreeing(found: DataFrame) -> DataFrame:
    """Of the ``contexts`` of each seed, sorted by place, the longest piece that an earlier one has, too.

    The words from the seed on are a tree whose nodes belong to the first context that came there; a node's own context
    goes on below it only when another one arrives.
    """

    def piece(own: tuple, right: bool, more: int) -> tuple[int, int, int]:
        """word, start and stop of the seed of a context with so many words more"""
        _, _, word, at, text, beyond, least = own
        if least:  # one byte a character and one character between words
            n = least + more + sum(map(len, beyond[:more]))
            edge = at + (n if right else len(text) - n)
        else:
            edge = at + _edge(text, right, BLOCK + more)
        return (word, at, edge) if right else (word - more, edge, at + len(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            out = []
            for u1, right, doc_id, text_hash, word, at, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (u1, right) != now:
                    now, known = (u1, right), {}
                words = text.encode().translate(LOWER).split()
                seed, beyond = (words[:BLOCK], words[BLOCK:]) if right else (words[-BLOCK:], words[-BLOCK - 1 :: -1])
                joined = b" ".join(seed)
                plain = text.isascii() and sum(map(len, words)) + len(words) - 1 == len(text)
                own = (doc_id, text_hash, word, at, text, beyond, len(joined) if plain else 0)
                node = known.setdefault(joined, (own, {}))
                if node[0] is own:
                    continue
                more = 0
                while more < len(beyond):
                    first, below = node
                    if not below and more < len(first[5]):
                        below[first[5][more]] = (first, {})
                    if (child := below.setdefault(beyond[more], (own, {})))[0] is own:
                        break
                    node, more = child, more + 1
                keep = node[0]
                (a, start, stop), (b, keep_start, keep_stop) = piece(own, right, more), piece(keep, right, more)
                if (doc_id, text_hash, a) != (*keep[:2], b):
                    out.append((doc_id, text_hash, a, BLOCK + more, start, stop, *keep[:2], b, keep_start, keep_stop))
            columns = list(zip(*out)) if out else [[]] * len(_PIECE_COLUMNS)
            types = [pa.int64() if n.endswith(("id", "hash")) else pa.int32() for n in _PIECE_COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_PIECE_COLUMNS)

    keys = ["u1", "right"]
    return found.repartition(*keys).sortWithinPartitions(*keys, "doc_id", "text_hash", "word").mapInArrow(run, _PIECES)


def agreeing_crowds(found: DataFrame) -> DataFrame:
    """The pieces that ``contexts`` of crowded seeds share with an earlier one, of every length, by shuffles alone."""
    names = ["u1", "right", "hash", *[c.split()[0] for c in _PIECE.split(", ")]]
    types = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), *[pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u1, right, doc_id, text_hash, word, at, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                made = [(u1, right, h, doc_id, text_hash, *step) for h, *step in _ladder(right, word, at, text)]
                columns = list(zip(*made)) if made else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    pieces = written(found.mapInArrow(run, f"u1 long, right boolean, hash binary, {_PIECE}"), "ladders")
    first = pieces.groupBy("u1", "right", "hash").agg(F.min(F.struct(*_PLACE, "word", "stop")).alias("keep"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").drop("n"), "first")
    return _kept_by(pieces.join(first, ["u1", "right", "hash"]))


def _kept_by(pieces: DataFrame) -> DataFrame:
    """Pieces with a place to ``keep`` that is not their own."""
    own = F.struct(*_PLACE, "word", "stop") == F.col("keep")
    keep = [F.col(f"keep.{c}").alias(n) for c, n in zip(["doc_id", "text_hash", "word", "start", "stop"], _PIECE_COLUMNS[6:])]
    return pieces.filter(~own).select(*_PIECE_COLUMNS[:6], *keep)


def shared_passages(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The result columns of passages that occur in more than one place; ``docs`` as ``keyed``, ``blocks`` of ``units``.

    Places of a seed with the same words after it (or before it) are a class, which belongs to its first place. Where
    a seed has several classes, their first places are compared with each other. So of two texts that share a
    passage the later one has every word of it in pieces of an earlier place. Words before a seed need no piece of their own
    where all its places have the same: an earlier seed stands there. Pieces of a text that lie in one other text at
    the same distance, and which overlap or touch, are one span, equal word for word to the kept one.
    """
    seed = W.partitionBy("u1")
    places = blocks.select("u1", "before", "after", "doc_id", "text_hash", "word", "n_words", "start", "stop", "block_stop", "before_start")
    places = places.withColumn("n", F.count("*").over(seed))
    places = places.withColumns({f"{least.__name__}_{c}": least(c).over(seed) for c in ("before", "after") for least in (F.min, F.max)}).filter("n > 1")
    left, right = F.col("min_before") != F.col("max_before"), F.col("min_after") != F.col("max_after")
    places = places.withColumns({"left": left, "right": right}).drop("n", "min_before", "max_before", "min_after", "max_after")
    after, before = W.partitionBy("u1", "after"), W.partitionBy("u1", "before")
    places = places.withColumn("after_keep", F.min(F.struct(*_PLACE, "word", "stop")).over(after))
    before_place = F.struct("doc_id", "text_hash", F.col("before_start").alias("start"), F.greatest(F.col("word") - REACH, F.lit(0)).alias("word"), F.col("block_stop").alias("stop"))
    places = places.withColumn("before_place", before_place).withColumn("before_keep", F.min("before_place").over(before))
    own = F.struct(*_PLACE, "word", "stop")
    places = places.withColumns({"after_first": F.col("after_keep") == own, "before_first": F.col("before_keep") == F.col("before_place")})
    asks = {"ask_right": F.col("right") & F.col("after_first"), "ask_left": F.col("left") & F.col("before_first")}
    places = places.withColumns(asks)
    places = places.withColumns({f"many_{s}": F.sum(F.col(f"ask_{s}").cast("int")).over(seed) > MANY for s in ("right", "left")})
    before_kept = ~F.col("before_first") & (F.col("left") | (F.col("word") < REACH))
    places = places.filter(~F.col("after_first") | before_kept | F.col("ask_right") | F.col("ask_left"))
    # A keep is null where its piece is not needed, so that it takes no room.
    keeps = {"after_keep": F.when(~F.col("after_first"), F.col("after_keep")), "before_keep": F.when(before_kept, F.col("before_keep"))}
    places = written(places.withColumns(keeps).drop("before_place", "before", "after", "left", "right", "after_first", "before_first"), "places")

    same = _kept_by(places.filter("after_keep is not null").withColumnRenamed("after_keep", "keep"))
    head = F.greatest(F.col("word") - REACH, F.lit(0))
    ahead = places.filter("before_keep is not null").select(
        "doc_id", "text_hash", head.alias("word"), (F.col("word") - head + BLOCK).alias("n_words"), F.col("before_start").alias("start"), F.col("block_stop").alias("stop"), F.col("before_keep").alias("keep")
    )
    ask = F.array(*[F.when(F.col(f"ask_{s}"), F.struct("u1", "word", F.lit(s == "right").alias("right"), F.col(f"many_{s}").alias("crowded"))) for s in ("right", "left")])
    asked = places.filter("ask_right or ask_left").select("doc_id", "text_hash", F.explode(F.array_compact(ask)).alias("a"))
    asked = asked.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(F.collect_list("a").alias("asked"))
    asked = written(asked, "asked")
    met = _holding(docs, asked.select("own_id", "own_hash"), "doc_id", "text_hash")
    met = met.join(asked, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    found = written(contexts(met), "contexts")
    met = same.union(_kept_by(ahead)).union(agreeing(found.filter("not crowded"))).union(agreeing_crowds(found.filter("crowded")))

    met = met.withColumn("apart", F.col("word") - F.col("keep_word")).withColumn("end", F.col("word") + F.col("n_words"))
    one = ["doc_id", "text_hash", "keep_doc_id", "keep_hash", "apart"]
    in_text = W.partitionBy(*one).orderBy("word")
    begins = F.coalesce(F.col("word") > F.max("end").over(in_text.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    spans = met.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(in_text.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy(*one, "span").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        (F.max("end") - F.min("word")).alias("n_words"),
        F.min("keep_start").alias("keep_start"),
        F.max("keep_stop").alias("keep_stop"),
    )
    spans = spans.withColumn("class_id", F.xxhash64("keep_doc_id", "keep_hash", "keep_start", "keep_stop"))
    spans = written(spans.withColumn("kind", F.lit("block")), "spans")
    kept = spans.select(F.col("keep_doc_id").alias("doc_id"), "kind", F.col("keep_start").alias("start"), F.col("keep_stop").alias("stop"), "n_words", "class_id", "keep_doc_id", "keep_start", F.lit(True).alias("kept"))
    return spans.withColumn("kept", F.lit(False)).select(*_RESULT).union(kept.select(*_RESULT)).distinct()


def keyed(docs: DataFrame) -> DataFrame:
    text = whole()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _texts(docs: DataFrame, distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, body) of the wanted u1, from the documents (as ``keyed``) that hold the first place of each."""
    place = distinct.join(wanted, "u1").select("u1", "owner.*")
    place = place.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("u1", "start", "stop")).alias("spans"))
    place = written(place.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "spans"), "owners")
    met = _holding(docs, place.select("own_id", "own_hash"), "doc_id", "text_hash")
    met = met.join(place, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    met = met.select("text", F.explode("spans").alias("s"))
    texts = met.select(F.col("s.u1").alias("id"), F.expr("substring(text, s.start + 1, s.stop - s.start)").alias("body"))
    return written(texts.dropDuplicates(["id"]), "paragraphs")


def _linked(left: list[tuple], right: list[tuple]) -> Iterator[tuple]:
    """Similar (a, b) of two lists of (u1, class, body), only such that connect classes which the earlier do not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def shingles(body: str) -> frozenset:
        return frozenset(shingle_hashes(body, SHINGLE).tolist())

    sets = [(u, c, shingles(t)) for u, c, t in right]
    of = {u: s for u, _, s in sets}
    for u, c, t in left:
        own = of[u] if u in of else shingles(t)
        for v, d, other in sets:
            small, large = sorted((len(own), len(other)))
            if small >= SIMILAR * large and root(c) != root(d):
                shared = len(own & other)
                if shared >= SIMILAR * (small + large - shared):
                    parent[root(c)] = root(d)
                    yield min(u, v), max(u, v)


def _links_between(members: DataFrame) -> DataFrame:
    """(a, b): similar members of different classes of a bucket; ``members`` has key, u1, class, odd and body.

    Every odd member meets every member of its bucket. Nearly all buckets are small and are compared one after the other
    in sorted partitions. A larger one is cut into blocks of at most about ``CROWD`` members and ``CROWD_BYTES`` of
    text, and a task compares two blocks. Only links that connect classes which its earlier links do not connect already
    are returned, so no pairs are made as rows.
    """
    size = F.greatest(F.count("*") / CROWD, F.sum(F.octet_length("body")) / CROWD_BYTES)
    blocks = members.groupBy("key").agg(F.ceil(size).cast("int").alias("n"))
    members = members.join(written(blocks, "blocks"), "key")
    links = f"a {dict(members.dtypes)['u1']}, b {dict(members.dtypes)['u1']}"

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, bucket in groupby(rows, key=itemgetter(0)):
            bucket = list(bucket)
            every = [(u, c, t) for _, u, c, _, t in bucket]
            found = list(_linked([x for x, row in zip(every, bucket) if row[3]], every))
            if found:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found])

    small = members.filter("n = 1").select("key", "u1", "class", "odd", "body")
    small = small.repartition("key").sortWithinPartitions("key").mapInArrow(one_by_one, links)

    blocks = members.filter("n > 1").withColumn("block", F.pmod(F.xxhash64("u1"), F.col("n")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    odd = blocks.filter("odd").select("key", F.col("block").alias("i"), F.col("other").alias("j"), "u1", "class", "body")
    fresh = [F.col(c).alias(c) for c in ("key", "u1", "class", "body")]  # both sides come from one table
    rest = blocks.select(F.col("other").alias("i"), F.col("block").alias("j"), *fresh)

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = [list(zip(x["u1"], x["class"], x["body"])) for x in (left, right)]
        return pd.DataFrame(_linked(*of), columns=["a", "b"], dtype=left["u1"].dtype)

    large = odd.groupBy("key", "i", "j").cogroup(rest.groupBy("key", "i", "j")).applyInPandas(compared, links)
    return small.union(large).distinct()


def similar_classes(docs: DataFrame, paragraphs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(node, least) over the u1 of distinct paragraphs (or whole texts) that are similar to another one.

    ``docs`` as ``keyed``; ``paragraphs`` has u1 and the band keys, which are not moved otherwise, and each u1 once or more;
    ``distinct`` has u1 and the owner: doc_id, text_hash, start and stop of one place.
    """
    member = paragraphs.select(F.explode("bands").alias("key"), "u1")
    buckets = member.groupBy("key").agg(F.min("u1").alias("least"), F.max("u1").alias("most"), F.count("*").alias("n"))
    buckets = written(buckets.filter("least != most").select("key", "n"), "buckets")
    member = _holding(member, buckets.select("key"), "key").join(buckets, "key")
    member = written(member.distinct(), "members")
    popular = member.groupBy("u1").agg(F.sum("n").alias("met"))
    member = member.drop("n").join(popular, "u1").select("key", "u1", "met")
    texts = _texts(docs, distinct, member.select("u1").distinct())

    # The leader of a bucket is the member that collides with most others in all bands.
    leader = member.groupBy("key").agg(F.max(F.struct("met", "u1")).alias("l")).select("key", F.col("l.u1").alias("leader"))
    star = written(member.select("key", "u1").join(written(leader, "leaders"), "key"), "star")
    pairs = star.filter("u1 != leader").select(F.least("leader", "u1").alias("a"), F.greatest("leader", "u1").alias("b"))
    near = written(similar_pairs(pairs.distinct(), texts), "near")
    known = written(components(near, "a", "b").select(F.col("node").alias("u1"), F.col("least").alias("class")), "known")

    now = star.join(known, "u1", "left").select("key", "u1", "leader", F.coalesce("class", "u1").alias("class"))
    led = known.select(F.col("u1").alias("leader"), F.col("class").alias("led"))
    now = now.join(led, "leader", "left").withColumn("odd", F.col("class") != F.coalesce("led", "leader"))
    now = written(now.select("key", "u1", "class", "odd"), "now")
    open_ = written(now.filter("odd").select("key").distinct(), "open")
    apart = now.join(open_, "key").join(texts.select(F.col("id").alias("u1"), "body"), "u1")
    return components(near.union(_links_between(apart)), "a", "b")


_PLACE = ["doc_id", "text_hash", "start"]
_RESULT = ["doc_id", "kind", "start", "stop", "n_words", "class_id", "keep_doc_id", "keep_start", "kept"]


def _against(members: DataFrame) -> DataFrame:
    """The result columns of units that carry their class and its first place."""
    kept = F.struct(*_PLACE) == F.col("keep")
    return members.select(
        "doc_id",
        "kind",
        "start",
        "stop",
        "n_words",
        "class_id",
        F.col("keep.doc_id").alias("keep_doc_id"),
        F.col("keep.start").alias("keep_start"),
        kept.alias("kept"),
    ).distinct()


def repeated(docs: DataFrame) -> DataFrame:
    """Every paragraph and passage that occurs in more than one place, with its class and the place that is kept.

    doc_id, kind, start and stop (code points), n_words, class_id (a hash), keep_doc_id, keep_start, kept. A
    class keeps its first place by doc_id (null first) and start. Places are told apart by doc_id, text and
    start, so rows alike in doc_id and text count once. Null, empty and short texts have no units; no rows
    give no rows. Columns other than doc_id and text are not read.
    """
    docs = keyed(docs)
    found = written(units(docs), "units")
    place = F.struct(*_PLACE)

    passages = shared_passages(docs, found.filter("kind = 'block'"))
    paragraphs = found.filter("kind = 'paragraph'")
    distinct = paragraphs.groupBy("u1").agg(F.min(F.struct(*_PLACE, "stop")).alias("owner"), F.max(place).alias("most"))
    distinct = written(distinct, "distinct")
    classes = similar_classes(docs, paragraphs, distinct)
    labelled = distinct.select("u1", F.struct(*[F.col(f"owner.{c}") for c in _PLACE]).alias("keep"), "most")
    labelled = labelled.join(classes.withColumnRenamed("node", "u1"), "u1", "left")
    labelled = written(labelled.withColumn("class_id", F.coalesce("least", "u1")), "labelled")
    kept = labelled.groupBy("class_id").agg(F.min("keep").alias("keep"), F.max("most").alias("most"))
    kept = kept.filter("keep != most").select("class_id", "keep")
    of = written(labelled.select("u1", "class_id").join(kept, "class_id"), "classes")
    paragraphs = paragraphs.drop("bands").join(of, "u1")
    return _against(paragraphs).unionByName(passages).select(*_RESULT)


@query()
def op8_repeated_passages(spark, sf_dir):
    return repeated(documents(spark, sf_dir))
