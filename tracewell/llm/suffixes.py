"""Suffix-array dedup: every byte of a string that also starts in an earlier document goes.

A string is any ``LENGTH`` (50) bytes inside one text. Texts are packed into slabs, tables of some megabytes that
stay where they are; four steps work on them.

1. Suffixes that matter. The anchor of a string is the first place of the least hash among its ``GRAM``-byte
   grams, so equal strings have equal anchors wherever they stand, and one suffix in about 18 is an anchor. A gram
   of an anchor that stands in one document only cannot belong to a repeated string: the grams' hashes are
   exchanged (each once per slab), and only suffixes of repeated ones go on.
2. Sorted runs. Each slab sorts its suffixes, cut at the bytes that a string can need (LENGTH to the right, the
   rest to the left). Equal ones of later documents are decided here. What is left is front-coded (the length of
   the prefix shared with the one before, and the other bytes) and dealt out by gram.
3. Merge. A loser tree over the runs of a part compares two suffixes from the prefix on that both are known to
   share with the last winner, and yields the common prefixes of neighbours. Strings are equal if these reach
   far enough to the right, and likewise to the left, so the least document of each string is found exactly;
   hashes only ever choose what is compared.
4. Spans go back to their slab, where they are united and the other bytes kept.

A gram that stands in very many places (``CROWD``) would bring them all into one part. Its strings are sorted one
by one instead and dealt out by all their bytes; equal strings of a slab are one, so no key has more rows than
there are slabs. The order is that of the parts, and by bytes inside each: equality needs no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import documents, query, whole, written
from tracewell.llm.loser_tree import merged

LENGTH, GRAM = 50, 16
SLAB = 8 << 20  # bytes of text; one longer text is a slab of its own
BUCKET_GRAMS = 4 << 20  # distinct grams of slabs that one task compares
PART_SUFFIXES = 200_000  # suffixes that one task merges
CROWD = 4096
_CHUNK = 1 << 18
_PLACES = np.uint64((1 << 20) - 1)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SLABS = "slab long, ids array<long>, sizes array<long>, body binary"
_GRAMS = "bucket int, slab long, hashes binary, counts binary"
_FOUND = "slab long, bucket int, codes binary"
_RUNS = "part int, slab long, n int, shared binary, rest binary, left binary, low binary, high binary, ids binary, at binary, starts binary, stops binary"
_SPANS = "slab long, starts binary, stops binary"


def _press(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _open(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _cells(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _table(schema: str, **columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in fields})


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD[2]
    return h ^ (h >> np.uint64(29))


def slabs(docs: DataFrame, size: int = SLAB) -> DataFrame:
    """Texts side by side, compressed, with their doc_ids and lengths in bytes; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, room, number = [], [], size, TaskContext.get().partitionId() << 32

        def one() -> pa.RecordBatch:
            body = _press(np.frombuffer(b"".join(texts), np.uint8))
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([body])]
            return pa.RecordBatch.from_arrays(columns, names=["slab", "ids", "sizes", "body"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                if texts and len(data) > room:
                    yield one()
                    ids, texts, room, number = [], [], size, number + 1
                ids.append(doc_id.as_py())
                texts.append(data)
                room -= len(data)
        if texts:
            yield one()

    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id must be a whole number to be ordered, not {kind}")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(run, _SLABS)


class Slab:
    """One slab, read: ``body`` with room to look ahead, first and last byte (exclusive) and id of each document."""

    def __init__(self, ids: list, sizes: list, body: bytes, length: int):
        self.ids, self.length = ids, length
        self.stops = np.cumsum(np.array(sizes, np.int64))
        self.starts = self.stops - np.array(sizes, np.int64)
        self.size = int(self.stops[-1]) if len(ids) else 0
        self.body = np.zeros(self.size + length + GRAM, np.uint8)
        self.body[: self.size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)

    def document(self, at: np.ndarray) -> np.ndarray:
        """Of each place the number of its document; empty texts hold no place."""
        return np.searchsorted(self.stops, at, "right")

    def strings(self) -> np.ndarray:
        """At which bytes a string begins. Texts without an id are neither earlier nor later than others."""
        begins = np.ones(self.size, bool)
        for doc_id, start, stop in zip(self.ids, self.starts.tolist(), self.stops.tolist()):
            begins[start if doc_id is None else max(start, stop - self.length + 1) : stop] = False
        return begins

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor its place, how far back its last and its first string begin, and the hash of its gram."""
        grams, begins, out = self.length - GRAM + 1, self.strings(), []
        for at in range(0, self.size, _CHUNK):
            n = min(_CHUNK, self.size - at)
            m = n + grams - 1
            words = np.ndarray((m + 8,), "<u8", self.body[at:].data, 0, (1,)) * np.uint64(1)
            h = _mixed(words[:m] * _ODD[0] + words[8:] * _ODD[1])
            least, width = (h & ~_PLACES) | np.arange(m, dtype=np.uint64), 1
            while 2 * width <= grams:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < grams:
                least = np.minimum(least[: n], least[grams - width : grams - width + n])
            first = np.flatnonzero(begins[at : at + n])
            if not len(first):
                continue
            own = (least[first] & _PLACES).astype(np.int64)
            edge = np.flatnonzero(own[1:] != own[:-1]) + 1
            heads, tails = np.append(0, edge), np.append(edge, len(own)) - 1
            place = own[heads]
            out.append((place + at, place - first[tails], place - first[heads], _mixed(h[place] ^ _ODD[1])))
        if not out:
            empty = np.empty(0, np.int64)
            return empty, empty, empty, np.empty(0, np.uint64)
        return tuple(np.concatenate(c) for c in zip(*out))


def _bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram over 32 further bits of its hash."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def _rows(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, Slab]]:
    for i in range(batch.num_rows):
        slab, ids, sizes, body = (batch.column(c)[i].as_py() for c in range(4))
        yield slab, Slab(ids, sizes, body, length)


def grams(made: DataFrame, buckets: int, length: int) -> DataFrame:
    """Per slab and bucket the distinct gram hashes of its anchors, each with its count and a mark for several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, slab in _rows(batch, length):
                at, _, _, h = slab.anchors()
                keys = _bucketed(h, buckets)
                order = np.argsort(keys, kind="stable")
                keys, doc = keys[order], slab.document(at[order])
                head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
                tail = np.append(head[1:], len(keys)) - 1 if len(keys) else head
                counts = (np.minimum(tail - head + 1, 127) | (doc[head] != doc[tail]) * 128).astype(np.uint8)
                keys = keys[head]
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys)) if len(keys) else [0]
                parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
                made = _table(
                    _GRAMS,
                    bucket=[int(bucket[p.start]) for p in parts],
                    slab=[number] * len(parts),
                    hashes=[keys[p].astype("<u4").tobytes() for p in parts],
                    counts=[_press(counts[p]) for p in parts],
                )
                yield from made.to_batches()

    return made.mapInArrow(run, _GRAMS)


def repeated(found: DataFrame, crowd: int) -> DataFrame:
    """Per slab and bucket a code for each of its grams: 0 for one document only, 1 for several, 2 for a crowd."""

    def one(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, "<u4") for h in _cells(rows, "hashes")]
        counts = np.concatenate([_open(c, np.uint8) for c in _cells(rows, "counts")])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order].astype(np.int64)
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        sizes = np.diff(np.append(head, len(every)))
        several = (sizes > 1) | (np.maximum.reduceat(counts, head) >= 128)
        code = several.astype(np.uint8) + (several & (np.add.reduceat(counts & 127, head) > crowd))
        codes = np.empty(len(every), np.uint8)
        codes[order] = np.repeat(code, sizes)
        cut = np.split(codes, np.cumsum([len(h) for h in hashes])[:-1])
        return _table(_FOUND, slab=_cells(rows, "slab"), bucket=_cells(rows, "bucket"), codes=[_press(c) for c in cut])

    return found.groupBy("bucket").applyInArrow(one, _FOUND)


def _sorted_suffixes(slab: Slab, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of each suffix in sorted order, order, which are decided already).

    A row holds the bytes to the right, those to the left from the anchor outward, and the range of strings; bytes
    that no string of the range needs are zero, so equal rows stand for equal strings. Of equal rows those of a
    later document than the least are decided.
    """
    length, left = slab.length, slab.length - GRAM
    padded = np.concatenate([np.zeros(left, np.uint8), slab.body])
    rows = np.empty((len(at), length + left + 10), np.uint8)
    window = np.lib.stride_tricks.sliding_window_view(padded, left + length)[at]
    rows[:, :length] = window[:, left:] * (np.arange(length) < (length - low)[:, None])
    rows[:, length : length + left] = window[:, left - 1 :: -1][:, :left] * (np.arange(left) < high[:, None])
    rows[:, -10], rows[:, -9] = low, high
    ids = np.array([i if i is not None else 0 for i in slab.ids], np.int64)[slab.document(at)]
    rows[:, -8:] = (ids.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    order = np.argsort(rows.view(f"V{rows.shape[1]}").ravel(), kind="stable")
    rows, ids = rows[order], ids[order]
    fresh = np.append(True, (rows[1:, :-8] != rows[:-1, :-8]).any(axis=1)) if len(rows) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
    return rows, order, ids != ids[head]


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many first bytes each row shares with the one before; the first row none."""
    if not len(rows):
        return np.empty(0, np.int64)
    apart = rows[1:] != rows[:-1]
    n = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])
    return np.append(0, n).astype(np.int64)


def _string_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of whole rows of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for word in wide.view("<u8").T:
        h = _mixed(h * _ODD[0] + word)
    return h


def runs(made: DataFrame, found: DataFrame, buckets: int, parts: int, length: int) -> DataFrame:
    """The front-coded sorted runs of each slab, dealt out over the parts, and the spans that it decides itself."""
    left = length - GRAM

    def one(slab_rows: pa.Table, codes: pa.Table) -> pa.Table:
        if not slab_rows.num_rows or not codes.num_rows:
            return _table(_RUNS, **{f.split()[0]: [] for f in _RUNS.split(", ")})
        number, slab = next(_rows(slab_rows.combine_chunks().to_batches()[0], length))
        at, low, high, h = slab.anchors()
        keys, inverse = np.unique(_bucketed(h, buckets), return_inverse=True)
        code = np.zeros(len(keys), np.uint8)
        for bucket, values in zip(_cells(codes, "bucket"), _cells(codes, "codes")):
            values = _open(values, np.uint8)
            first = np.searchsorted(keys, np.uint64(bucket) << np.uint64(32))
            code[first : first + len(values)] = values
        code = code[inverse]
        use = code > 0
        at, low, high, h, code = at[use], low[use], high[use], h[use], code[use]

        rows, order, decided = _sorted_suffixes(slab, at, low, high)
        at, low, high, h, code = at[order], low[order], high[order], h[order], code[order]
        spans = [(at[decided] - high[decided], at[decided] - low[decided] + length)]
        keep = ~decided & (code == 1)
        open_ = [(rows[keep], at[keep], low[keep], high[keep], h[keep])]
        hot = ~decided & (code == 2)
        if hot.any():
            n = high[hot] - low[hot] + 1
            back = np.repeat(high[hot], n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            places = np.repeat(at[hot], n) - back
            none = np.zeros(len(places), np.int64)
            rows, order, decided = _sorted_suffixes(slab, places, none, none)
            places = places[order]
            spans.append((places[decided], places[decided] + length))
            rows, places = rows[~decided], places[~decided]
            none = none[: len(places)]
            open_.append((rows, places, none, none, _string_hash(rows[:, :length])))

        out = {f.split()[0]: [] for f in _RUNS.split(", ")}
        for rows, at, low, high, h in open_:
            part = (h % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(order) else []
            for a, b in zip(edges, [*edges[1:], len(order)]):
                some = order[a:b]
                block = rows[some]
                shared = shared_prefixes(block[:, :length])
                ids = (np.ascontiguousarray(block[:, -8:]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                out["part"].append(int(part[some[0]]))
                out["n"].append(len(some))
                out["shared"].append(_press(shared.astype(np.uint8)))
                out["rest"].append(_press(block[:, :length][np.arange(length) >= shared[:, None]]))
                out["left"].append(_press(block[:, length : length + left][np.arange(left) < high[some][:, None]]))
                out["low"].append(_press(low[some].astype(np.uint8)))
                out["high"].append(_press(high[some].astype(np.uint8)))
                out["ids"].append(_press(ids))
                out["at"].append(_press(at[some]))
        out["starts"], out["stops"] = [None] * len(out["part"]), [None] * len(out["part"])
        starts, stops = (np.concatenate(c) for c in zip(*spans))
        if len(starts):
            # These pass through some part unchanged.
            for name, values in out.items():
                given = {"part": number % parts, "n": 0, "starts": _press(starts), "stops": _press(stops)}
                values.append(given.get(name))
        out["slab"] = [number] * len(out["part"])
        return _table(_RUNS, **out)

    return made.groupBy("slab").cogroup(found.groupBy("slab")).applyInArrow(one, _RUNS)


def _unfolded(shared: np.ndarray, rest: np.ndarray, length: int) -> np.ndarray:
    """The rows of a front-coded run."""
    own = np.arange(length) >= shared[:, None]
    rows = np.zeros((len(shared), length), np.uint8)
    rows[own] = rest
    for column in range(length):
        source = np.maximum.accumulate(np.where(own[:, column], np.arange(len(shared)), 0))
        rows[:, column] = rows[source, column]
    return rows


def earlier(shared: np.ndarray, lefts: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix of a sorted part the least and greatest distance back at which a string begins that an earlier
    document has too; -1 for none.

    ``shared`` are the common prefixes of neighbours to the right, ``lefts`` the bytes to the left, outward. Two
    suffixes have the string that begins ``o`` bytes back in common if they share length - o bytes to the right
    and o to the left; both are ranges of a sorted order.
    """
    n = len(shared)
    nearest, farthest = np.full(n, -1), np.full(n, -1)
    left_order = np.argsort(lefts.view(f"V{lefts.shape[1]}").ravel(), kind="stable")
    left_shared = shared_prefixes(lefts[left_order])
    rank = np.unique(ids, return_inverse=True)[1]
    left = np.empty(n, np.int64)
    for back in range(length - GRAM + 1):
        some = np.flatnonzero((low <= back) & (back <= high))
        if len(some) < 2:
            continue
        right = np.cumsum(shared < length - back)[some]
        left[left_order] = np.cumsum(left_shared < back)
        order = np.lexsort((rank[some], left[some], right))
        some, right, own = some[order], right[order], left[some][order]
        fresh = np.append(True, (right[1:] != right[:-1]) | (own[1:] != own[:-1]))
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))
        later = some[rank[some] != rank[some[head]]]
        nearest[later] = np.where(nearest[later] < 0, back, nearest[later])
        farthest[later] = back
    return nearest, farthest


def spans_of(found: DataFrame, length: int) -> DataFrame:
    """Per slab the spans (start and stop in the slab) that the merge of each part decides, and those decided before."""
    left = length - GRAM

    def one(rows: pa.Table) -> pa.Table:
        out = [(s, a, b) for s, n, a, b in zip(*(_cells(rows, c) for c in ("slab", "n", "starts", "stops"))) if not n]
        rows = rows.filter(pa.compute.greater(rows.column("n"), 0))
        if rows.num_rows:
            numbers, read = _cells(rows, "slab"), {c: [_open(v, k) for v in _cells(rows, c)] for c, k in _KINDS.items()}
            blocks = [_unfolded(s.astype(np.int64), r, length) for s, r in zip(read["shared"], read["rest"])]
            texts = []
            for block in blocks:
                data = block.tobytes()
                texts.append([data[i : i + length] for i in range(0, len(data), length)])
            run, shared = merged(texts, [s.tolist() for s in read["shared"]])
            del texts
            place = np.empty(len(run), np.int64)  # of each merged suffix its number among the runs put end to end
            place[np.argsort(run, kind="stable")] = np.arange(len(run))
            low, high, ids, at = (np.concatenate(read[c])[place] for c in ("low", "high", "ids", "at"))
            lefts = np.zeros((len(run), left), np.uint8)
            every = np.concatenate(read["high"]).astype(np.int64)
            lefts[np.arange(left) < every[:, None]] = np.concatenate(read["left"])
            nearest, farthest = earlier(shared, lefts[place], low.astype(np.int64), high.astype(np.int64), ids, length)
            slab, hit = np.array(numbers)[run], nearest >= 0
            starts, stops, slab = at[hit] - farthest[hit], at[hit] - nearest[hit] + length, slab[hit]
            for number in np.unique(slab):
                mine = slab == number
                out.append((int(number), _press(starts[mine]), _press(stops[mine])))
        return _table(_SPANS, slab=[o[0] for o in out], starts=[o[1] for o in out], stops=[o[2] for o in out])

    return found.groupBy("part").applyInArrow(one, _SPANS)


_KINDS = {"shared": np.uint8, "rest": np.uint8, "left": np.uint8, "low": np.uint8, "high": np.uint8, "ids": np.int64, "at": np.int64}
_RESULT = "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"


def _united(starts: np.ndarray, stops: np.ndarray, slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Spans of a slab that neither overlap nor touch inside a document, in order."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    other = slab.document(starts[1:]) != slab.document(starts[:-1])
    head = np.flatnonzero(np.append(True, (starts[1:] > stops[:-1]) | other)) if len(starts) else np.empty(0, np.int64)
    return starts[head], stops[np.append(head[1:], len(starts)) - 1] if len(starts) else stops


def cut_out(made: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document with its removed spans united, in bytes of its text, and the bytes that stay."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.binary())]

    def one(slab_rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for batch in slab_rows.combine_chunks().to_batches():
            for _, slab in _rows(batch, LENGTH):
                starts, stops = _united(*(np.concatenate([np.empty(0, np.int64), *[_open(v, np.int64) for v in _cells(found, c)]]) for c in ("starts", "stops")), slab)
                first = np.searchsorted(starts, slab.starts, "left")
                data = slab.body[: slab.size].tobytes()
                for doc_id, start, stop, at, end in zip(slab.ids, slab.starts.tolist(), slab.stops.tolist(), first, [*first[1:], len(starts)]):
                    edges = [start, *np.column_stack([starts[at:end], stops[at:end]]).ravel().tolist(), stop]
                    kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])])
                    removed = [{"start": a - start, "stop": b - start} for a, b in zip(edges[1:-1:2], edges[2:-1:2])]
                    rows.append((doc_id, stop - start, removed, kept))
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds)})

    return made.groupBy("slab").cogroup(spans.groupBy("slab")).applyInArrow(one, _RESULT)


def without_repeats(docs: DataFrame, length: int = LENGTH, slab: int = SLAB, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes, in order) and kept (the other bytes) of every row.

    Removed are the bytes covered by a string of ``length`` bytes that also starts in a row with a smaller doc_id.
    Rows of one doc_id are not earlier than each other; a row without doc_id is neither earlier nor later than any and stays
    whole. Null texts are empty; texts shorter than ``length`` stay; no rows give no rows. Columns other than
    doc_id (a whole number, or the call is refused) and text are not read.
    """
    if not 2 * GRAM <= length <= 255:
        raise ValueError(f"the length must be {2 * GRAM} to 255 bytes")
    made = written(slabs(docs, slab), "slabs")
    size = made.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).head()[0] or 0
    anchors = 2 * size // (length - GRAM + 2)
    buckets, parts = 1 + anchors // BUCKET_GRAMS, 1 + anchors // PART_SUFFIXES
    found = written(repeated(grams(made, buckets, length), crowd), "repeated")
    spans = written(spans_of(runs(made, found, buckets, parts, length), length), "spans")
    return cut_out(made, spans)


@query("""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (
  SELECT k, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)
), g AS (
  SELECT k, i FROM (SELECT k, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS gone FROM w) WHERE gone
), b AS (
  SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS span
  FROM (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > 50, true)::INT AS new FROM g)
), r AS (
  SELECT k, span, min(i) AS a, max(i) + 50 AS z FROM b GROUP BY k, span
), kept AS (
  SELECT k, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM (SELECT r.*, x, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM r JOIN d USING (k)) GROUP BY k
)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
""")
def op11_suffix_dedup(spark, sf_dir):
    made = without_repeats(documents(spark, sf_dir))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return made.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
