"""Fill-in-the-middle transformation by secondary sort.

A text is cut into units (white space with the word after it; white space at the end), and the units into prefix,
middle and suffix at places that a hash of the document's id decides. Chunks of whole units leave the first task as
pieces keyed by document and place in the output; one shuffle by document with a sort inside each partition
(``repartition`` and ``sortWithinPartitions``) brings the pieces of a document one after the other, and a running
digest takes them as they come. The restorer reads the same stream, tells the parts by the sentinels between them
and gives every piece its place in the text; a second sort inside the same partitions, without a shuffle, streams
the restored text into a second digest. No task holds more than a few pieces, however long a document is.

Plain documents need no move: only a header row without text passes the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewell.llm.common import documents, query, whole

SEED = 42
PIECE = 1 << 15  # bytes of a piece
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of non-plain documents and of those in suffix-first form, in per cent.
RATE, SUFFIX_FIRST = 50, 80
#: The order of the parts in the text.
_ROLES = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_FLUSH = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(text: bytes) -> np.ndarray:
    """The byte after each unit of a text: each word's end, and the end of white space after the last word."""
    space = np.append(_SPACE[np.frombuffer(text, np.uint8)], True)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text)) if text and space[-2] else ends


def draw(doc_id: object, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers that only the document's id decides; null counts as an empty id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest[:16], ">u4").tolist()


def cut(text: bytes, ends: np.ndarray, numbers: list[int]) -> tuple[str, int, int]:
    """Form, and the bytes at which the prefix and the middle end."""
    if not text or numbers[2] % 100 >= RATE or any(s in text for s in _ROLES):
        return "plain", 0, 0
    first, second = sorted((numbers[0] % (len(ends) + 1), numbers[1] % (len(ends) + 1)))
    at = [0, *ends[[first - 1, second - 1]].tolist()]
    return "spm" if numbers[3] % 100 < SUFFIX_FIRST else "psm", at[1] if first else 0, at[2] if second else 0


def chunks(text: bytes, ends: np.ndarray, begin: int, stop: int) -> Iterator[bytes]:
    """Whole units of text[begin:stop] in pieces of at most PIECE bytes; a longer unit is cut."""
    while begin < stop:
        if begin + PIECE >= stop:
            end = stop
        else:
            fit = int(np.searchsorted(ends, begin + PIECE, "right")) - 1
            end = int(ends[fit]) if fit >= 0 and ends[fit] > begin else begin + PIECE
        yield text[begin:end]
        begin = end


def arranged(text: bytes, ends: np.ndarray, form: str, a: int, b: int) -> Iterator[bytes]:
    """The pieces of the output, sentinels among them."""
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
        yield mark
        yield from chunks(text, ends, *parts[mark])


class _Rows:
    """Rows of pieces, given out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.room = schema, [], _FLUSH

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.room -= len(row[-1] or b"") + 200
        if self.room <= 0:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self.rows, self.room = [], _FLUSH


_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _schema(docs: DataFrame) -> tuple[T.StructType, pa.Schema]:
    fields = [T.StructField("row", T.LongType()), T.StructField("place", T.LongType()), docs.schema["doc_id"]]
    made = T.StructType([*fields, *T.StructType.fromDDL(_FIELDS).fields, T.StructField("piece", T.BinaryType())])
    return made, to_arrow_schema(made)


def pieces(docs: DataFrame, seed: int = SEED, plain: bool = False) -> DataFrame:
    """A header (place -1) for every row of ``docs`` and the pieces of its output by place; of plain ones only on demand."""
    made, arrow = _schema(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(arrow)
        for batch in batches:
            for at in range(batch.num_rows):
                row, doc_id, text = (batch.column(i)[at].as_py() for i in range(3))
                body = (text or "").encode()
                ends = unit_ends(body)
                form, a, b = cut(body, ends, draw(doc_id, seed))
                if form == "plain":
                    digest = hashlib.sha256(body).hexdigest()
                    yield from out.add((row, -1, doc_id, len(ends), form, None, None, digest, digest, None))
                    output = chunks(body, ends, 0, len(body)) if plain else ()
                else:
                    points = [len(body[:a].decode()), len(body[a:b].decode())]
                    yield from out.add((row, -1, doc_id, len(ends), form, *points, None, None, None))
                    output = arranged(body, ends, form, a, b)
                for place, piece in enumerate(output):
                    yield from out.add((row, place, doc_id, *[None] * 6, piece))
        yield from out.flush()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole().alias("text"))
    return numbered.mapInArrow(run, made)


def assembled(made: DataFrame) -> DataFrame:
    """The pieces of a document one after the other, in the order of its output; all of one document in one partition."""
    return made.repartition("row").sortWithinPartitions("row", "place")


def restored(stream: DataFrame) -> DataFrame:
    """The same pieces with their places in the text and the digest of the output in the header; sentinels are gone."""
    arrow = to_arrow_schema(stream.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest, role, number = _Rows(arrow), None, None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] < 0:
                    if head is not None:
                        yield from out.add(_with(head, 7, digest))
                    head, digest, number = row, hashlib.sha256() if row[4] != "plain" else None, 0
                    continue
                piece = row[-1]
                digest.update(piece)
                if piece in _ROLES:
                    role = _ROLES[piece]
                else:
                    yield from out.add((row[0], role << 40 | number, *row[2:]))
                    number += 1
        if head is not None:
            yield from out.add(_with(head, 7, digest))
        yield from out.flush()

    return stream.mapInArrow(run, stream.schema).sortWithinPartitions("row", "place")


def _with(head: tuple, at: int, digest) -> tuple:
    return head if digest is None else (*head[:at], digest.hexdigest(), *head[at + 1 :])


def checked(stream: DataFrame) -> DataFrame:
    """One row per document with both digests, from pieces in the order of the text."""
    arrow = to_arrow_schema(stream.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest = _Rows(arrow), None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] < 0:
                    if head is not None:
                        yield from out.add(_with(head, 8, digest))
                    head, digest = row, hashlib.sha256() if row[4] != "plain" else None
                else:
                    digest.update(row[-1])
        if head is not None:
            yield from out.add(_with(head, 8, digest))
        yield from out.flush()

    return stream.mapInArrow(run, stream.schema).drop("row", "place", "piece")


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the digests of output and restored text of every row.

    Null texts are empty; empty texts and texts that hold a sentinel are plain, whose lengths are null. A null id
    is drawn like an empty one; repeated rows give a row each, no rows none. Columns other than doc_id and text
    are not read. Rows are numbered where they are read, so ``docs`` should be a table or another input whose
    order does not change when a task is repeated.
    """
    return checked(restored(assembled(pieces(docs, seed))))


def outputs(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, form and the transformed text of every row, assembled from the same pieces.

    Rows and nulls as in ``transformed``; the output of a plain document is its text.
    """
    made = assembled(pieces(docs, seed, plain=True))
    fields = T.StructType([made.schema["doc_id"], T.StructField("form", T.StringType()), T.StructField("output", T.StringType())])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []

        def one() -> pa.RecordBatch:
            columns = zip((head[2], head[4], b"".join(held).decode()), arrow)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in columns], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] >= 0:
                    held.append(row[-1])
                    continue
                if head is not None:
                    yield one()
                head, held = row, []
        if head is not None:
            yield one()

    return made.mapInArrow(run, fields)


_SPACED = r"\x20\x09-\x0D"


@query(rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[{_SPACED}]*[^{_SPACED}]+|[{_SPACED}]+') AS units,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d
), f AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM f
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
""")
def op12_fill_in_middle(spark, sf_dir):
    return transformed(documents(spark, sf_dir))
