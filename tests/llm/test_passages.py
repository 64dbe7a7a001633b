"""Paragraph classes against all pairs, blocks against shared runs of words, and the pipeline's group stage."""

import random

from tracewell.llm import passages, simhash
from tracewell.llm.verify import jaccard


def paragraph(rng, n):
    return [f"v{rng.randrange(100_000)}" for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "edit"
    return out


def texts():
    rng = random.Random(9)
    base = [paragraph(rng, 120) for _ in range(4)]
    rows = []
    for b in base:
        for n in (0, 0, 1, 2, 3):
            rows.append(" ".join(paragraph(rng, 30)) + "\n" + " ".join(edited(rng, b, n)) + "\n" + " ".join(paragraph(rng, 25)))
    shared = paragraph(rng, 51)
    for _ in range(3):
        rows.append(" ".join(paragraph(rng, 40) + shared + paragraph(rng, 40)))
    rows += ["", None, "short text", "same " * 5000, " ".join(paragraph(rng, 300))]
    return rows


def test_against_all_pairs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(0, texts()[0], "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = passages.repeated(frame).collect()
    found = {(r.doc_id, r.start): r.class_id for r in got if r.kind == "paragraph"}
    lines = {}
    for i, t, _ in rows:
        at = 0
        for line in (t or "").split("\n"):
            if len(line.split()) >= passages.LEAST_WORDS:
                lines[i, at] = line
            at += len(line) + 1
    for a in lines:
        for b in lines:
            if a < b and jaccard(lines[a], lines[b]) >= 0.8:
                assert found[a] == found[b]
    kept = [r for r in got if r.kept]
    assert len(kept) == len({(r.kind, r.class_id) for r in got})
    # 51 shared words have a block in common; a text of its own is left alone.
    blocks = {r.doc_id for r in got if r.kind == "block"}
    assert {20, 21, 22} <= blocks and 27 not in blocks and 27 not in {i for i, _ in found}
    for r in got:
        assert len(rows[r.doc_id][1][r.start : r.stop].split()) == r.n_words
    assert passages.repeated(frame.limit(0)).count() == 0


def test_tuned_bands():
    bands, rows = passages.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= passages.HASHES


def test_one_document_of_each_group(spark):
    rng = random.Random(4)
    rows, base = [], [paragraph(rng, 200) for _ in range(3)]
    for g, b in enumerate(base):
        for n in (0, 1, 2):
            rows.append((10 * g + n, " ".join(edited(rng, b, n)), "x"))
    rows += [(100, " ".join(paragraph(rng, 150)), "x"), (101, "", "x"), (102, None, "x"), (None, "lone words", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = simhash.representatives(frame)
    assert kept.columns == frame.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert {"0", "10", "20", "100", "101", "102", "None"} <= set(ids) and len(ids) <= 8
    assert simhash.representatives(frame.limit(0)).count() == 0


def test_crowded_buckets_in_blocks(spark, monkeypatch):
    """Small blocks connect the same paragraphs as one block does."""
    rng = random.Random(12)
    base = paragraph(rng, 90)
    rows = [(i, " ".join(edited(rng, base, rng.choice((1, 2, 3)))), "x") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")

    def classes():
        got = {}
        for r in passages.repeated(frame).filter("kind = 'paragraph'").collect():
            got.setdefault(r.class_id, set()).add(r.doc_id)
        return sorted(map(sorted, got.values()))

    whole = classes()
    monkeypatch.setattr(passages, "CROWD", 3)
    assert classes() == whole
    assert max(map(len, whole)) > 10
