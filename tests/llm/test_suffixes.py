"""Suffix dedup against all strings, crowds, and the loser tree."""

import os
import random

import numpy as np
import pytest

from tracewell.llm import suffixes
from tracewell.llm.loser_tree import merged


def by_force(rows, length):
    least = {}
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for doc_id, body in bodies:
        if doc_id is not None:
            for at in range(len(body) - length + 1):
                s = body[at : at + length]
                least[s] = min(doc_id, least.get(s, doc_id))
    out = []
    for doc_id, body in bodies:
        gone = bytearray(len(body))
        for at in range(len(body) - length + 1) if doc_id is not None else ():
            if least[body[at : at + length]] < doc_id:
                gone[at : at + length] = b"\x01" * length
        spans, at = [], 0
        while at < len(gone):
            end = at
            while end < len(gone) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((str(doc_id), len(body), spans, bytes(b for b, g in zip(body, gone) if not g)))
    return sorted(out)


def some_rows(seed):
    rng = random.Random(seed)

    def fresh(n):
        return "".join(rng.choice("abcdé \n") for _ in range(n))

    passages = [fresh(n) for n in (30, 49, 50, 51, 64, 200, 700)]
    rows = []
    for i in range(60):
        parts = [fresh(rng.randrange(80)) for _ in range(3)]
        rows.append((i, "".join(p + rng.choice(passages) for p in parts) + fresh(rng.randrange(30))))
    near = fresh(900)
    rows += [(100 + i, near[: 40 * i] + "#" + near[40 * i :]) for i in range(20)]
    rows += [(200 + i, near) for i in range(5)] + [(90, near), (90, near + "x")]
    rows += [(300, ""), (301, None), (302, "a" * 500), (303, "a" * 300), (304, "ab" * 200), (305, "b" + "ab" * 100), (306, "a" * 49)]
    rows += [(None, near), (None, passages[-1]), (-5, passages[-1] + "\x00" * 80), (310, "\x00" * 90), (7, passages[-1]), (7, passages[-1])]
    rows += [(400, fresh(3000) + passages[5]), (401, passages[5] + fresh(3000))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,slab,crowd,length", [(1, 8 << 20, 4096, 50), (2, 3000, 4, 50), (3, 1, 1, 50), (4, 6000, 20, 32), (5, 4000, 8, 75)])
def test_against_all_strings(spark, seed, slab, crowd, length, monkeypatch):
    rows = some_rows(seed)
    if seed % 2:
        monkeypatch.setattr(suffixes, "PART_SUFFIXES", 300)
        monkeypatch.setattr(suffixes, "BUCKET_GRAMS", 500)
    frame = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, kept string, slab int").repartition(4)
    got = suffixes.without_repeats(frame, length, slab, crowd).collect()
    have = sorted((str(r.doc_id), r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept)) for r in got)
    assert have == by_force(rows, length)
    assert sum(len(r[2]) for r in have) > 60


def test_no_rows_and_refused_ids(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    assert suffixes.without_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).count() == 2
    with pytest.raises(ValueError):
        suffixes.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_anchors_depend_on_the_string_only():
    rng = random.Random(6)
    body = "".join(rng.choice("ab ") for _ in range(400)).encode()
    spread = [b"x" * 37 + body, body, b"yz" * 300 + body]

    def strings(texts):
        slab = suffixes.Slab(list(range(len(texts))), [len(t) for t in texts], suffixes._press(np.frombuffer(b"".join(texts), np.uint8)), 50)
        at, low, high, h = slab.anchors()
        found = {}
        data = slab.body.tobytes()
        for a, lo, hi, g in zip(at.tolist(), low.tolist(), high.tolist(), h.tolist()):
            for back in range(lo, hi + 1):
                assert 0 <= back <= 34
                found.setdefault(data[a - back : a - back + 50], set()).add((back, g))
        return found, sum((high - low + 1).tolist())

    found, n = strings(spread)
    assert n == sum(len(t) - 49 for t in spread)
    assert all(len(v) == 1 for v in found.values())


def test_loser_tree():
    rng = random.Random(9)
    for k in (1, 2, 3, 7, 16):
        every = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
        runs = [sorted(every[i::k]) for i in range(k)]
        shared = [[0, *(len(os.path.commonprefix([a, b])) for a, b in zip(r, r[1:]))] for r in runs]
        run, prefix = merged(runs, shared)
        at = [0] * k
        out = []
        for r in run.tolist():
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(every)
        assert prefix.tolist() == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:]))]
    assert len(merged([], [])[0]) == 0
