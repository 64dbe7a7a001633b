"""Spans of shared passages cover every word that two texts share in runs of 51 words or more."""

import random

import numpy as np
import pyarrow as pa

from tracewell.llm import passages


def fresh(rng, n):
    return [f"v{rng.randrange(1_000_000)}" for _ in range(n)]


def test_spans_cover_shared_passages(spark):
    rng = random.Random(3)
    rows, shared = [], {}
    for n in (51, 60, 120, 200, 700):
        passage = fresh(rng, n)
        for copy in range(3):
            before = fresh(rng, 70 + copy)
            inner = list(passage)
            if copy == 2 and n > 110:
                inner[n // 2] = "edit"
            shared[len(rows)] = (70 + copy, 70 + copy + n, n // 2 if copy == 2 and n > 110 else None)
            rows.append((len(rows), " ".join(before + inner + fresh(rng, 80))))
    # The middle of a passage stands in an earlier text, too.
    passage = fresh(rng, 90)
    rows.insert(0, (-1, " ".join(fresh(rng, 50) + passage[30:60] + fresh(rng, 50))))
    for _ in range(2):
        shared[len(rows) - 1] = (40, 130, None)
        rows.append((len(rows) - 1, " ".join(fresh(rng, 40) + passage + fresh(rng, 40))))
    text = dict(rows)
    got = [r for r in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kind == "block"]
    covered = {}
    classes = {}
    for r in got:
        words = text[r.doc_id][r.start : r.stop].split()
        assert len(words) == r.n_words
        classes.setdefault(r.class_id, set()).add(" ".join(words))
        first = len(text[r.doc_id][: r.start].split())
        covered.setdefault(r.doc_id, set()).update(range(first, first + r.n_words))
    assert all(len(c) == 1 for c in classes.values())
    assert len(classes) == sum(r.kept for r in got)
    for doc, (a, b, changed) in shared.items():
        expected = set(range(a, b)) - ({a + changed} if changed else set())
        assert expected <= covered[doc], (doc, sorted(expected - covered[doc]))
        assert len(covered[doc]) <= b - a + 2
    # A passage is one span, or one on either side of an edited word.
    assert {r.n_words for r in got if r.doc_id == 12} == {700, 350, 349}


def covered(got):
    out = {}
    for r in got:
        if r.kind == "block" and not r.kept:
            out.setdefault(r.doc_id, []).append((r.start, r.stop))
    return out


def test_later_places_are_covered_whole(spark, monkeypatch):
    """Every 51 words that stood earlier are in spans kept elsewhere, with crowded seeds or without; copies are not compared word by word."""
    rng = random.Random(21)
    base, line = fresh(rng, 260), fresh(rng, 60)
    texts = [" ".join(base)] * 30
    for _ in range(14):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = fresh(rng, rng.randrange(1, 3))
        cut = rng.randrange(60)
        texts.append(" ".join(fresh(rng, rng.randrange(40)) + words[cut : cut + rng.randrange(70, 200)] + fresh(rng, 30)))
    texts += [" ".join(fresh(rng, rng.randrange(50)) + line + fresh(rng, 40)) for _ in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes, plain = {}, passages.written

    def written(df, name):
        out = plain(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(passages, "written", written)
    found = []
    for many in (passages.MANY, 0):
        monkeypatch.setattr(passages, "MANY", many)
        spans = covered(passages.repeated(frame).collect())
        seen = set()
        for doc, text in enumerate(texts):
            words = text.split()
            starts = [0]
            for w in words:
                starts.append(starts[-1] + len(w) + 1)
            inside = {i for i in range(len(words)) for a, b in spans.get(doc, []) if a <= starts[i] and starts[i + 1] - 1 <= b}
            runs = [tuple(words[i : i + 51]) for i in range(len(words) - 50)]
            for i, run in enumerate(runs):
                assert run not in seen or inside >= set(range(i, i + 51)), (doc, i)
            seen.update(runs)
        found.append(spans.keys())
        if many:
            assert max(sizes[n] for n in ("places", "contexts")) < sum(len(t.split()) for t in texts) / 4
    assert found[0] == found[1]


def test_hashes_and_blocks_of_joined_texts():
    """Runs of words hash alike wherever they stand; blocks of texts taken together are those of each text alone."""
    rng = random.Random(8)
    texts = [fresh(rng, n) for n in (3, 16, 17, 49, 50, 51, 400)] + [["same"] * 90, fresh(rng, 30000)]

    def laid(texts):
        words = [w.encode() for t in texts for w in t]
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - [len(w) for w in words]
        return passages.run_hashes(np.frombuffer(b" ".join(words) + b" ", np.uint8), starts, ends)

    together = laid(texts)
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes) - sizes
    expected = []
    for first, text in zip(firsts, texts):
        own = laid([text])
        assert (together[first : first + len(own)] == own).all()
        places = own[: max(0, len(text) - passages.BLOCK + 1)].tolist()
        windows = [range(i, i + passages.REACH) for i in range(len(places) - passages.REACH + 1)] or ([range(len(places))] if places else [])
        expected += sorted({int(first) + min(w, key=lambda i: (places[i], i)) for w in windows})
    enough = sizes >= passages.BLOCK
    assert passages.block_starts(together, firsts[enough], sizes[enough]).tolist() == expected


def test_contexts_of_many_texts_share_a_batch():
    """Texts are not answered in a batch each; places are in code points of their own text."""
    rows = [(i, f"é{i}\n" + " ".join(fresh(random.Random(i), 80)), i) for i in range(300)]
    asked = [[{"u1": i, "word": 20, "right": right, "crowded": False} for right in (True, False)] for i in range(300)]
    kind = pa.list_(pa.struct([("u1", pa.int64()), ("word", pa.int32()), ("right", pa.bool_()), ("crowded", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*rows)), pa.array(asked, kind)], names=["doc_id", "text", "text_hash", "asked"])

    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([batch, batch])))

    got = passages.contexts(Docs())
    assert len(got) == 1 and got[0].num_rows == 600
    for r in got[0].to_pylist():
        text = rows[r["doc_id"]][1]
        words = text.split()
        assert r["body"].split() == (words[20:71] if r["right"] else words[:36])
        assert text[r["at"] :].startswith(r["body"])
