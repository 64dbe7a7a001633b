"""SimHash classes against all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import simhash
from tracewell.llm.components import components

WORD_BREAKS = {c: " " for c in map(chr, [0x20, *range(9, 14)])}


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate(str.maketrans(WORD_BREAKS)).split(" ") if w]
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """The least key reachable over links of at most two bits."""
    least = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


TEXTS = ["a b c d", "A\tb\nc  d", "", None, "   ", "one two", "É b c d", "é b c d", "x" * 50_000, "w " * 3000, "a b c\u0085d e"]


def test_prints_and_classes(spark):
    base = [f"w{i}" for i in range(400)]
    near = [" ".join(base[:k] + ["zz"] + base[k:]) for k in (0, 1, 200, 399)]
    texts = TEXTS + [" ".join(base)] + near
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, print string")
    got = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r.print % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_classes(prints)


@pytest.mark.parametrize("crowd", [512, 2])
def test_links_are_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(40)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(f, v) for v in signed for f in (0, 5)], "family long, print long")
    rows = simhash.links(frame).collect()
    got = [tuple(sorted(r[1:])) for r in rows if r.family == 5]
    assert len(rows) == 2 * len(got)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string, component_id string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", None), (None, "a b c", None), (7, "a b c", None), (7, "a b c", None), (None, "q r s", None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).orderBy(F.col("doc_id")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7")] * 2 + [("None", "7")] * 2 + [("None", "None")]


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(1, 300)] + [(1000, 1000), (None, 3), (900, 800), (800, 900)]
    got = components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()
    want = {(i, 1) for i in range(1, 301)} | {(800, 800), (900, 800)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
