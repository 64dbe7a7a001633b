"""One row of each SimHash component stays."""

import random

from tests.llm.test_simhash import brute_classes, brute_print
from tracewell.llm import simhash


def kept_by_force(rows):
    least = brute_classes({p: p for p in (brute_print(t) for _, t in rows)})
    best = {}
    for doc_id, text in rows:
        of, own = least[brute_print(text)], (doc_id is None, doc_id or 0)
        best[of] = min(best.get(of, own), own)
    return sorted(best.values())


def test_copies_edits_and_clashing_columns(spark):
    rng = random.Random(21)
    rows = []
    for _ in range(12):
        words = [f"v{rng.randrange(500)}" for _ in range(rng.choice((3, 60, 900)))]
        for _ in range(5):
            edited = list(words)
            for _ in range(rng.randrange(3)):
                edited[rng.randrange(len(words))] = "edit"
            rows.append((len(rows), rng.choice(" \n").join(edited)))
    rows += [(500, None), (501, ""), (None, rows[0][1]), (None, "only here, twice"), (None, "only here, twice"), (7, rows[7][1]), (7, rows[7][1])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(t, i, 1, "p", "d") for i, t in rows], "text string, doc_id long, row int, print string, doc string").repartition(4)
    got = simhash.representatives(frame)
    assert got.columns == frame.columns
    have = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    assert have == kept_by_force(rows) and len(have) < len(rows) - 10


def test_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, extra string")
    assert simhash.representatives(frame).count() == 0
