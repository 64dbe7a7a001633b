"""Hits of item windows against a scan in Python."""

import re

from tracewell.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, named = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(10, len(w))
        for at in range(len(w) - size + 1) if w else ():
            for p in range(len(own) - size + 1):
                if own[p : p + size] == w[at : at + size]:
                    hit |= set(range(p, p + size))
                    named.add(item_id)
    return len(own), len(hit), sorted(str(i) for i in named if i is not None)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [
    (1, LONG, "k"), (10, "w3 W4, w5", "k"), (2, "the the the the the the the the the the the", "k"), (3, "", "k"), (4, None, "k"),
    (5, "...", "k"), (None, "lonely item", "k"), (7, "Été à l'É0", "k"), (1, LONG, "k"),
]
TEXTS = [
    LONG, "x " + " ".join(f"W{i}!" for i in range(5, 16)) + " y", "the " * 25, "", None, "?!", "w3-w4_w5", "été À l É0", "ÉTÉ à l é0",
    "a lonely  item", "w4 w5", "the " * 9, "pre " * 4000 + LONG + " post" * 4000,
]


def test_report_is_the_scan_s(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[1], "x"), (None, TEXTS[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, window string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string, key string")
    got = decontaminate.report(docs, items).collect()
    want = sorted((str(i), *brute(t, [x[:2] for x in ITEMS])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.items)) for r in got) == want
    assert all(sum(s["count"] for s in r.spans) == r.n_hit for r in got)
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(k[0] for k in want if k[2] == 0)


def test_the_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 3)
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert decontaminate.report(docs, items).head().n_hit == 30


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).head().n_hit == 0
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == 1
