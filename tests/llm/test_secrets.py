"""Base findings against Python's engine, and which weak candidates are linked."""

import re

from tracewell.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = [("assign", ASSIGN, 6, 2), ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def brute(text):
    found = []
    for rank, (kind, pattern, least, group) in enumerate(BASE):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(k, a, b) for a, _, k, b in sorted(found)]


KEY = "AKIA" + "ABCDEFGH12345678"
OPAQUE = "abcDEF123/ghiJKL456+mnoPQR789stu"
TEXTS = [
    "password = hunter22", "secret=token:abcdefgh", "TOKEN='a' token: \"abcdef\"", "é🙂 api_key=12345é password=123456", KEY, KEY + "9",
    "AKIAAKIA" + "Z" * 15, "AKIA" + "Z" * 15, "f" * 23, "f" * 24, "x" + "0123456789abcdef" * 3, "", None, "paſſword=abcdefg",
    "toKen=abcdefg", "token=" + "a" * 60_000, "Secret  :  =abcdef", "passwordpassword=abcdef", "token==abcdef",
]


def test_base_spans(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 2), (None, TEXTS[1], 1), (None, "nothing", 1)]
    got = secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string, kind int")).collect()
    own = [(str(r.doc_id), [(s.kind, s.start, s.stop) for s in r.spans if s.kind in secrets.BASE]) for r in got]
    assert sorted(own) == sorted((str(i), brute(t)) for i, t, _ in rows)


def test_weak_parts_need_their_complement(spark):
    gap = " " * (secrets.REACH + 1)
    cases = {
        1: (f"login: alice {OPAQUE}", {"ident", "opaque"}),
        2: (f"login: alice{gap}{OPAQUE}", set()),
        3: (OPAQUE, set()),
        4: (f"{KEY} and {OPAQUE}", {"access", "opaque"}),
        5: ("login: alice https://db.example.com/x", set()),
        6: (f"https://db.example.com/x login: alice {OPAQUE}", {"ident", "opaque", "endpoint"}),
        7: ("login: alice password=hunter22", {"ident", "assign"}),
        8: (f"{OPAQUE}{gap}{OPAQUE} user=bob", {"ident", "opaque"}),
    }
    frame = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scanned(frame).collect()}
    assert {k: {s.kind for s in v} for k, v in got.items()} == {k: kinds for k, (_, kinds) in cases.items()}
    assert [s.kind for s in got[8]] == ["opaque", "ident"]


def test_no_rows(spark):
    assert secrets.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
