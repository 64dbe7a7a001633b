"""Fill-in-the-middle against a plain version, and edges."""

import hashlib
import random
import re

import pytest

from tracewell.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < 80
    output = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if spm else "psm", len(p), len(m), output


def texts():
    rng = random.Random(4)
    words = ["a", "é", "日本", "x" * 90, "<P", ">", "\u0085", "q\x00r", "😀"]
    gaps = [" ", "\n", "\t \r\n", "\x0b", "\x0c  "]
    made = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    made += [" " + t + "end" for t in made[:20]]
    made += ["", None, " ", "\n\n", "one", " one", "one ", "has <M> inside", "é" * 70_000, "w " * 50_000, " " * 80_000 + "z"]
    return made


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts()))
    return found + [(i + 1000, t) for i, t in found] + [(None, "a b c d"), (None, "a b c d"), (7, "again and again"), (7, "again and again")]


def test_digests_and_outputs(spark, rows):
    frame = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id long, row int, form string").repartition(5)
    want = sorted(
        (str(i), n, f, str(a), str(b), hashlib.sha256(o.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
        for n, f, a, b, o in [plain_version(i, t)]
    )
    got = fim.transformed(frame).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted((str(r[0]), r[1], r[2], str(r[3]), str(r[4]), r[5], r[6]) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    outputs = fim.outputs(frame).collect()
    assert sorted((str(r.doc_id), r.form, r.output) for r in outputs) == sorted((str(i), plain_version(i, t)[1], plain_version(i, t)[4]) for i, t in rows)


def test_no_rows_and_string_ids(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transformed(frame).count() == 0 and fim.outputs(frame).count() == 0
    named = spark.createDataFrame([("a", "x y z"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id: r.n for r in fim.transformed(named).collect()} == {"a": 3, "b": 0}


def test_one_shuffle(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = fim.transformed(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 1
