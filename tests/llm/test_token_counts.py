"""Counts against the library, and splices of chunks."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from tracewell.llm import token_counts as tc

PATH = public_tokenizers.path(tc.FILE)
END = "<|endoftext|>"


def texts(n):
    rng = random.Random(8)
    parts = ["the ", "naïve", " ", "\n", "  ", END, "<|end", "oftext|>", "'s", "日本", "!?", "12", "\t\n", "x" * 30, " 's"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


def test_counts_are_the_library_s():
    library = Tokenizer.from_file(PATH)
    cases = ["", " ", END, f"a  {END}  b", f"{END}{END}", *texts(150)]
    want = [len(e) for e in library.encode_batch(cases, add_special_tokens=False)]
    assert tc.Counter(PATH).counts(cases) == want
    small = tc.Counter(PATH, huge=40, chunk=30, overlap=4)
    assert small.counts(cases) == want
    assert small.widened > 0


def test_a_text_without_stable_places():
    library, long = Tokenizer.from_file(PATH), "ab" * 700 + " " + "é1" * 300
    small = tc.Counter(PATH, huge=100, chunk=64, overlap=8)
    assert small.counts([long]) == [len(library.encode(long, add_special_tokens=False))]


def test_rows(spark):
    rows = [(1, "two words", 9), (1, "two words", 9), (None, None, None), (2, "", 0), (3, "a b " * 60_000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tc.counted(frame, PATH).collect()
    library = Tokenizer.from_file(PATH)
    assert [r.n_tokens for r in got] == [len(library.encode(r.text or "", add_special_tokens=False)) for r in got]
    assert len(got) == 5 and tc.counted(frame.limit(0), PATH).count() == 0
