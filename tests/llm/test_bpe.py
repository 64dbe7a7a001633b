"""Encoding against the tokenizer library, exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from tracewell.llm import bpe, pretokens

PATH = public_tokenizers.path(bpe.RANKS)


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples(seed, n):
    rng = random.Random(seed)
    alphabet = list("''''strevmlde SDTx19 ½٣!?<|>  \n\t  \u0085\x1cé日本語ßñ\U0001f600́Ᲊ")
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(n)]


EDGE = ["", " ", "  ", "a  ", "'s's", " 's", "!'s", "''s", "'re've'll're", "'r", "'l l", "x'llx", "\n\n a", "a \n b", "a\n\nb", "'"]


def test_pieces_are_the_pattern_s():
    texts = EDGE + samples(3, 3000)
    first, last, owner = pretokens.starts(texts)
    joined = "".join(texts)
    got = [[] for _ in texts]
    for a, b, k in zip(first.tolist(), last.tolist(), owner.tolist()):
        got[k].append(joined[a:b])
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text, pieces in zip(texts, got):
        if "Ᲊ" not in text:  # a letter to newer Unicode tables only
            assert pieces == pattern.findall(text), repr(text)


def test_ids_are_the_library_s(monkeypatch):
    monkeypatch.setattr(bpe, "SLAB", 64)
    monkeypatch.setattr(bpe, "CACHED", 50)
    own, theirs = bpe.Vocabulary(PATH), library()
    long = ["ab" * 400, "q" * 3000, "word " * 200, "\n" * 500 + "x", "é" * 300]
    texts = EDGE + samples(4, 2000) + long
    for text, (ids, begins) in zip(texts, own.encode(texts)):
        want = theirs.encode_ordinary(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert own.decode(np.frombuffer(ids, "<u4")) == text.encode()
        cuts = [*begins.tolist(), len(text)]
        assert "".join(text[a:b] for a, b in zip(cuts, cuts[1:])) == text


def test_short_and_long_merges_agree():
    own, rng = bpe.Vocabulary(PATH), random.Random(1)
    for _ in range(400):
        piece = bytes(rng.choices(b"abcdethinons \xc3\xa9", k=rng.randint(1, 60)))
        assert bpe._merged_long(piece, own.ranks) == bpe._merged_short(piece, own.ranks)


def test_rows(spark):
    rows = [(1, "It's  here\n", "x"), (1, "It's  here\n", "x"), (None, None, None), (2, "", "y"), (3, "a b " * 40_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(frame, PATH).collect()
    assert len(got) == len(rows)
    theirs = library()
    for r in got:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert hashlib.sha256(bytes(r.ids)).hexdigest() == hashlib.sha256(np.array(theirs.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest()
        assert r.n_tokens == len(r.ids) // 4
    assert bpe.round_trip(frame.limit(0), PATH).count() == 0
    again = bpe.encoded(frame.drop("ids"), PATH).withColumn("back", bpe.decoded(F.col("ids"), PATH)).collect()
    assert all(bytes(r.back).decode() == (r.text or "") for r in again)
