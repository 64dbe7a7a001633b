"""Hashes of word runs of UTF-8 texts."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
#: Translates A-Z to a-z and nothing else; bytes of longer characters are never in that range.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def single_spaced(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased words [^\\x20\\x09-\\x0D]+ with one space between them; start and end byte of each."""
    body = b" ".join((text or "").encode().translate(LOWER).split())  # split() cuts at these six characters
    if not body:
        return body, np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.frombuffer(body, np.uint8) == 0x20)
    return body, np.append(0, at + 1), np.append(at, len(body))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, of all words if there are fewer; empty if there are none."""
    body, starts, ends = single_spaced(text)
    if not len(starts):
        return np.empty(0, np.uint64)
    n = max(1, len(starts) - size + 1)
    hashed, firsts, lasts = xxhash.xxh64_intdigest, starts[:n].tolist(), ends[-n:].tolist()
    return np.fromiter((hashed(body[s:e], SEED) for s, e in zip(firsts, lasts)), np.uint64, n)
