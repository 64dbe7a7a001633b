"""Static binary fuse filters: immutable sets of 64-bit keys with 16-bit fingerprints, about 18 bits a key.

Each key has three slots, one in each of three neighbouring segments; the exclusive or of the three
slots is its fingerprint. A key of the set is always found; another is found once in 65 536 times.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_TRIES = 200


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well spread 64-bit values of the keys under a seed."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Fuse:
    seed: int
    segment: int  # slots of a segment, a power of two
    starts: int  # segments in which a key's first slot may lie
    slots: bytes  # little-endian 16-bit values

    def places(self, h: np.ndarray) -> np.ndarray:
        """The three slots of each hash value, one row per key."""
        first = ((h >> np.uint64(32)) * np.uint64(self.starts * self.segment)) >> np.uint64(32)
        inner = np.uint64(self.segment - 1)
        low = first & inner
        second = first - low + np.uint64(self.segment) + (low ^ ((h >> np.uint64(16)) & inner))
        third = first - low + np.uint64(2 * self.segment) + (low ^ (h & inner))
        return np.stack([first, second, third], axis=1).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots = np.frombuffer(self.slots, "<u2")
        if not len(slots):
            return np.zeros(len(keys), bool)
        h = mix(keys, self.seed)
        at = self.places(h)
        return (slots[at[:, 0]] ^ slots[at[:, 1]] ^ slots[at[:, 2]]) == _mark(h)


def _mark(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(40))) & np.uint64(0xFFFF)).astype(np.uint16)


def _order(at: np.ndarray, n_slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that only this key still uses), or None if some keys stay."""
    n = len(at)
    used = np.bincount(at.ravel(), minlength=n_slots)
    total = np.zeros(n_slots, np.int64)  # of the numbers of the keys that use a slot
    np.add.at(total, at.ravel(), np.repeat(np.arange(n), 3))
    free, left, rounds = np.flatnonzero(used == 1), n, []
    while len(free):
        keys, first = np.unique(total[free], return_index=True)
        rounds.append((keys, free[first]))
        left -= len(keys)
        touched = at[keys].ravel()
        np.subtract.at(used, touched, 1)
        np.subtract.at(total, touched, np.repeat(keys, 3))
        touched = np.unique(touched)
        free = touched[used[touched] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> Fuse:
    """The filter of the distinct values among ``keys``; empty keys give a filter that holds nothing."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return Fuse(0, 1, 1, b"")
    log_n = math.log(max(n, 2))
    segment = 1 << min(18, max(2, math.floor(log_n / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / log_n)
    for seed in range(1, _TRIES):
        starts = max(1, math.ceil(n * factor / segment) - 2)
        made = Fuse(seed, segment, starts, b"")
        h = mix(keys, seed)
        at = made.places(h)
        rounds = _order(at, (starts + 2) * segment)
        if rounds is not None:
            slots, marks = np.zeros((starts + 2) * segment, np.uint16), _mark(h)
            for own, slot in reversed(rounds):
                # The own slot is still zero, so the exclusive or of all three is that of the others.
                three = at[own]
                slots[slot] = marks[own] ^ slots[three[:, 0]] ^ slots[three[:, 1]] ^ slots[three[:, 2]]
            return Fuse(seed, segment, starts, slots.astype("<u2").tobytes())
        factor *= 1.02
    raise RuntimeError(f"no filter for {n} keys after {_TRIES} seeds")
