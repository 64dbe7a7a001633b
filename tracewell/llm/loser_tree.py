"""Merge of sorted runs of byte strings by a loser tree that knows common prefixes."""

from __future__ import annotations

import numpy as np


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, prefix shared with the one before) of each string in sorted order.

    Each run is sorted, its strings are equally long, and ``shared`` has the bytes each shares with the one before
    in its run. Every string in the tree knows how many bytes it shares with the last winner. Of two, the one
    that shares more comes first and the other keeps its number; only at the same number bytes are compared, from
    there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    runs, shared = runs + [[]] * (width - len(runs)), shared + [[]] * (width - len(shared))
    now = [r[0] if r else b"" for r in runs]
    known = [0 if r else -1 for r in runs]  # -1 for a run that has ended, which loses to all
    place = [0] * width
    tree = [0] * width

    def first(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns how many bytes it shares with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        from_ = known[a]
        if from_ < 0:
            return a, b
        x, y = now[a][from_:], now[b][from_:]
        if x > y:
            a, b = b, a
        apart = (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()
        known[b] = len(now[b]) - (apart + 7) // 8
        return a, b

    level = list(range(width))
    node = width
    while len(level) > 1:
        node //= 2
        played = [first(a, b) for a, b in zip(level[::2], level[1::2])]
        tree[node : node + len(played)] = [loser for _, loser in played]
        level = [winner for winner, _ in played]
    best = level[0]
    out_run, out_shared = [], []
    while known[best] >= 0:
        out_run.append(best)
        out_shared.append(known[best])
        at = place[best] = place[best] + 1
        if at < len(runs[best]):
            now[best], known[best] = runs[best][at], shared[best][at]
        else:
            known[best] = -1
        node = (width + best) >> 1
        while node:
            other = tree[node]
            if known[best] <= known[other]:
                best, tree[node] = first(best, other)
            node >>= 1
    return np.array(out_run, np.int64), np.array(out_shared, np.int64)
