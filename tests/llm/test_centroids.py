"""Centroid clustering against a plain version, bounds and the curve."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from tracewell.llm import centroids as C


def plain_version(rows, dimensions, scale, k, rounds):
    def ok(v):
        return v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)

    kept = [(i, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)) for i, v in rows if ok(v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), centres


def some_rows(seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.25] * 6) for i in range(400, 700)]  # one very common vector
    rows += [(700, [float("nan")] + [0.0] * 5), (701, [float("inf")] + [0.0] * 5), (702, [None] + [0.0] * 5), (703, [0.0] * 5)]
    rows += [(704, None), (705, []), (None, [1.0, 2.0, 3.0, 1.0, 1.0, 1.0]), (5, [-3.0] * 6), (5, [-3.0] * 6)]
    return rows


@pytest.mark.parametrize("k,rounds,block", [(8, 10, 512), (5, 3, 16), (3, 0, 64)])
def test_rounds(spark, monkeypatch, k, rounds, block):
    rows = some_rows(k)
    frame = spark.createDataFrame([(v, i, 1, 1) for i, v in rows], "embedding array<float>, vec_id long, cluster int, key int").repartition(3)
    got, centres = C.clustered(frame, dimensions=6, scale=64, k=k, rounds=rounds)
    want, expected = plain_version(rows, 6, 64, k, rounds)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert centres.tolist() == expected


def test_fewer_vectors_than_centroids_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "vec_id long, embedding array<double>")
    got, centres = C.clustered(frame, dimensions=2, k=8)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0), (2, 0, 0)] and len(centres) == 2
    none, centres = C.clustered(frame.limit(0), dimensions=2)
    assert none.count() == 0 and len(centres) == 0
    huge = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        C.clustered(huge, dimensions=2)


def test_candidates_hold_every_nearest():
    rng = np.random.default_rng(3)
    fewer = 0
    for _ in range(300):
        values = rng.integers(-50, 50, (40, 4)) + rng.integers(-200, 200, 4)
        centres = rng.integers(-250, 250, (6, 4))
        centres[5] = centres[2]  # ties
        which = C.candidates(values.min(axis=0), values.max(axis=0), centres)
        every = C.nearest(values, centres, np.arange(6))
        some = C.nearest(values, centres, which)
        assert (every[0] == some[0]).all() and (every[1] == some[1]).all()
        fewer += len(which) < 6
    assert fewer > 200


@pytest.mark.parametrize("dimensions,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = [k.tobytes() for k in C.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
