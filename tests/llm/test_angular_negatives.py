"""Hard negatives by angular bounds beside scoring every pair."""

import math

import numpy as np
import pyarrow as pa
import pytest

from groundwell.llm import angular_negatives as an


def brute(rows, every=100, k=5):
    kept = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in v) >= 2**56:
            continue
        label = (label + 1) % 10 if key % 7 == 0 else label
        kept[key] = min(kept.get(key, (label, v)), (label, v))
    ids = sorted(kept)
    out = []
    for a in ids:
        if a % every:
            continue
        label, v = kept[a]
        score = {b: sum(x * y for x, y in zip(v, kept[b][1])) for b in ids if b != a}
        first = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in first if kept[b][0] == label][:k]:
            fit = [b for b in first if kept[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]]
            out += [(a, p, i + 1, b, score[p], score[b]) for i, b in enumerate(fit[:k])]
    return sorted(out)


def clusters(seed, n, dims=8, middles=12, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(middles, dims))
    v = middle[rng.integers(0, middles, n)] * rng.uniform(0.2, 2, (n, 1)) + rng.normal(size=(n, dims)) * spread
    return v, rng.integers(0, 10, n)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(r[1], "x", r[0], r[2], 1, 2) for r in rows], "emb array<double>, text string, vec_id long, label int, score int, block int")
    return sorted(tuple(r) for r in an.mine(df, vector="emb", **more).collect())


@pytest.mark.parametrize("blocks", [False, True])
def test_equals_scoring_every_pair(spark, monkeypatch, blocks):
    if blocks:  # many blocks, lots and windows
        for name, value in (("BLOCK_ROWS", 60), ("WINDOW_ROWS", 8), ("LOT_ANCHORS", 4), ("CHUNK_BLOCKS", 7), ("LABEL_GROUPS", 3)):
            monkeypatch.setattr(an, name, value)
    v, label = clusters(1, 900)
    rows = [(i, x.tolist(), int(l)) for i, (x, l) in enumerate(zip(v, label))]
    rows += [(2000 + i, rows[100][1], 3) for i in range(70)]  # copies of an anchor: ties
    rows += [(3000, [0.0] * 8, 1), (3100, None, 1), (3200, [1.0, None] + [0.0] * 6, 2), (3300, [float("nan")] * 8, 2), (3400, [1.0] * 8, None),
             (None, [1.0] * 8, 1), (3500, [1e30] * 8, 1), (3600, [0.5] * 3, 4), (3700, [], 4), rows[200], rows[200], (300, [9.0] * 8, 9)]
    assert mined(spark, rows) == brute(rows) and brute(rows)


def test_spread_evenly_and_empty(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16))
    rows = [(i, (x / np.linalg.norm(x)).tolist(), int(i * 7 % 10)) for i, x in enumerate(v)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1), (200, [2.0], 1)]) == []


def test_bounds_hold_and_windows_are_spared():
    v, label = clusters(5, 4000, dims=16, middles=16)
    v = np.floor(v * 256).astype(np.int64)
    to = an.directions(v[:500].astype(float), 16)
    norm, angle = an.angles(v, to)
    low, high = an.score_bounds(angle[:50], norm[:50], angle, angle, norm, norm)
    exact = v[:50] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    rows = {"id": np.arange(4000), "label": np.zeros(4000, np.int64), "v": v, "norm": norm, "angle": angle}
    asks = {k: x[:50] for k, x in rows.items()} | {"low": np.full((50, 1), an._LOW), "high": np.full((50, 1), an._HIGH)}
    who, _, ids, score, scored = an.best(asks, rows, 5, True)
    assert scored < 0.35 * 50 * 4000  # clusters: most windows are out of reach of the fifth best
    for a in range(50):
        order = np.lexsort((np.arange(4000), -exact[a]))
        assert ids[who == a].tolist() == [i for i in order if i != a][:5]


def test_large_integers_are_exact():
    a = np.array([[2**27, 3], [1, 1]], dtype=np.int64)
    assert an.products(a, a, 2.0**55).tolist() == [[2**54 + 9, 2**27 + 3], [2**27 + 3, 2]]
    assert an.padded(pa.array([[1, 2], [3]], pa.list_(pa.int64())), 3).tolist() == [[1, 2, 0], [3, 0, 0]]
