"""Hard negatives against all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import hard_negatives
from shelfmark.llm.hilbert import hilbert_places

SCHEMA = "vec_id bigint, embedding array<double>, label int, slice string, part string, vec string"


def brute(rows, anchor, positives=5, negatives=10, window=(30, 90)):
    first = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        key = (str(label), len(whole), np.array(whole, np.int64).tobytes())
        if i not in first or key < first[i][0]:
            first[i] = (key, whole, label)
    out = []
    for a, (_, v, label) in first.items():
        if not anchor(a):
            continue
        score = {b: sum(map(int.__mul__, v, w)) for b, (_, w, _) in first.items() if len(w) == len(v) and b != a}
        near = sorted((b for b in score if first[b][2] == label), key=lambda b: (-score[b], b))[:positives]
        for p in near:
            ok = [b for b in score if first[b][2] != label and window[0] * score[p] <= 100 * score[b] <= window[1] * score[p]]
            for rank, b in enumerate(sorted(ok, key=lambda b: (-score[b], b))[:negatives], 1):
                out.append((a, p, rank, b, score[p], score[b]))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA).repartition(3)


def mined(spark, rows, **options):
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 7 == 0, **options)
    return sorted(map(tuple, got.collect()))


def cloud(rng, n, dim, labels, spread):
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middle)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("axes, bits", [(1, 3), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(axes, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    place = hilbert_places(points, bits)
    assert sorted(place) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_all_pairs(spark, spread, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rows = cloud(random.Random(8), 400, 6, 4, spread)
    want = brute(rows, lambda i: i % 7 == 0)
    assert mined(spark, rows) == want and len(want) > 100


def test_small_cells_give_the_same(spark, monkeypatch):
    rows = cloud(random.Random(9), 300, 5, 3, 0.3)
    want = brute(rows, lambda i: i % 7 == 0)
    for name, value in {"SLICE": 40, "PART": 10, "ZONES": 2, "CHUNK": 4, "HELD": 5}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows) == want


def test_zone_maps_rule_blocks_out(spark):
    """Tight clusters far apart: most blocks can't meet the windows of an anchor."""
    rng = random.Random(10)
    rows = [(i, [(100.0 if j == i % 8 else 0.0) + rng.random() for j in range(8)], i % 8 // 2) for i in range(800)]
    blocks = hard_negatives.candidate_blocks(frame(spark, rows), block=20).collect()
    zones = [b for b in blocks if b.low is not None]
    assert len(blocks) == 800 and len({(b.slice, b.block) for b in blocks}) == len(zones) >= 40
    for z in zones:
        own = np.array([np.frombuffer(b.vec, np.int64) for b in blocks if (b.slice, b.block) == (z.slice, z.block)])
        assert (own.min(axis=0) == np.frombuffer(z.low, np.int64)).all() and (own.max(axis=0) == np.frombuffer(z.high, np.int64)).all()
    tight = sum((np.frombuffer(z.high, np.int64) - np.frombuffer(z.low, np.int64)).max() < 5000 for z in zones)
    assert tight > len(zones) / 2
    assert mined(spark, rows) == brute(rows, lambda i: i % 7 == 0)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-50, 50, (20, 7)), rng.integers(-50, 50, (30, 7))
    low, high = hard_negatives._bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
    score = a @ b.T
    assert (score >= low).all() and (score <= high).all()


def test_edges(spark):
    rng = random.Random(12)
    rows = cloud(rng, 120, 4, 3, 0.5)
    rows += [(i + 500, list(rows[7][1]), rows[7][2]) for i in range(60)]  # copies: ties by id
    rows += [rows[14], rows[14], (21, [9.0, 9.0, 9.0, 9.0], 0), (28, [1.0, 1.0, 1.0, 1.0], 5)]
    rows += [(700, None, 1), (701, [1.0, None, 0.0, 0.0], 1), (702, [float("nan")] * 4, 1), (703, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (707, [1.0] * 4, None)]
    rows += [(i + 800, [rng.gauss(0, 1), rng.gauss(0, 1)], i % 2) for i in range(40)]  # another length
    rows += [(i + 900, [], i % 2) for i in range(15)] + [(i + 950, [0.0] * 4, i % 3) for i in range(15)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 7 == 0)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(1, [1.0], 1)]) == []


def test_large_components(spark):
    rng = random.Random(13)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**20, rng.uniform(0, 1) * 2.0**20], i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 7 == 0)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(i, [2.0**40, 2.0**40], i % 2) for i in range(10)])
