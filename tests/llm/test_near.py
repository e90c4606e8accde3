"""Near-duplicate classes, components and vector links against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import bagminhash, metric_join, near
from shelfmark.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"


def bag(text):
    w = re.findall(WORD, text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def classes(rows):
    rows = [r for r in rows if r[0] is not None]
    sets, bags = Sets([i for i, _ in rows]), [bag(t) for _, t in rows]
    for x in range(len(rows)):
        for y in range(x):
            same = (rows[x][1] or "") == (rows[y][1] or "")
            if same or similarity(bags[x], bags[y]) >= 0.8:
                sets.join(rows[x][0], rows[y][0])
    return {i: sets.find(i) for i, _ in rows}


def test_registers_agree_as_often_as_weighted_jaccard():
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        a = [f"w{rng.randrange(15)}" for _ in range(rng.choice([20, 100]))] * rng.choice([1, 1, 3, 9])
        b = a[: len(a) * 3 // 4] if rng.random() < 0.4 else list(a)
        for _ in range(rng.randrange(0, 9)):
            b[rng.randrange(len(b))] = "zz"
        texts += [" ".join(a), " ".join(b)]
    signature, full = bagminhash.signatures(pa.array(texts))
    error = [(signature[i] == signature[i + 1]).mean() - similarity(bag(texts[i]), bag(texts[i + 1])) for i in range(0, 300, 2)]
    assert full.all() and abs(np.mean(error)) < 0.01 and np.std(error) < 0.05


def test_classes_are_those_of_brute_force(corpus_docs, corpus):
    found = {r.doc_id: (r.class_id, r.kept) for r in bagminhash.duplicates(corpus_docs).collect()}
    want = classes(corpus)
    assert found == {i: (c, c == i) for i, c in want.items()}


def test_edges(edge, nothing):
    found = bagminhash.duplicates(edge).collect()
    assert len(found) == edge.count()
    want = classes([(r.doc_id, r.text) for r in edge.collect()])
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == want
    assert [(r.class_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]
    assert bagminhash.duplicates(nothing).count() == 0
    kept = bagminhash.without_duplicates(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    assert bagminhash.without_duplicates(nothing).count() == 0


def test_large_buckets_are_sliced(spark, monkeypatch):
    """Families that share much text but not enough: buckets with many components, some of them linked."""
    monkeypatch.setattr(near, "SLICE", 8)
    rng = random.Random(9)
    shared = [f"s{rng.randrange(1000)}" for _ in range(200)]
    rows = []
    for i in range(60):
        own = [f"o{i // 2}x{k}" for k in range(80)]
        text = shared + own
        text[rng.randrange(len(text))] = f"t{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in bagminhash.duplicates(docs).collect()}
    assert found == classes(rows)
    assert len(set(found.values())) > 1


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [],
    }[shape]
    sets = Sets(range(100))
    for a, b in edges:
        sets.join(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {n: sets.find(n) for e in edges for n in e if e[0] != e[1] or n in {x for f in edges if f[0] != f[1] for x in f}}


def vectors(rng):
    rows, label = [], 0
    for label in (0, 1, 2, None):
        centres = [rng.normal(size=8) for _ in range(6)]
        for i in range(90):
            v = centres[i % 6] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3, 1.0])
            rows.append((v * rng.choice([1.0, 1e-3, 1e20])).astype(np.float32).tolist())
            rows[-1] = (len(rows), rows[-1], label, "extra")
    bad = [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [float("inf")] + [1.0] * 7, [1.0] * 3, [2.0] * 3, [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0]]
    return rows + [(1000 + i, v, 1, "extra") for i, v in enumerate(bad)] + [rows[5], (None, rows[5][1], 0, "extra")]


def brute_links(rows):
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {}
    for i, (a, u, p, _) in enumerate(rows):
        links[i] = []
        if a is None or p is None or not good(u):
            continue
        for j, (b, v, q, _) in enumerate(rows):
            if i == j or b is None or p != q or not good(v) or len(u) != len(v):
                continue
            x, y = np.array(u, float), np.array(v, float)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[i].append(j)
    return links


@pytest.mark.parametrize("cell, piece", [(2048, 8192), (8, 12)])
def test_vector_links(spark, monkeypatch, cell, piece):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "SLICE", piece)
    rows = vectors(np.random.default_rng(6))
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, key string").repartition(3)
    links = brute_links(rows)
    sets = Sets(range(len(rows)))
    for i, js in links.items():
        for j in js:
            sets.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[sets.find(i)] = min(least.get(sets.find(i), r[0]), r[0])
    want = sorted((r[0] or -1, len(links[i]), least.get(sets.find(i), -1)) for i, r in enumerate(rows))
    found = metric_join.near_vectors(docs).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in found) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)


def test_copies_reach_every_cell_in_range():
    rng = np.random.default_rng(8)
    x = metric_join.unit(rng.normal(size=(400, 6)) + 2 * np.eye(6)[rng.integers(0, 6, 400)])
    pivots, reach = x[:12], 0.2
    home, close = metric_join.cells_of(x, pivots, reach)
    a, b = np.nonzero(np.linalg.norm(x[:, None] - x[None], axis=2) <= reach)
    assert close[b, home[a]].all() and not close.all()


def test_copies_reach_cells_of_equal_pivots():
    rng = np.random.default_rng(12)
    x = metric_join.unit(rng.normal(size=8) * rng.uniform(0.1, 10, (300, 1)))
    home, close = metric_join.cells_of(x, x[:40], 0.2)
    assert close[:, np.unique(home)].all()
    assert len(metric_join.directions(x[:40])) == 1


def test_scaled_copies_of_a_vector_link(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 4)
    rng = np.random.default_rng(13)
    one = rng.normal(size=8)
    rows = [(i, (one * rng.uniform(0.1, 10)).astype(np.float32).tolist(), 0) for i in range(200)]
    rows += [(200 + i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(100)]
    links = brute_links([(*r, None) for r in rows])
    found = metric_join.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.n_links for r in found} == {i: len(js) for i, js in links.items()}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert metric_join.near_vectors(empty).count() == 0
