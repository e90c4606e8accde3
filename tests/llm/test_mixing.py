"""The mix against its targets, the flow against enumeration."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing

WORD = r"[^\x20\x09-\x0D]+"


def test_targets_stop_at_three_times_a_size():
    assert mixing.capped_targets([100, 100], [1, 1]) == [100, 100]
    targets = mixing.capped_targets([10, 100, 1000], [5.0, 2.0, 1.0])
    assert targets[0] == 30 and targets[1] == 300 and sum(targets) == pytest.approx(1110)
    assert mixing.capped_targets([0, 0], [5.0, 2.0]) == [0.0, 0.0]
    assert mixing.capped_targets([], []) == []


def cheapest(capacity, quota, repeats):
    """Most words routed, then least repetition cost, by trying all splits of tiny networks."""
    edges = [(p, s) for p, (members, _) in enumerate(capacity) for s in members]
    best = (0, 0)
    for flow in itertools.product(*[range(min(quota[s], repeats * capacity[p][1]) + 1) for p, s in edges]):
        into = [sum(f for f, (_, t) in zip(flow, edges, strict=True) if t == s) for s in range(len(quota))]
        out = [sum(f for f, (q, _) in zip(flow, edges, strict=True) if q == p) for p in range(len(capacity))]
        if any(i > q for i, q in zip(into, quota, strict=True)) or any(o > repeats * c for o, (_, c) in zip(out, capacity, strict=True)):
            continue
        cost = sum(k * min(c, max(0, o - k * c)) for o, (_, c) in zip(out, capacity, strict=True) for k in range(repeats))
        best = max(best, (sum(into), -cost))
    return best


def test_flow_is_most_at_least_cost():
    rng = random.Random(2)
    for _ in range(40):
        capacity = [(m, rng.randrange(0, 4)) for m in ((0,), (1,), (0, 1))]
        quota = [rng.randrange(0, 7), rng.randrange(0, 7)]
        flow = mixing.route(capacity, quota)
        out = [sum(f.values()) for f in flow]
        cost = sum(k * min(c, max(0, o - k * c)) for o, (_, c) in zip(out, capacity, strict=True) for k in range(3))
        assert (sum(out), -cost) == cheapest(capacity, quota, 3)


def check(rows, found):
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: 0 for s in sources}
    for _, text, s in rows:
        size[s] += len(re.findall(WORD, text or ""))
    targets = dict(zip(sources, mixing.capped_targets([size[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))]), strict=True))
    taken = {s: 0 for s in sources}
    longest = {s: 0 for s in sources}
    assert len(found) == len(rows)
    for r in found:
        own = r.quotas[0]
        assert own.source_size == size[own.source] and own.target == pytest.approx(targets[own.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[own.source] += r.taken
        longest[own.source] = max(longest[own.source], r.size)
    for s in sources:
        assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1


def test_mix_meets_targets(corpus_docs):
    rows = [(r.doc_id, r.text, r.source) for r in corpus_docs.collect()]
    first = mixing.mix(corpus_docs, F.array("source")).collect()
    check(rows, first)
    again = mixing.mix(corpus_docs.repartition(7), F.array("source")).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def gap_is_filled(rows, found):
    """The words missing to a target are fewer than those of any document that could still be taken.

    Only where no other document is left, the last one may overstep the target, by half of its words at most.
    """
    taken, left, targets = {}, {}, {}
    for r in found:
        own = r.quotas[0]
        targets[own.source] = own.target
        taken[own.source] = taken.get(own.source, 0) + r.taken
        left.setdefault(own.source, []).append((r.taken // r.size if r.size else 9, r.size))
    for source, target in targets.items():
        fewest = min(n for n, _ in left[source])
        smallest = min(size for n, size in left[source] if n == fewest)
        over = max(size for _, size in left[source]) / 2 if len({n for n, _ in left[source]}) == 1 else smallest
        assert target - taken[source] < smallest + 1 and taken[source] - target <= over + 1, (source, target, taken[source])


DOC = "doc_id bigint, text string, source string"


def test_rows_without_ids_are_taken_one_by_one(spark, monkeypatch):
    rows = [(i if i % 2 else None, f"{'w ' * 9}x{i}", "a") for i in range(600)] + [(i, "z " * 10, "b") for i in range(900, 1500)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    first = mixing.mix(docs, F.array("source")).collect()
    check([(r[0], r[1], r[2]) for r in rows], first)
    gap_is_filled(rows, first)
    again = mixing.mix(docs.repartition(3), F.array("source")).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in first) == sorted((r.doc_id or -1, r.taken) for r in again)


def test_a_long_document_at_the_cut_leaves_no_gap(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BIN", 50)
    for seed in range(4):
        rows = [(i, "w " * (2500 if i == 17 else 3), "a") for i in range(3000)] + [(i, "z " * 7, "b") for i in range(5000, 5600)]
        found = mixing.mix(spark.createDataFrame(rows, DOC), F.array("source"), seed=seed).collect()
        gap_is_filled(rows, found)


def test_alike_rows_are_shared_out(spark):
    """All rows of a source alike: some of them are taken once more, whatever the partitions."""
    rows = [(None, "same text here", "a")] * 400 + [(7, "same text here", "b")] * 301 + [(8, "x y z w", "b")] * 50
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    found = mixing.mix(docs, F.array("source")).collect()
    check(rows, found)
    gap_is_filled(rows, found)
    out = mixing.mixed_documents(docs)
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in found)


def test_gaps_are_filled_largest_first():
    assert mixing._fill([(3, 10), (50, 1), (7, 2)], 60) == [(50, 1, 1), (7, 1, 2), (3, 1, 10)]
    assert mixing._fill([(4, 1)], 3) == [(4, 1, 1)] and mixing._fill([(4, 1)], 2) == [] and mixing._fill([], 5) == []


def test_many_patterns_are_routed_fast():
    rng = random.Random(3)
    capacity = [((s, rng.randrange(20_000)), rng.randrange(1, 50)) for s in range(20_000)]
    capacity = [(tuple(sorted(set(m))), w) for m, w in capacity]
    quota = [rng.randrange(0, 120) for _ in range(20_000)]
    import time

    started = time.time()
    flow = mixing.route(capacity, quota)
    into = [0] * len(quota)
    for (members, words), some in zip(capacity, flow, strict=True):
        assert set(some) <= set(members) and sum(some.values()) <= 3 * words
        for s, n in some.items():
            into[s] += n
    assert all(i <= q for i, q in zip(into, quota, strict=True)) and time.time() - started < 60


def test_bins(corpus_docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BIN", 5)
    rows = [(r.doc_id, r.text, r.source) for r in corpus_docs.collect()]
    found = mixing.mix(corpus_docs, F.array("source")).collect()
    assert len(found) == len(rows) and all(r.taken <= 3 * r.size for r in found)


def test_edges_and_documents(edge, nothing):
    found = mixing.mix(edge, F.array("source")).collect()
    assert len(found) == edge.count()
    out = mixing.mixed_documents(edge)
    assert out.columns == edge.columns
    taken = sum(r.taken for r in found)
    assert sum(len(re.findall(WORD, r.text)) for r in out.collect()) == taken
    assert mixing.mix(nothing, F.array("source")).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"], None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, groups array<string>, source string")
    found = mixing.mix(docs, F.col("groups"), weights=(1.0, 1.0)).collect()
    assert len(found) == 40 and {len(r.quotas) for r in found} == {1, 2}
    assert sum(r.taken for r in found) == pytest.approx(400, abs=20)
