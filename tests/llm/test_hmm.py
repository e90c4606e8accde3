"""The language model against direct sums, and the base scores against counting."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import hmm


def small_model(rng, size=5, states=2):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((size, states)), 0), norm(rng.random(states), 0))


def paths(model, seen, start):
    """Probability of every state path with the observations."""
    k = len(start)
    for path in itertools.product(range(k), repeat=len(seen)):
        p = start[path[0]] * model.emit[seen[0], path[0]]
        for t in range(1, len(seen)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seen[t], path[t]]
        yield path, p


@pytest.fixture
def two_states(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)


def test_forward_sums_all_paths(two_states):
    rng = np.random.default_rng(0)
    model = small_model(rng)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 6, 6)]
    got = model.log10(sequences)
    want = [math.log10(sum(p for _, p in paths(model, s, model.start))) for s in sequences]
    assert got == pytest.approx(want)


def test_expected_counts_are_posteriors(two_states):
    rng = np.random.default_rng(1)
    model = small_model(rng)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (3, 5, 1, 4)]
    opens = np.array([True, False, True, True])
    start, moves, emits = model.expected(sequences, opens)
    want = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for seen, first in zip(sequences, opens, strict=True):
        each = list(paths(model, seen, model.start if first else model.share))
        total = sum(p for _, p in each)
        for path, p in each:
            if first:
                want[0][path[0]] += p / total
            for t, (s, k) in enumerate(zip(seen, path, strict=True)):
                want[2][s, k] += p / total
                if t:
                    want[1][path[t - 1], k] += p / total
    for got, right in zip((start, moves, emits), want, strict=True):
        assert np.allclose(got, right)


def check(rows, found):
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    words = [[w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    count = Counter(w for ws, x in zip(words, train, strict=True) if x for w in ws)
    ends = sum(train)
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    value = lambda c: math.log10((c + 1) / (n + v + 1))
    want = sorted(
        (i or -1, not x, len(ws) + 1, sum(count[w] > 0 for w in ws) + (ends > 0), n, round(sum(value(count[w]) for w in ws) + value(ends), 6))
        for (i, _), ws, x in zip(rows, words, train, strict=True)
    )
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == pytest.approx(want) if not want else all(g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-4 for g, w in zip(got, want, strict=True))
    assert all(r.score < 0 for r in found)


def test_base_scores(edge, nothing):
    check([(r.doc_id, r.text) for r in edge.collect()], hmm.score(edge).collect())
    assert hmm.score(nothing).count() == 0


def test_rare_words_are_joined(corpus_docs, corpus, monkeypatch):
    monkeypatch.setattr(hmm, "LOOKUP", 60)
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    found = hmm.score(corpus_docs).collect()
    check(corpus, found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_only_held_out_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string")
    found = hmm.score(docs).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in found)


def test_uncounted_places_only_carry_messages(two_states):
    rng = np.random.default_rng(2)
    model = small_model(rng)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (6, 4, 5)]
    opens = np.array([False, True, False])
    bounds = np.array([(2, 5), (0, 3), (1, 5)])
    start, moves, emits = model.expected(sequences, opens, bounds)
    want = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2))
    for seen, first, (low, high) in zip(sequences, opens, bounds, strict=True):
        each = list(paths(model, seen, model.start if first else model.share))
        total = sum(p for _, p in each)
        for path, p in each:
            if first:
                want[0][path[0]] += p / total
            for t in range(low, high):
                want[2][seen[t], path[t]] += p / total
                if t:
                    want[1][path[t - 1], path[t]] += p / total
    for got, right in zip((start, moves, emits), want, strict=True):
        assert np.allclose(got, right)


def test_cut_texts_train_like_whole_ones(spark, monkeypatch):
    """With segments of 32 tokens, the moves are those of whole texts up to what lies beyond the tokens carried over a cut."""
    words = [f"w{(i * i // 7) % 40}" if (i // 50) % 2 else f"v{i % 30}" for i in range(900)]
    docs = spark.createDataFrame([(d, " ".join(words[d * 17 :])) for d in range(20)], "doc_id bigint, text string")
    counts = hmm.count_words(docs)
    ends = docs.filter(~hmm.held_out(hmm.MODULUS, hmm.REMAINDER)).count()
    known = hmm.Vocabulary(counts, ends)
    sequences = hmm.encode(docs, known)
    monkeypatch.setattr(hmm, "SEGMENT", 10_000)
    whole = hmm.train(sequences, known, 1)
    monkeypatch.setattr(hmm, "SEGMENT", 32)
    errors = []
    for carry in (0, 8, 32, 128):
        monkeypatch.setattr(hmm, "CARRY", carry)
        cut = hmm.train(sequences, known, 1)
        assert np.allclose(cut.start, whole.start, atol=1e-2)
        errors.append(max(abs(cut.move - whole.move).max(), abs(cut.emit - whole.emit).max()))
    assert errors == sorted(errors, reverse=True) and errors[-1] < 2e-5 and errors[2] < errors[0] / 4, errors


@pytest.mark.parametrize("most", [0, 1, 5, 63, 64, 65, 200, 299, 300, 400])
def test_lookup_is_filled_exactly_from_flat_vocabularies(spark, most):
    flat = [(f"word{i}".encode(), 0, 3) for i in range(235)]
    steep = [(f"top{i}".encode(), 0, 1000 + i // 2) for i in range(65)]
    counts = spark.createDataFrame(flat + steep, "word binary, class int, n bigint")
    got = hmm.Vocabulary._most(counts, most)
    assert len({bytes(r["word"]) for r in got}) == len(got) == min(most, 300)
    best = sorted((r[2] for r in flat + steep), reverse=True)[:most]
    assert sorted((r["n"] for r in got), reverse=True) == best
