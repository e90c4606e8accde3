"""Periodic runs against a search by every period."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from shelfmark.llm import periodic, queries
from shelfmark.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def brute(words):
    """Every stretch that no word extends, by every period; the least period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // periodic.REPEATS + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(periodic.LEAST, periodic.REPEATS * q):
                found.setdefault((i, length), q)
            i = j + 1 if j > i else i + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def texts(rng):
    for kinds in (1, 2, 3, 6, 30, 400):
        for _ in range(30):
            words = [rng.randrange(kinds) for _ in range(rng.randrange(0, 160))]
            for _ in range(rng.randrange(0, 4)):
                q = rng.choice([1, 2, 5, 8, 9, 10, 13, 20, 40])
                part = [rng.randrange(kinds) for _ in range(q)]
                at = rng.randrange(len(words) + 1)
                words[at:at] = (part * 30)[: rng.randrange(q, 5 * q + 30)]
            yield words


def test_runs_are_those_of_every_period():
    rng, seen = random.Random(3), 0
    for words in texts(rng):
        got = periodic.runs_of(np.array(words, np.int64))
        assert got == brute(words)
        seen += len(got)
    assert seen > 100


def test_lags_whose_hashes_deceive_are_scanned(monkeypatch):
    monkeypatch.setattr(periodic, "mix64", lambda x: np.zeros_like(x))  # all words hash alike
    rng = random.Random(4)
    for words in texts(rng):
        assert periodic.runs_of(np.array(words, np.int64)) == brute(words)


def test_small_blocks_give_the_same(monkeypatch):
    rng = random.Random(5)
    words = [np.array(w, np.int64) for w in texts(rng)]
    want = [periodic.runs_of(w) for w in words]
    monkeypatch.setattr(periodic, "BLOCK", 7)
    assert [periodic.runs_of(w) for w in words] == want


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic.runs_of(np.array(b, np.int64)) == brute(b)


def test_long_text_of_one_word():
    n = 300_000
    assert periodic.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]


def test_rare_words_split():
    rng = random.Random(6)
    words = [rng.randrange(100) for _ in range(40)] + [200 + i % 9 for i in range(30)] + [rng.randrange(100) for _ in range(40)]
    begins, ends = periodic.surviving(np.array(words))
    assert [(int(b), int(e)) for b, e in zip(begins, ends)] == [(40, 70)]


def planted(doc, words):
    h = periodic_crc(doc)
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_crc(doc):
    import zlib

    return zlib.crc32(str(doc).encode())


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    found = queries.op11_periodic_runs(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    many = 0
    for r in found:
        words = planted(r.doc_id, (docs[r.doc_id] or "").encode().split())
        if len(words) > 1500:
            continue
        runs = brute(words)
        many += bool(runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs)).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
    assert many > 10


def test_edges(spark, edge, nothing):
    found = periodic.periodic_runs(edge).collect()
    assert len(found) == edge.count()
    for r in found:
        if r.doc_id in (0, 3, 6, 9):
            assert (r.n_words, r.runs, r.best, r.collapsed) == (0, [], None, "")
    same = [r for r in found if r.n_words == 500 and r.runs]
    assert [tuple(x) for x in same[0].runs] == [(0, 500, 1)] and same[0].collapsed == "same"
    assert len([r for r in found if r.doc_id is None]) == 1
    assert periodic.periodic_runs(nothing).count() == 0


@pytest.mark.parametrize("text", ["a b " * 40, "\x1f x\x0by " * 30, "ß é " * 24])
def test_only_ascii_blanks_part_words(spark, text):
    import re

    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    row = periodic.periodic_runs(docs).first()
    assert row.n_words == len(words) and [tuple(r) for r in row.runs] == brute(words)
