"""Fingerprints against Jaccard similarity and against Python's own slicing."""

import hashlib
import re

import numpy as np
import pyarrow as pa

from shelfmark.llm import fingerprint
from shelfmark.llm.shingles import shingles

WORD = r"[^\x20\x09-\x0D]+"


def shingle_set(text):
    w = re.findall(WORD, text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_hashes_stand_for_word_tuples(corpus):
    texts = [t for _, t in corpus] + ["", " ", "a", "a\nb", "a b", "b a", "é ü a b c d"]
    hashes, number = shingles(pa.array(texts))
    ends, seen = np.cumsum(number), {}
    for text, e, n in zip(texts, ends, number, strict=True):
        w = re.findall(WORD, text)
        tuples = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert n == len(tuples)
        for t, h in zip(tuples, hashes[e - n : e].tolist(), strict=True):
            assert seen.setdefault(t, h) == h
    assert len(set(seen.values())) == len(seen)


def test_likeness_is_near_jaccard(corpus):
    texts = [t for _, t in corpus]
    signature = fingerprint.compact(fingerprint.signatures(pa.array(texts)))
    sets = [shingle_set(t) for t in texts]
    a, b = np.triu_indices(len(texts), 1)
    likeness = fingerprint.likeness(signature[a], signature[b])
    real = np.array([len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in zip(a, b, strict=True)])
    assert np.abs(likeness - real).max() < 0.2
    assert np.abs(likeness - real).mean() < 0.01


def by_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))


def check(docs, rows):
    found = fingerprint.with_next(docs).toPandas()
    ordered = by_order(rows)
    texts = [r[1] or "" for r in ordered]
    want = []
    for (doc_id, _), text, following in zip(ordered, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((-1 if doc_id is None else doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(-1 if d != d else int(d), n, h) for d, n, h in zip(found.doc_id, found.n_chars, found.edited_sha256, strict=True)]
    assert sorted(got) == sorted(want)
    assert found.near_edited.between(0, 1).all() and found.near_next.between(0, 1).all()
    prints = {}
    for r in found.itertuples():
        prints.setdefault((r.n_chars, r.fingerprint), set()).add(r.doc_id)
    return found


def test_edges(edge):
    found = check(edge, [(r.doc_id, r.text) for r in edge.collect()])
    same = found[found.doc_id.isin([21, 24])]
    assert same.fingerprint.nunique() == 1


def test_many_partitions(corpus_docs, corpus, monkeypatch):
    monkeypatch.setattr(fingerprint, "PARTITION_CHARS", 4000)
    check(corpus_docs, corpus)


def test_one_row_and_none(spark, edge, nothing):
    one = edge.filter("doc_id = 21").limit(1)
    found = fingerprint.with_next(one).collect()
    assert len(found) == 1 and found[0].near_next == 1
    assert fingerprint.with_next(nothing).count() == 0


def test_near_pairs_are_those_of_brute_force(corpus_docs, corpus):
    copies, links, classes = fingerprint.near_pairs(corpus_docs)
    texts = dict(corpus)
    rep = {r.doc_id: r.rep for r in copies.collect()}
    reps = sorted(set(rep.values()))
    assert all(texts[d] == texts[r] for d, r in rep.items())
    sets = {r: shingle_set(texts[r]) for r in reps}
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in links.collect()}
    assert got <= want and got
    root = {r.node: r.root for r in classes.collect()}
    assert all(root[a] == root[b] for a, b in want)
