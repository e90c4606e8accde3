"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (lower-case ASCII letters, split at ASCII marks) and the first bytes of longer words, as hashes. An
example's vector holds all of its terms: (1 + log count) times the inverse document frequency times a class weight,
which is LEAST_WEIGHT for a term that is as frequent in toxic examples as in others, and grows with the logarithm of
how much more frequent it is there. No term is left out, so a copy of an example has a cosine of 1 with it; a text's
terms that no example holds add to the length of its vector with the weight of an unseen term.

Equal example vectors are merged with their votes. The index holds, per term, postings by example and the greatest
weight per block of examples. A look-up adds up bounds per block, computes the blocks of the highest bounds, then all
others whose bound reaches the k-th best cosine, so it is exact. The neighbours vote with weights that fall with the distance, with
part of the class shares of the whole labels restored, and a prior of PRIOR votes; they are the evidence.

Defined results: a null or empty text, or one without any of the terms, is scored by the share of toxic examples
without terms; repeated rows are scored alike; without toxic examples every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import batch_bytes, mix64, pieces_of, text_of
from shelfmark.llm.labelled import held_out, sample_labels, sampled_texts
from shelfmark.llm.shingles import _BASE, _INVERSE, _power

MODULUS, REMAINDER = 5, 0  # the fold that isn't learned from
THRESHOLD = 0.5
MOST = 1000  # labelled rows of a class that examples are made of, at most
STEM = 5  # first bytes of longer words that are terms too
LEAST_WEIGHT = 0.05  # class weight of a term that says nothing
EASE = 1.5  # added to the other examples that hold a term
NEIGHBOURS = 15
BLOCK = 32
FIRST = 4  # blocks that are computed before others are ruled out
RESTORED = 0.5  # power of the class shares that votes get back: the sample has about as many rows of each class
PIECE = 1 << 20  # bytes of text that a task looks at at a time
NEAR = 0.05  # a vote weighs cosine / (NEAR + distance), the distance being 1 - cosine: a copy's as 20 far ones
PRIOR = 0.25  # weight of the labels' toxic share in a vote
# Letters and digits keep their place (upper case becomes lower), bytes above ASCII too; all other bytes part words.
_FOLD = np.zeros(256, np.uint8)
for _c in (*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)):
    _FOLD[_c] = _c
for _c in range(ord("A"), ord("Z") + 1):
    _FOLD[_c] = _c + 32


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts, and the text each belongs to."""
    data, offsets = batch_bytes(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _FOLD[data]
    solid = data > 0
    opens = np.ones(n, bool)
    opens[1:] = ~solid[:-1]
    opens[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(solid & opens)
    closes = np.ones(n, bool)
    closes[:-1] = ~solid[1:]
    closes[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(solid & closes) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=sums[1:])
    back = _power(_INVERSE, n)[starts]
    owner = np.searchsorted(offsets, starts, "right") - 1
    found, owners = [mix64((sums[ends] - sums[starts]) * back)], [owner]
    longer = np.flatnonzero(ends - starts > STEM)
    found.append(mix64((sums[starts[longer] + STEM] - sums[starts[longer]]) * back[longer] + np.uint64(STEM)))
    owners.append(owner[longer])
    return np.concatenate(found), np.concatenate(owners)


def term_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct terms, ascending, and how often they occur."""
    found, owner = terms(texts)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    count, of = np.diff(np.append(first, len(found))), owner[first]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield found[first[a:b]], count[a:b]


def _ranges(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (number[0] of them), first[1], ..."""
    upto = np.cumsum(number)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - number), number)


class Vocabulary:
    """All terms of the examples, sorted by hash, with their weights."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, unseen: float):
        self.hashes, self.weight, self.unseen = hashes, weight, unseen
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def vector(self, found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and unit TF-IDF weights of a text's terms; unknown ones only make the known weights smaller."""
        tf = 1 + np.log(count)
        some = np.flatnonzero(self.maybe[(found & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.searchsorted(self.hashes, found[some])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == found[some] if len(self.hashes) else np.zeros(0, bool)
        term, known = at[hit], some[hit]
        weight = tf[known] * self.weight[term]
        others = tf @ tf - tf[known] @ tf[known]
        length = np.sqrt(weight @ weight + max(others, 0.0) * self.unseen**2)
        return term, weight / length if len(weight) else weight


class BlockMaxIndex:
    """Exact best cosines to a set of example vectors."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], number_of_terms: int):
        """examples: (terms, unit weights); neighbours in this order share blocks."""
        self.n = len(examples)
        term = np.concatenate([t for t, _ in examples]) if examples else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in examples]) if examples else np.zeros(0)
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in examples])
        order = np.lexsort((doc, term))
        doc, self.weight, term = doc[order], weight[order], term[order]
        # One entry per term and block: its postings and their greatest weight.
        key = term * (self.n // BLOCK + 1) + doc // BLOCK
        self.begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.number = np.diff(np.append(self.begin, len(key)))
        self.block = (doc // BLOCK)[self.begin] if len(key) else np.zeros(0, np.int64)
        self.greatest = np.maximum.reduceat(self.weight, self.begin) if len(key) else np.zeros(0)
        self.first = np.searchsorted(term[self.begin] if len(key) else term, np.arange(number_of_terms + 1))
        self.blocks = self.n // BLOCK + 1
        self.doc = doc.astype(np.int32)

    def nearest(self, query: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples with the k best cosines above 0, best first (ties: by place), and the cosines."""
        number = self.first[query + 1] - self.first[query]
        entries = _ranges(self.first[query], number)
        of, block = np.repeat(weights, number), self.block[entries]
        bound = np.bincount(block, self.greatest[entries] * of, self.blocks)
        order = np.argsort(-bound, kind="stable")
        first = np.zeros(self.blocks, bool)
        first[order[:FIRST]] = True
        best, cosine = self._best(entries, of, first[block], k)
        least = cosine[k - 1] if len(cosine) >= k else 0.0
        rest = ~first & (bound > 0) & (bound >= least - 1e-9)
        if rest.any():
            more, others = self._best(entries, of, rest[block], k)
            best, cosine = np.concatenate([best, more]), np.concatenate([cosine, others])
            keep = np.lexsort((best, -cosine))[:k]
            best, cosine = best[keep], cosine[keep]
        return best, cosine

    def _best(self, entries: np.ndarray, of: np.ndarray, chosen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the examples in the chosen entries' blocks."""
        entries = entries[chosen]
        number = self.number[entries]
        places = _ranges(self.begin[entries], number)
        score = np.bincount(self.doc[places], self.weight[places] * np.repeat(of[chosen], number), self.n)
        some = np.flatnonzero(score > 0)
        if len(some) > 4 * k:
            some = some[score[some] >= np.partition(score[some], -k)[-k]]
        keep = some[np.lexsort((some, -score[some]))[:k]]
        return keep, score[keep]


class Classifier:
    """The index with its examples' votes; scores texts."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray, int, int]], weight: dict[int, float], number: dict[int, int]):
        """examples: (terms, counts, label, doc_id) of sampled texts; weight: labelled rows per sampled one by class."""
        total = {c: number.get(c, 0) * weight.get(c, 1.0) for c in (0, 1)}
        self.prior = total[1] / sum(total.values()) if total[1] else 0.0
        hashes, at = np.unique(np.concatenate([e[0] for e in examples]), return_inverse=True) if examples else (np.zeros(0, np.uint64),) * 2
        label = np.repeat([e[2] for e in examples], [len(e[0]) for e in examples]).astype(np.int64)
        df = [np.bincount(at[label == c], minlength=len(hashes)) for c in (0, 1)]
        n = [sum(e[2] == c for e in examples) for c in (0, 1)]
        ratio = ((df[1] + 0.5) / (n[1] + 1)) / ((df[0] + EASE) / (n[0] + 1))
        idf = np.log((len(examples) + 1) / (df[0] + df[1] + 1)) + 1
        unseen = (np.log(len(examples) + 1) + 1) * LEAST_WEIGHT
        self.vocabulary = Vocabulary(hashes, idf * (LEAST_WEIGHT + np.maximum(np.log(ratio), 0)), unseen)
        w = {c: weight.get(c, 1.0) ** RESTORED for c in (0, 1)}
        merged: dict[bytes, list] = {}
        for found, count, c, doc in examples:
            held = merged.setdefault(found.tobytes() + count.astype(np.int64).tobytes(), [found, count, 0.0, 0.0, doc])
            held[2] += w[c] * c
            held[3] += w[c]
            held[4] = min(held[4], doc)
        self.none = self.prior
        empty = merged.pop(b"", None)
        if empty:
            self.none = empty[2] / empty[3]
        vectors = [(*self.vocabulary.vector(found, count), *votes) for found, count, *votes in merged.values()]
        vectors.sort(key=lambda e: (e[0][np.argmax(e[1])], e[4]))  # those of one heaviest term share blocks
        self.index = BlockMaxIndex([(t, x) for t, x, *_ in vectors], len(hashes))
        self.toxic, self.votes = (np.array([e[i] for e in vectors]) for i in (2, 3))
        self.ids = np.array([e[4] for e in vectors], np.int64)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Score of each text, and the ids of the examples that voted."""
        out, evidence = np.full(len(texts), self.none), [[] for _ in range(len(texts))]
        for at, (found, count) in enumerate(term_counts(texts)):
            term, weight = self.vocabulary.vector(found, count)
            if len(found):
                out[at] = self.prior
            if not len(term):
                continue
            near, cosine = self.index.nearest(term, weight, NEIGHBOURS)
            close = cosine / (1 + NEAR - cosine)
            out[at] = (self.toxic[near] @ close + PRIOR * self.prior) / (self.votes[near] @ close + PRIOR)
            evidence[at] = self.ids[near].tolist()
        return out, evidence


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Classifier:
    """Fit on at most about `most` labelled rows a class outside the held-out fold."""
    chosen, weight = sample_labels(labels, "toxic", MODULUS, REMAINDER, most)
    sample = sampled_texts(docs, chosen, "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            found = list(term_counts(batch.column(1)))
            packed = [pa.array([f[i].astype(k).tobytes() for f in found], pa.binary()) for i, k in ((0, np.uint64), (1, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], names=["doc_id", "label", "terms", "counts"])

    rows = (
        sample.select("doc_id", "text", "label")
        .mapInArrow(count, "doc_id bigint, label int, terms binary, counts binary")
        .orderBy("doc_id", "label")
        .collect()  # at most as many rows as the sample
    )
    examples = [(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int64), r["label"], r["doc_id"]) for r in rows]
    number = {c: sum(r["label"] == c for r in rows) for c in (0, 1)}
    return Classifier(examples, weight, number)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the neighbours that voted) of every document."""
    model = fit(docs, labels)  # travels with the function; bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, PIECE):
            s, evidence = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)),
                    pa.array(evidence, pa.list_(pa.int64())),
                ],
                names=["doc_id", "held_out", "score", "predicted", "evidence"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(MODULUS, REMAINDER).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, evidence array<bigint>")
