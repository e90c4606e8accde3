"""A regularised quadratic discriminant over statistics of whole texts.

Every text gives a vector of transformed statistics (shares go through a logarithm with an offset). Each class has a
mean and a covariance, summed over the partitions of a bounded sample of labelled rows; a covariance is shrunk towards
its diagonal and towards the pooled one. The Cholesky factors are computed once and travel with the scoring job: a
score is the logistic of the difference of the classes' log densities (Mahalanobis distance and log determinant).

Defined results: a null or empty text is scored by the statistics of an empty text; repeated rows are scored alike;
without labelled rows of both classes the score is the share of label 1 (0.5 without any); an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import batch_bytes, pieces_of, text_of
from shelfmark.llm.labelled import MOST_PER_CLASS, held_out, sample_labels, sampled_texts
from shelfmark.llm.shingles import shingles, word_hashes

MODULUS, REMAINDER = 4, 2  # the fold that isn't learned from
THRESHOLD = 0.7
SHRINK_DIAGONAL = 0.1
SHRINK_POOLED = 0.05
FLOOR = 0.05  # least standard deviation of a statistic within a class
OFFSET = 1e-2
EASE = 20.0  # added to what shares are taken of, so that a few words don't make an extreme one
PIECE = 1 << 20  # bytes of text that a task looks at at a time: it takes about a hundred times as much memory
TEMPER = 4.0  # log densities are divided by it: statistics of one text aren't independent
STATISTICS = (
    "words", "word_length", "distinct_words", "repeated_shingles", "same_as_before", "upper", "digits", "symbols",
    "marks", "endings", "bare_marks", "lines", "other_bytes",
)
_CLASS = np.zeros(256, np.int8)  # 0 letter, 1 upper, 2 digit, 3 blank, 4 stop or comma, 5 other mark, 6 above ASCII
_CLASS[:] = 5
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord("."), ord(",")]] = 4
_CLASS[128:] = 6


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of distinct values in each text's run of hashes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[fresh], minlength=len(counts)).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    data, offsets = batch_bytes(texts)
    n = len(offsets) - 1
    kind = _CLASS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(owner * 7 + kind, minlength=7 * n).reshape(n, 7).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words, count = word_hashes(data, offsets)
    many = np.maximum(count, 1).astype(float)
    of = np.repeat(np.arange(n), count)
    same = np.zeros(n)
    if len(words) > 1:
        again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        same = np.bincount(of[1:][again], minlength=n).astype(float)
    pieces, number = shingles(texts)
    solid = kind != 3
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    last[inner[inner > 0] - 1] = solid[inner[inner > 0] - 1]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = solid[offsets[:-1][offsets[:-1] < len(data)]]
    mark = kind == 5
    endings = np.bincount(owner[last & mark], minlength=n).astype(float)
    bare = np.bincount(owner[last & first & mark], minlength=n).astype(float)
    lines = np.bincount(owner[data == 10], minlength=n).astype(float)
    solid_size = np.maximum(size - share[:, 3], 1)
    letters = np.maximum(share[:, 0] + share[:, 1], 1)
    log = lambda x: np.log(x + OFFSET)
    return np.column_stack(
        [
            np.log1p(count), np.log1p(solid_size / many), np.log((many + EASE) / (_distinct(words, count) + EASE)),
            log((number - _distinct(pieces, number)) / (number + EASE)), log(same / (many + EASE)), log(share[:, 1] / (letters + EASE)), log(share[:, 2] / (solid_size + EASE)), log(share[:, 5] / solid_size),
            log(share[:, 4] / (solid_size + EASE)), log(endings / (many + EASE)), log(bare / (many + EASE)), log(lines / (many + EASE)),
            log(share[:, 6] / (solid_size + EASE)),
        ]
    )


class Discriminant:
    """Means, Cholesky factors and log determinants of the two classes, ready to score."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], weight: dict[int, float]):
        """moments: class -> (rows, sum of vectors, sum of outer products)."""
        total = {c: n * weight.get(c, 1.0) for c, (n, _, _) in moments.items()}
        both = sum(total.values())
        self.prior = total.get(1, 0.0) / both if both else 0.5
        self.fit = all(moments.get(c, (0,))[0] >= 2 for c in (0, 1))
        if not self.fit:
            return
        mean = {c: s / n for c, (n, s, _) in moments.items()}
        cov = {c: q / n - np.outer(mean[c], mean[c]) for c, (n, _, q) in moments.items()}
        pooled = (cov[0] + cov[1]) / 2
        self.mean, self.factor, self.logdet = mean, {}, {}
        for c in (0, 1):
            s = (1 - SHRINK_POOLED) * cov[c] + SHRINK_POOLED * pooled
            s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + FLOOR**2 * np.eye(len(s))
            low = np.linalg.cholesky(s)
            self.factor[c] = np.linalg.inv(low).T
            self.logdet[c] = 2 * np.log(np.diag(low)).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fit:
            return np.full(len(x), self.prior)
        density = [
            -0.5 * ((((x - self.mean[c]) @ self.factor[c]) ** 2).sum(axis=1) + self.logdet[c]) for c in (0, 1)
        ]
        odds = (density[1] - density[0]) / TEMPER + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> Discriminant:
    """Fit on at most about `most` labelled rows a class outside the held-out fold."""
    chosen, weight = sample_labels(labels, "quality", MODULUS, REMAINDER, most)
    sample = sampled_texts(docs, chosen, "quality-sample")
    m = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: (0.0, np.zeros(m), np.zeros((m, m))) for c in (0, 1)}
        for batch in pieces_of(batches, PIECE):
            x, y = statistics(batch.column(1)), batch.column(2).to_numpy()
            for c in (0, 1):
                some = x[y == c]
                n, s, q = sums[c]
                sums[c] = (n + len(some), s + some.sum(axis=0), q + some.T @ some)
        rows = [(c, i, v) for c, (n, s, q) in sums.items() for i, v in enumerate([n, *s, *q.ravel()])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)],
            names=["label", "place", "value"],
        )

    found = (
        sample.select("doc_id", "text", "label")
        .mapInArrow(moments, "label int, place int, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
        .collect()  # as many rows as the model has numbers
    )
    flat = {c: np.zeros(1 + m + m * m) for c in (0, 1)}
    for r in found:
        flat[r["label"]][r["place"]] = r["value"]
    return Discriminant({c: (v[0], v[1 : 1 + m], v[1 + m :].reshape(m, m)) for c, v in flat.items()}, weight)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns of docs."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, PIECE):
            good = model.scores(statistics(batch.column(batch.schema.get_field_index("text")))) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, PIECE):
            s = model.scores(statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(MODULUS, REMAINDER).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
