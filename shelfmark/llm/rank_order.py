"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased, everything but letters parts words, and its n-grams of one to three characters are counted
inside words, with one blank on either side of each word. A language's profile is the ranking of its most frequent
n-grams over all training texts; a document's is the ranking of its own. Their out-of-place distance is the sum, over
the document's n-grams, of how many places apart both ranks are; an n-gram that the language's profile lacks costs the
profile's whole length. The nearest language is predicted; the score is how much nearer it is than the second one
(0 a tie, 1 the most), where the largest possible distance stands in for a second language if there is but one.

Counting is a sum per language and n-gram over the partitions, each of which adds up its own counts first. An n-gram
is one integer (three code points), so that no two share a counter. Profiles are taken by a rank filter that Spark
applies before it shuffles. Predictions run over the texts where they lie, against the profiles of up to GROUP
languages at a time; further languages are further steps of the same pass that carry the two best distances along, so
what a task holds doesn't depend on the number of languages.

Defined results: a null text, an empty one and one without letters are `und` with score 0, as is every text if no
language was learned; equal counts rank by code points; equally near languages give the first by name; repeated rows
count as often as they occur; a null doc_id belongs to no held-out fold; an empty table gives no rows. Texts are
counted in windows of WINDOW characters, whatever their length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import pieces_of, stored, text_of
from shelfmark.llm.labelled import held_out

MODULUS, REMAINDER = 4, 2  # the fold that isn't learned from
PROFILE = 1000  # n-grams in a profile
GROUP = 256  # languages that a step of the prediction compares with
WINDOW = 1 << 20  # characters whose n-grams are sorted at a time
PIECE = 1 << 20  # bytes of text that a task looks at at a time
HELD = 1 << 18  # n-grams whose counts a training task holds before it adds them up
UNKNOWN = "und"
BITS = 21  # of a code point
BLANK = 32


def _letters() -> np.ndarray:
    """Whether a code point is a letter; the worker process keeps it. (A function under lru_cache would travel by name.)"""
    kept = sys.__dict__.setdefault("_shelfmark_letters", [])
    if not kept:
        kept.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return kept[0]


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) == 1:
        return grams[0], counts[0]
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _counted(codes: np.ndarray, bits: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of a run of codes (1 a blank, 0 no character), ascending, and how often each occurs."""
    x = codes.astype(kind)
    high = x << kind(2 * bits)
    keys = [high[x > 1], (high[:-1] | (x[1:] << kind(bits)))]
    inner = x[1:-1] > 1
    keys.append((keys[1][:-1] | x[2:])[inner])
    whole = np.concatenate(keys)
    whole.sort()
    fresh = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, np.int64)
    return whole[fresh], np.diff(np.append(fresh, len(whole)))


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's n-grams, ascending by code points, and how often each occurs in it."""
    lower = [(t or "").lower() + "\0" for t in texts]
    raw = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lower])
    present = np.flatnonzero(np.bincount(raw)) if len(raw) else np.zeros(0, np.int64)
    known = present[_letters()[present]]
    code = np.ones(present[-1] + 1 if len(present) else 1, np.uint32)
    code[known] = np.arange(2, len(known) + 2)
    points = np.concatenate([[0, BLANK], known]).astype(np.int64)
    bits = int(len(known) + 1).bit_length()
    kind = np.uint32 if 3 * bits <= 32 else np.uint64
    x = np.concatenate([np.ones(1, np.uint32), code[raw]])  # a blank before the first text
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] > 1) | (x[:-1] > 1)
    x = x[keep]
    past = np.cumsum(keep)[ends] if len(ends) else ends
    first = 0  # the blank before the text
    for end in past:
        grams, counts = [], []
        for at in range(first, end - 1, WINDOW):
            # a window ends with two characters of the next one, so that it holds every n-gram that begins in it
            window, more = x[at : min(at + WINDOW + 2, end)], at + WINDOW < end - 1
            keys, n = _counted(window, bits, kind)
            if more:
                k2, n2 = _counted(window[-2:], bits, kind)
                n[np.searchsorted(keys, k2)] -= n2
                keys, n = keys[n > 0], n[n > 0]
            k = keys.astype(np.int64)
            mask = (1 << bits) - 1
            one, two, three = points[k >> (2 * bits)], points[(k >> bits) & mask], points[k & mask]
            grams.append((one << (2 * BITS)) | (two << BITS) | three)
            counts.append(n)
        first = end - 1
        yield _summed(grams, counts)


def gram_text(gram: int) -> str:
    """The characters of an n-gram."""
    parts = [(gram >> (BITS * i)) & ((1 << BITS) - 1) for i in (2, 1, 0)]
    return "".join(chr(p) for p in parts if p)


def ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The `length` most frequent of ascending n-grams, the most frequent first."""
    return grams[np.argsort(-counts, kind="stable")[:length]]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and n: how often an n-gram occurs in all texts of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts) in held.items():
                g, n = _summed(grams, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(g)), pa.array(g), pa.array(n, pa.int64())], names=["lang", "gram", "n"]
                )

        for batch in pieces_of(batches, PIECE):
            for lang, (g, n) in zip(batch.column(0).to_pylist(), ngrams(batch.column(1).to_pylist()), strict=True):
                grams, counts = held.setdefault(lang, ([], []))
                grams.append(g)
                counts.append(n)
                size += len(g)
            if size > 8 * HELD:
                held = {lang: tuple([x] for x in _summed(*parts)) for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, length: int = PROFILE) -> DataFrame:
    """lang, place (from 0), gram and n of the most frequent n-grams of every language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    place = F.row_number().over(order)
    return gram_counts(docs).withColumn("place", place).filter(F.col("place") <= length).select("lang", (F.col("place") - 1).alias("place"), "gram", "n")


class Profiles:
    """Rankings of some languages, ready to be compared with a document's."""

    def __init__(self, rankings: dict[str, np.ndarray], length: int):
        self.names, self.length = sorted(rankings), length
        self.grams = np.unique(np.concatenate([rankings[name] for name in self.names]))
        self.place = np.full((len(self.grams), len(self.names)), -1, np.int32)
        for at, name in enumerate(self.names):
            self.place[np.searchsorted(self.grams, rankings[name]), at] = np.arange(len(rankings[name]))

    def distances(self, ranking: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranking to every language."""
        at = np.searchsorted(self.grams, ranking)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == ranking
        there = self.place[at[known]]
        apart = np.abs(there - np.flatnonzero(known)[:, None])
        return np.where(there < 0, self.length, apart).sum(axis=0) + self.length * int((~known).sum())


def identify(docs: DataFrame, learned: DataFrame, length: int = PROFILE, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; `learned` as `profiles` gives it."""
    names = sorted(r["lang"] for r in learned.select("lang").distinct().collect())
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(MODULUS, REMAINDER).alias("held_out"),
        text_of().alias("text"),
        F.lit(None).cast("string").alias("lang_pred"),
        F.lit(None).cast("bigint").alias("best"),
        F.lit(None).cast("bigint").alias("next"),
    )
    for first in range(0, len(names), group):
        rankings: dict[str, list] = {name: [] for name in names[first : first + group]}
        for r in learned.filter(F.col("lang").isin(list(rankings))).orderBy("lang", "place").collect():
            rankings[r["lang"]].append(r["gram"])
        rows = _compared(rows, Profiles({k: np.array(v, np.int64) for k, v in rankings.items()}, length))
    score = F.when(F.col("next") > 0, (F.col("next") - F.col("best")) / F.col("next")).otherwise(0.0)
    return rows.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score"))


def _compared(rows: DataFrame, some: Profiles) -> DataFrame:
    """Rows with the best of `some` and of what they already know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, PIECE):
            out: list[tuple] = []
            known = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            for (name, best, second), (g, n) in zip(known, ngrams(batch.column(2).to_pylist()), strict=True):
                if len(g):
                    far = some.distances(ranked(g, n, some.length))
                    limit = some.length * min(len(g), some.length)
                    near = [(limit if best is None else second, None), *([] if best is None else [(best, name)])]
                    near += [(int(d), s) for d, s in zip(far, some.names, strict=True)]
                    near.sort(key=lambda x: (x[0], x[1] is None, x[1] or ""))
                    (best, name), (second, _) = near[:2]
                out.append((name, best, second))
            new = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def languages(docs: DataFrame) -> DataFrame:
    """Learn the languages outside the held-out fold, then identify that of every document."""
    return identify(docs, stored(profiles(docs.filter(~held_out(MODULUS, REMAINDER))), "language-profiles"))
