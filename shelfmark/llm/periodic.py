"""Runs of periodic words in whole texts, by recursive frequency splitting.

A run is a stretch of consecutive words whose smallest period is q, of at least max(LEAST, REPEATS * q) words, that no
neighbouring word extends. Each of its words stands in it REPEATS times at least. So a word that occurs less often
within a segment can belong to no run there: it splits the segment. Pieces too short for a run go, the rest is counted
again, until nothing changes. On ordinary text next to nothing survives.

What survives is scanned lag by lag. Lags below WIDE are compared word by word. A run of a longer period q holds, at
some multiple of q, a block of q words that equals the next block; blocks are compared by prefix hashes, which takes
1/q of the words per lag, and equal ones are extended by bisection. Runs found through hashes are compared word by
word in the end; a lag where that fails is scanned word by word, so results don't depend on hashes.

Every document is worked on by itself, where it lies: no shuffle. Defined results: a null, empty or blank text has no
runs and an empty collapsed text; repeated rows give repeated rows; an empty table gives no rows; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import mix64, pieces_of, text_of

LEAST = 24  # words of a run, at least
REPEATS = 3  # periods of a run, at least
WIDE = LEAST // REPEATS + 1  # from this period on a run has REPEATS periods
BLOCK = 1 << 20  # places that a scan looks at at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
Run = tuple[int, int, int]  # start, length, period
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _stretches(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]])))
    return edge[::2], edge[1::2]


def surviving(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the segments that splitting at rare words leaves; words are numbers from 0."""
    done: list[tuple[int, int]] = []
    begins, ends = np.array([0]), np.array([len(words)])
    while True:
        long = ends - begins >= LEAST
        begins, ends = begins[long], ends[long]
        if not len(begins):
            break
        size = ends - begins
        owner = np.repeat(np.arange(len(begins)), size)
        place = np.arange(size.sum()) + np.repeat(begins - (np.cumsum(size) - size), size)
        if len(begins) == 1:
            count = np.bincount(words[place])[words[place]]
        else:
            key = owner * (int(words.max()) + 1) + words[place]
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            count = n[at]
        good = count >= REPEATS
        whole = np.bincount(owner, ~good, len(begins)) == 0  # stable segments aren't counted again
        done += zip(begins[whole].tolist(), ends[whole].tolist(), strict=True)
        alive = np.zeros(len(words) + 1, bool)
        alive[place[good & ~whole[owner]]] = True
        # segments never touch: at least the word that split them lies between
        begins, ends = _stretches(alive)
    done.sort()
    return np.array([d[0] for d in done], np.int64), np.array([d[1] for d in done], np.int64)


def _plain(words: np.ndarray, lag: int) -> list[Run]:
    """Runs that keep a period of `lag`, by comparing all words."""
    least = max(LEAST, REPEATS * lag) - lag
    if len(words) - lag < least:
        return []
    begins, ends = _stretches(words[lag:] == words[:-lag])
    long = ends - begins >= least
    return [(int(b), int(e - b) + lag, lag) for b, e in zip(begins[long], ends[long], strict=True)]


class _Hashes:
    """Hashes of all stretches of words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.power = np.full(n + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of `length` words from a and from b, a before b, have equal hashes."""
        first = (self.sums[a + length] - self.sums[a]) * self.power[b - a]
        return first == self.sums[b + length] - self.sums[b]


def _reach(hashes: _Hashes, a: np.ndarray, lag: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from a on (or before a) equal those `lag` later, `most` at most."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        begin = a[open_] if forward else a[open_] - mid
        same = hashes.same(begin, begin + lag[open_], mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)


def _anchored(hashes: _Hashes, words: np.ndarray, low: int, high: int, known: list[Run]) -> set[Run]:
    """Runs that keep a period from `low` to `high` - 1, by blocks at multiples of the period."""
    n = len(words)
    lags = np.arange(low, high)
    number = np.maximum(n // lags - 1, 0)
    found: set[Run] = set()
    first = 0
    while first < len(lags):
        held = np.cumsum(number[first:])
        last = first + max(int(np.searchsorted(held, BLOCK, "right")), 1)
        few = number[first:last]
        lag = np.repeat(lags[first:last], few)
        a = (np.arange(len(lag)) - np.repeat(np.cumsum(few) - few, few)) * lag
        # the first words of equal blocks are equal: most places are ruled out by that
        likely = words[a] == words[a + lag]
        a, lag = a[likely], lag[likely]
        likely = hashes.same(a, a + lag, lag)
        a, lag = a[likely], lag[likely]
        for start, length, period in known:  # a multiple of a known run's period within it gives the same run
            if length >= 2 * low and len(a):
                other = (lag % period != 0) | (a < start) | (a + 2 * lag > start + length)
                a, lag = a[other], lag[other]
        after = _reach(hashes, a, lag, n - lag - a, True)
        before = _reach(hashes, a, lag, a.copy(), False)
        long = before + after >= (REPEATS - 1) * lag
        found.update(
            zip((a - before)[long].tolist(), (before + after + lag)[long].tolist(), lag[long].tolist(), strict=True)
        )
        first = last
    return found


def runs_of(words: np.ndarray) -> list[Run]:
    """All runs of a text whose words are numbers from 0, by start, then period."""
    begins, ends = surviving(words)
    if not len(begins):
        return []
    # Segments next to each other, each ended by a number of its own that equals no other.
    size = ends - begins + 1
    shift = begins - (np.cumsum(size) - size)
    place = np.arange(size.sum()) + np.repeat(shift, size)
    kept = words[np.minimum(place, len(words) - 1)].astype(np.int64)
    stop = np.cumsum(size) - 1
    kept[stop] = int(words.max()) + 1 + np.arange(len(stop))
    found: dict[tuple[int, int], int] = {}

    def add(some: Iterator[Run] | list[Run] | set[Run]) -> None:
        for start, length, period in some:
            known = found.get((start, length))
            if known is None or period < known:
                found[start, length] = period

    for lag in range(1, WIDE):
        add(_plain(kept, lag))
    widest = int((ends - begins).max()) // REPEATS
    hashes, low = _Hashes(kept) if widest >= WIDE else None, WIDE
    while hashes is not None and low <= widest:
        high = min(2 * low, widest + 1)
        known = [(s, n, p) for (s, n), p in found.items()]
        some = _anchored(hashes, kept, low, high, known)
        wrong = {p for s, n, p in some if (kept[s : s + n - p] != kept[s + p : s + n]).any()}
        for lag in wrong:  # different blocks had one hash
            some = {r for r in some if r[2] != lag} | set(_plain(kept, lag))
        add(some)
        low = high
    at = np.searchsorted(stop, [s for s, _ in found])
    out = [(s + int(shift[i]), n, p) for i, ((s, n), p) in zip(at, found.items(), strict=True)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 0, equal words alike."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by blanks."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
    return b" ".join(words)


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length per period; ties: the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in words), best (the strongest of them) and the collapsed text.

    `rewrite` may change a document's words before they are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
        names = [k[0] for k in kinds]
        for batch in pieces_of(batches):
            out: list[list] = [[], [], [], []]
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = raw.as_py().split()  # bytes part at ASCII blanks only
                if rewrite:
                    words = rewrite(doc, words)
                runs = runs_of(numbered(words)) if len(words) >= LEAST else []
                best = strongest(runs)
                out[0].append(len(words))
                out[1].append([dict(zip(names, r, strict=True)) for r in runs])
                out[2].append(dict(zip(names, best, strict=True)) if best else None)
                out[3].append(collapsed(words, runs).decode())
            one = pa.struct(kinds)
            arrays = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.list_(one), one, pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "runs", "best", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    one = RUNS.removeprefix("array<").removesuffix(">")
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUNS}, best {one}, collapsed string")
