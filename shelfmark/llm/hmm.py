"""A hidden Markov language model over words, and exact likelihoods of whole texts.

Words of the training texts are counted over the whole corpus. The SYMBOLS most frequent words are symbols of their
own; every other word belongs to one of CLASSES classes by its last bytes, and its probability within the class
follows its count. Baum-Welch runs over all training texts: each partition adds up expected counts on segments of at
most SEGMENT tokens, which overlap by CARRY tokens on either side so that messages pass over the cuts; each token and
each move counts once. The sums make the next parameters. A text is then scored by the scaled forward recursion
over all its tokens, whole, from its first token to its end.

Counts of the LOOKUP most frequent words travel with the jobs; those of rarer words are joined in Spark, so the
vocabulary may grow without bound.

Defined results: a null text is empty and consists of its end; repeated rows and null ids are scored row by row (a
null id is never held out); without training rows all words are unknown and N and V are 0; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import mix64, pieces_of, stored, text_of
from shelfmark.llm.labelled import held_out

MODULUS, REMAINDER = 7, 2  # the fold that isn't learned from
SYMBOLS = 16_384
LOOKUP = 100_000
CLASSES = 256
STATES = 8
ROUNDS = 6
SEGMENT = 512
CARRY = 32  # tokens on either side of a segment that carry messages into it
GROUP = 1_000_000  # tokens that a task trains on at a time
SCORE_GROUP = 4_000_000
STICKY = 0.95  # chance of staying in a state at the start
SMOOTH = 0.5  # weight of the class's or word's overall frequency in each state
MOST_COUNTED = 500_000  # distinct words that a task holds before it hands on their counts


def words_of(text: str) -> list[bytes]:
    """Words with A-Z in lower case; both the case and the blanks are those of ASCII."""
    return text.encode().lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """word, class and n over all training texts; stored. The end isn't a word here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.binary()),
                    pa.array([class_of(w) for w in found], pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["word", "class", "n"],
            )

        found: Counter = Counter()
        for batch in pieces_of(batches):
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
            if len(found) > MOST_COUNTED:
                yield rows(found)
                found = Counter()
        yield rows(found)

    train = docs.filter(~held_out(MODULUS, REMAINDER)).select(text_of().alias("text"))
    made = train.mapInArrow(count, "word binary, class int, n bigint")
    return stored(made.groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n")), "word-counts")


class Vocabulary:
    """What tasks know of the counts: frequent words, sums by class, sums over all."""

    def __init__(self, counts: DataFrame, ends: int):
        sums = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.tokens = int(sums[1] or 0) + ends
        self.distinct = int(sums[0]) + (ends > 0)
        self.ends = ends
        frequent = sorted(self._most(counts, LOOKUP), key=lambda r: (-r["n"], bytes(r["word"])))
        self.place = {bytes(r["word"]): i for i, r in enumerate(frequent)}
        self.symbols = min(SYMBOLS, len(frequent))
        self.size = self.symbols + CLASSES + 1
        self.end = self.size - 1
        n = np.array([r["n"] for r in frequent], np.int64)
        own = np.arange(len(frequent)) < self.symbols
        group = np.array([r["class"] for r in frequent], np.int64)
        # Sums by class of the words that aren't symbols themselves; as many rows as classes.
        total, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
            total[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
        total -= np.bincount(group[own], n[own], CLASSES) if len(n) else 0
        kinds -= np.bincount(group[own], minlength=CLASSES) if len(n) else 0
        self.class_size = total + kinds + 1
        self.frequency = np.concatenate([n[: self.symbols], total, [ends]]) + 1.0
        self.symbol = np.where(own, np.arange(len(frequent)), self.symbols + group) if len(n) else np.zeros(0, np.int64)
        norm = self.tokens + self.distinct + 1
        self.norm = norm
        self.base = np.log10((n + 1) / norm)
        self.within = np.where(own, 0.0, np.log10((n + 1) / self.class_size[group])) if len(n) else np.zeros(0)
        self.end_base = float(np.log10((ends + 1) / norm))

    @staticmethod
    def _most(counts: DataFrame, most: int) -> list:
        """The `most` words of the highest counts (all, if fewer), ties by a hash of the word and then by the word.

        Three histograms find where the choice ends: by steps of a sixteenth of an octave, by the counts of the step
        that doesn't fit whole, and by hash among the words of the count that doesn't. Only the words of the last
        hash bin, one in 65,536 of those of one count, are ordered.
        """
        left, chosen, open_ = most, F.lit(False), F.lit(True)
        for key in (F.floor(F.log2("n") * 16).cast("int"), F.col("n"), F.shiftrightunsigned(F.xxhash64("word"), 48)):
            # A bin holds a word at least, so more bins than words wanted can't matter.
            bins = counts.filter(open_).groupBy(key.alias("bin")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("bin")).limit(left + 1)
            cut = None
            for r in bins.collect():
                if r["words"] > left:
                    cut = r["bin"]
                    break
                left -= r["words"]
            if cut is None:
                return counts.filter(chosen | open_).collect()
            chosen, open_ = chosen | (open_ & (key > cut)), open_ & (key == cut)
        return counts.filter(chosen).collect() + counts.filter(open_).orderBy("word").limit(left).collect()


SEQUENCES = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, within double,"
    " symbols binary, rare array<struct<word:binary,class:int,n:int>>"
)


def encode(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """A row per text: its symbols, what its frequent words and end add to the scores, and its rarer words; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        rare_kind = pa.list_(pa.struct([("word", pa.binary()), ("class", pa.int32()), ("n", pa.int32())]))
        place = np.append(known.symbol, 0)
        base, within = np.append(known.base, 0.0), np.append(known.within, 0.0)
        for batch in pieces_of(batches):
            words = [words_of(t) for t in batch.column(2).to_pylist()]
            length = np.array([len(w) for w in words])
            at = np.fromiter(map(known.place.get, chain.from_iterable(words), repeat(-1)), np.int64, length.sum())
            symbol = place[at].astype(np.uint16)
            cuts = np.cumsum(length)
            owner = np.repeat(np.arange(len(words)), length)
            rare: list[Counter] = [Counter() for _ in words]
            flat = np.flatnonzero(at < 0)
            begins = cuts - length
            for i, d in zip(flat.tolist(), owner[flat].tolist(), strict=True):
                word = words[d][i - begins[d]]
                rare[d][word] += 1
                symbol[i] = known.symbols + class_of(word)
            end = np.array([known.end], np.uint16).tobytes()
            n = len(words)
            sums = [np.bincount(owner, x[at], n) for x in (base, within)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1),
                    pa.array(length + 1), pa.array(np.bincount(owner, at >= 0, n).astype(np.int64) + (known.ends > 0)),
                    pa.array(sums[0] + known.end_base), pa.array(sums[1]),
                    pa.array([symbol[c - m : c].tobytes() + end for c, m in zip(cuts, length, strict=True)], pa.binary()),
                    pa.array([[{"word": w, "class": class_of(w), "n": k} for w, k in r.items()] for r in rare], rare_kind),
                ],
                names=[c.split()[0] for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols", "rare")],
            )
            row += n

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(MODULUS, REMAINDER).alias("held_out"), text_of().alias("text"))
    return stored(rows.mapInArrow(run, SEQUENCES), "sequences")


class Model:
    """Start, transition and emission probabilities, and what one group of sequences adds to their counts."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray):
        """emit: a row per symbol; share: how likely each state is at the start of a segment inside a text."""
        self.start, self.move, self.emit, self.share = start, move, emit, share

    @staticmethod
    def first(frequency: np.ndarray) -> Model:
        """Near the overall frequencies, scattered by hashes, so that every run begins alike."""
        size = len(frequency)
        noise = mix64(np.arange(1, size * STATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        noise = 0.5 + (noise >> np.uint64(11)).astype(np.float64).reshape(size, STATES) * 2.0**-53
        emit = noise * frequency[:, None]
        move = np.full((STATES, STATES), (1 - STICKY) / max(1, STATES - 1))
        np.fill_diagonal(move, STICKY)
        even = np.full(STATES, 1 / STATES)
        return Model(even, move, emit / emit.sum(axis=0), even)

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Model:
        start = start + 1.0
        share = emit.sum(axis=0) + 1.0
        move = move + 1.0
        overall = frequency / frequency.sum()
        emit = emit + SMOOTH * len(frequency) * overall[:, None]
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), share / share.sum())

    def _steps(self, length: np.ndarray) -> Iterator[int]:
        """How many of the sequences, longest first, are still on at each step."""
        on = len(length)
        for t in range(int(length[0]) if on else 0):
            while length[on - 1] <= t:
                on -= 1
            yield on

    def log10(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Logarithm of each whole sequence's probability, by the scaled forward recursion."""
        length = np.array([len(s) for s in symbols])
        order = np.argsort(-length, kind="stable")
        flat, length = np.concatenate([symbols[i] for i in order]).astype(np.int64), length[order]
        begin = np.cumsum(length) - length
        total = np.zeros(len(symbols))
        alpha = np.zeros((0, STATES))
        for t, on in enumerate(self._steps(length)):
            seen = self.emit[flat[begin[:on] + t]]
            alpha = seen * (self.start if t == 0 else alpha[:on] @ self.move)
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:on] += np.log10(scale)
        out = np.empty(len(symbols))
        out[order] = total
        return out

    def expected(
        self, symbols: list[np.ndarray], opens: np.ndarray, counted: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (a row per symbol).

        opens: which segments begin a text; counted: first and last (exclusive) place of each segment that counts, all
        without it. The others only carry messages. Rows lie step by step, so that each step is one slice.
        """
        length = np.array([len(s) for s in symbols])
        order = np.argsort(-length, kind="stable")
        bounds = np.column_stack([np.zeros_like(length), length]) if counted is None else counted
        length, opens, bounds = length[order], opens[order], bounds[order]
        flat = np.concatenate([symbols[i] for i in order]).astype(np.int64)
        begin = np.cumsum(length) - length
        steps = list(self._steps(length))
        flat = flat[np.concatenate([begin[:on] + t for t, on in enumerate(steps)])]
        at = np.concatenate([[0], np.cumsum(steps)])
        ones = np.ones(STATES)
        rows, scales = self.emit.take(flat, axis=0), np.empty(len(flat))
        for t, on in enumerate(steps):
            alpha = rows[at[t] : at[t + 1]]
            alpha *= np.where(opens[:, None], self.start, self.share) if t == 0 else rows[at[t - 1] : at[t - 1] + on] @ self.move
            scale = scales[at[t] : at[t + 1]] = alpha @ ones
            alpha /= scale[:, None]
        moves = np.zeros((STATES, STATES))
        betas = np.ones((len(length), STATES))  # rows not yet reached are sequences that end later in this loop
        for t in range(len(steps) - 1, -1, -1):
            on, here = steps[t], slice(at[t], at[t + 1])
            beta = betas[:on]
            alpha = rows[here]
            alpha *= beta
            counts = (bounds[:on, 0] <= t) & (t < bounds[:on, 1])
            some = not counts.all()
            if t:
                beta *= self.emit.take(flat[here], axis=0)
                beta /= scales[here][:, None]
                into = beta * counts[:, None] if some else beta
                moves += rows[at[t - 1] : at[t - 1] + on].T @ into
                beta[:] = beta @ self.move.T
            if some:
                alpha *= counts[:, None]
        size = len(self.emit)
        emits = np.column_stack([np.bincount(flat, rows[:, k], size) for k in range(STATES)])
        return rows[: len(length)][opens].sum(axis=0), moves * self.move, emits


def train(sequences: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training sequences, its counts summed over the partitions."""
    size = known.size
    model = Model.first(known.frequency)
    columns = ", ".join(f"s{k} double" for k in range(STATES))

    def step(model: Model) -> Model:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((size + STATES + 1, STATES))

            def flush(parts: list, opens: list, bounds: list) -> None:
                start, moves, emits = model.expected(parts, np.array(opens), np.array(bounds))
                counts[:size] += emits
                counts[size : size + STATES] += moves
                counts[size + STATES] += start

            parts, opens, bounds, held = [], [], [], 0
            for batch in batches:
                for packed in batch.column(0):
                    symbols = np.frombuffer(packed.as_buffer(), np.uint16)
                    for first in range(0, len(symbols), SEGMENT):
                        low = max(0, first - CARRY)
                        parts.append(symbols[low : first + SEGMENT + CARRY])
                        opens.append(first == 0)
                        bounds.append((first - low, min(len(symbols), first + SEGMENT) - low))
                        held += len(parts[-1])
                        if held >= GROUP:
                            flush(parts, opens, bounds)
                            parts, opens, bounds, held = [], [], [], 0
            if parts:
                flush(parts, opens, bounds)
            at = np.flatnonzero(counts.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), *(pa.array(counts[at, k]) for k in range(STATES))],
                names=["place", *(f"s{k}" for k in range(STATES))],
            )

        made = sequences.filter("NOT held_out").select("symbols").mapInArrow(add, f"place int, {columns}")
        sums = made.groupBy("place").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES))).toArrow()  # a row per symbol
        counts = np.zeros((size + STATES + 1, STATES))
        for k in range(STATES):
            counts[sums["place"].to_numpy(), k] = sums[f"s{k}"].to_numpy()
        return Model.from_counts(counts[size + STATES], counts[size : size + STATES], counts[:size], known.frequency)

    for _ in range(rounds if known.tokens else 0):
        model = step(model)
    return model


def forward(sequences: DataFrame, model: Model) -> DataFrame:
    """The sequences' own columns and likelihood (log10) of their symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            score = model.log10([np.frombuffer(s.as_buffer(), np.uint16) for s in rows.column(0)])
            return pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(score)], names=[*rows.schema.names[1:], "likelihood"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(0).nbytes // 2
            if size >= SCORE_GROUP:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    kept = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, within double"
    names = [c.split()[0] for c in kept.split(", ")]
    return sequences.select("symbols", *names).mapInArrow(run, f"{kept}, likelihood double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    counts = count_words(docs)
    ends = docs.filter(~held_out(MODULUS, REMAINDER)).count()
    known = Vocabulary(counts, ends)
    sequences = encode(docs, known)
    model = train(sequences, known)
    # Rarer words get their counts by a join; what they add is summed for each text.
    class_size = F.array(*[F.lit(float(x)) for x in known.class_size])
    rare = sequences.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.class").alias("class"), F.col("x.n").alias("times"))
    n = F.coalesce("n", F.lit(0))
    added = (
        rare.join(counts.select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(known.norm)))).alias("rare_base"),
            F.sum(F.col("times") * F.log10((n + 1) / F.get(class_size, F.col("class")))).alias("rare_within"),
        )
    )
    zero = F.lit(0)
    return (
        forward(sequences, model)
        .join(added, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
            F.lit(known.tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
            (F.col("likelihood") + F.col("within") + F.coalesce("rare_within", zero)).alias("score"),
        )
    )
