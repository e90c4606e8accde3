"""Token-id files coded by a static range asymmetric numeral system.

One frequency table is shared by all files. The ids of all documents, in ascending order of doc_id, are dealt out to
range partitions; each partition's stream is cut into blocks of BLOCK ids, coded on their own. In a block, id i
belongs to lane i mod LANES; the lanes' states advance together, as numpy vectors. A block holds its documents'
pieces, its coded words, the lanes' first states, further states every SEGMENT steps (so that a block can be read
from there on, or by several readers), and the crc32 of each segment's ids.

A state is below 2^63 and refilled by 32 bits; frequencies sum to 2^SCALE.

Defined results: a null text is empty and holds just the end id; a null doc_id comes first; repeated doc_ids stand
side by side, ordered by their ids' bytes, each with a start of its own; an empty table gives no rows; long texts
run over as many blocks as they need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.llm.tokens import stored_tokens, token_counts

SCALE = 20
LANES = 1024
BLOCK = 1 << 18
SEGMENT = 128  # steps between checkpoints
LOW = np.uint64(1 << 31)
PARTITION_TOKENS = 4_000_000
MASK = np.uint64((1 << SCALE) - 1)
BLOCKS = (
    "part int, block int, first bigint, n bigint, doc_id array<bigint>, ordinal array<bigint>, piece array<bigint>,"
    " length array<bigint>, words binary, states array<binary>, positions array<bigint>, crcs array<bigint>"
)
PIECES = "part int, ordinal bigint, doc_id bigint, first bigint, n bigint, crc bigint"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2^SCALE, at least 1 where the count is not 0."""
    total, size = int(counts.sum()), 1 << SCALE
    if total == 0:
        return np.zeros(len(counts), np.uint64)
    scaled = np.maximum(counts * (size / total), 1).astype(np.int64) * (counts > 0)
    over = int(scaled.sum()) - size
    order = np.argsort(-scaled, kind="stable")
    if over < 0:
        scaled[order[0]] -= over
    while over > 0:  # rare ids were lifted to 1: the frequent ones pay
        room = np.clip(scaled[order] - 1, 0, max(1, over // 64))
        take = np.minimum(room, np.maximum(over - (np.cumsum(room) - room), 0))
        scaled[order] -= take
        over -= int(take.sum())
    return scaled.astype(np.uint64)


class Coder:
    """Codes blocks of ids with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq
        self.start = np.cumsum(freq, dtype=np.uint64) - freq
        self.most = freq << np.uint64(63 - SCALE)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, list[bytes], list[int], list[int]]:
        """Coded words, and per segment: the states to begin it with, its place in the words, its crc32."""
        steps = -(-len(ids) // LANES)
        state = np.full(LANES, LOW, np.uint64)
        words, states, after = [], [], []
        f, c, most = self.freq[ids], self.start[ids], self.most[ids]
        for t in range(steps - 1, -1, -1):
            at = slice(t * LANES, min((t + 1) * LANES, len(ids)))
            ft, x = f[at], state[: at.stop - at.start]
            full = x >= most[at]
            words.append(x[full].astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // ft
            state[: len(ft)] = (q << np.uint64(SCALE)) + (x - q * ft) + c[at]
            if t % SEGMENT == 0:
                states.append(state.tobytes())
                after.append(len(words))
        words.reverse()
        sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        positions = [int(sizes[len(words) - a]) for a in reversed(after)]
        span = SEGMENT * LANES
        raw = ids.astype(np.uint32)
        crcs = [zlib.crc32(raw[s * span : (s + 1) * span].tobytes()) for s in range(len(positions))]
        return b"".join(w.tobytes() for w in words), states[::-1], positions, crcs

    def decode(self, words: bytes, states: list[bytes], positions: list[int], crcs: list[int], n: int) -> np.ndarray:
        """All ids of a block, segment by segment; a segment needs nothing of the ones before it."""
        parts = [self.segment(words, states, positions, crcs, n, s) for s in range(len(positions))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def segment(self, words: bytes, states: list[bytes], positions: list[int], crcs: list[int], n: int, s: int) -> np.ndarray:
        read, at = np.frombuffer(words, np.uint32), positions[s]
        state = np.frombuffer(states[s], np.uint64).copy()
        begin, end = s * SEGMENT * LANES, min((s + 1) * SEGMENT * LANES, n)
        out = np.empty(end - begin, np.uint16)
        for first in range(0, end - begin, LANES):
            m = min(LANES, end - begin - first)
            x = state[:m]
            slot = x & MASK
            sym = self.symbol[slot]
            out[first : first + m] = sym
            x = self.freq[sym] * (x >> np.uint64(SCALE)) + slot - self.start[sym]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << np.uint64(32)) | read[at : at + len(low)]
            at += len(low)
            state[:m] = x
        if zlib.crc32(out.astype(np.uint32).tobytes()) != crcs[s]:
            raise ValueError(f"segment {s} of a block is damaged")
        return out


def join_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings in turn, from their crc32s and the second one's length."""
    zeros = bytes(length)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def write_blocks(tokens: DataFrame, freq: np.ndarray, parts: int) -> DataFrame:
    """The block table of a token table (doc_id, n_tokens, ids), to be written as files."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(freq), TaskContext.get().partitionId()
        schema = blocks_schema
        held, docs, block, size, ordinal = [], [], 0, 0, -1

        def flush():
            nonlocal held, docs, block, size
            words, states, positions, crcs = coder.encode(np.concatenate(held))
            row = {"part": part, "block": block, "first": block * BLOCK, "n": size, "words": words, "states": states}
            row |= {"positions": positions, "crcs": crcs}
            row |= {k: [d[i] for d in docs] for i, k in enumerate(("doc_id", "ordinal", "piece", "length"))}
            held, docs, block, size = [], [], block + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(packed.as_buffer(), np.uint16)
                ordinal, piece, done = ordinal + 1, 0, 0
                while done < len(ids):
                    some = ids[done : done + BLOCK - size]
                    held.append(some)
                    docs.append((doc_id, ordinal, piece, len(some)))
                    size, done, piece = size + len(some), done + len(some), piece + 1
                    if size == BLOCK:
                        yield flush()
        if size:
            yield flush()

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    kinds["array<binary>"] = pa.list_(pa.binary())
    blocks_schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in BLOCKS.split(","))])
    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(encode, BLOCKS)


def read_blocks(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the block table alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["words"], row["states"], row["positions"], row["crcs"], row["n"]).astype(np.uint32)
                ends = np.cumsum(row["length"])
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, row["length"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array(row["ordinal"], pa.int64()),
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(ends - row["length"] + row["first"], pa.int64()),
                        pa.array(row["length"], pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "ordinal", "doc_id", "first", "n", "crc"],
                )

    def joined(rows: list) -> int:
        total = rows[0]["crc"]
        for row in rows[1:]:
            total = join_crc(total, row["crc"], 4 * row["n"])
        return total

    @F.pandas_udf("bigint")
    def whole_crc(pieces):
        return pieces.map(lambda rows: joined(sorted(rows, key=lambda r: r["first"])))

    sizes = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row per partition written
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    bases = sizes.select(F.col("part").alias("of_part"), before.alias("base"))
    pieces = blocks.drop("block").mapInArrow(decode, PIECES)
    gathered = pieces.groupBy("part", "ordinal", "doc_id").agg(
        F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("pieces"),
        F.min("crc").alias("crc"), F.collect_list(F.struct("first", "n", "crc")).alias("all"),
    )
    return (
        gathered.join(bases, F.col("part") == F.col("of_part"))
        .withColumn("ids_crc32", F.when(F.col("pieces") == 1, F.col("crc")).otherwise(whole_crc("all")))
        .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
    )


def round_trip(docs: DataFrame, end_id: int = 2) -> DataFrame:
    """Encode all documents, write the files, read them back."""
    tokens = stored_tokens(docs, end_id)
    counts = token_counts(tokens)
    freq = frequencies(counts)
    parts = max(1, int(counts.sum()) // PARTITION_TOKENS)
    return read_blocks(stored(write_blocks(tokens, freq, parts), "rans-blocks"), freq)
