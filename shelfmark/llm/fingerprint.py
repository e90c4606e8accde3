"""MinHash fingerprints of documents, and near pairs by banded signatures with verified Jaccard similarity.

A text's shingles of five words pass through PERMUTATIONS universal hash functions (multiply, add, take the high
half); a fingerprint keeps the low 16 bits of each least value. The likeness of two fingerprints is their share of
equal entries, corrected for chance. Texts without words have a fingerprint of their own kind, and likeness 1 to each
other, 0 to any other.

Defined results: a null text is an empty one; a null doc_id comes first in the order; repeated doc_ids are ordered by
their text; in a table of one row the row is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import pieces_of, seeds, slices_by_size, text_of
from shelfmark.llm.near import bands_of, near_links
from shelfmark.llm.shingles import shingles

PERMUTATIONS = 128
BANDS = 32  # of 4 rows: a pair at 0.8 is missed with a probability of 5e-8
BITS = 16
SEED = 1
PARTITION_CHARS = 8_000_000
NOTHING = 1 << 32


def signatures(texts: pa.Array, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Least value (32 bits) of every permutation, a row per text; a text without words has NOTHING throughout."""
    hashes, number = shingles(texts)
    a, b = seeds(permutations, SEED) | np.uint64(1), seeds(permutations, SEED + 1)
    out = np.full((len(number), permutations), NOTHING, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(number)])
    half = np.uint64(32)
    for first, last in slices_by_size(offsets, 1 << 15):
        some = hashes[offsets[first] : offsets[last]]
        full = np.flatnonzero(number[first:last]) + first
        if not len(full):
            continue
        at = offsets[full] - offsets[first]
        buffer = np.empty_like(some)
        for p in range(permutations):
            np.multiply(some, a[p], out=buffer)
            np.add(buffer, b[p], out=buffer)
            out[full, p] = np.minimum.reduceat(buffer, at) >> half
    return out


def compact(signature: np.ndarray) -> np.ndarray:
    """The low bits that a fingerprint keeps; an empty text's entries become its mark."""
    kept = (signature & np.uint64((1 << BITS) - 1)).astype(np.uint16)
    kept[signature[:, 0] == NOTHING] = np.uint16((1 << BITS) - 1)
    return kept


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of compact signatures, row by row."""
    equal = (a == b).mean(axis=1)
    chance = 2.0**-BITS
    none = (a == a[:, :1]).all(axis=1) & (a[:, 0] == (1 << BITS) - 1)
    other = (b == b[:, :1]).all(axis=1) & (b[:, 0] == (1 << BITS) - 1)
    return np.where(none | other, (none & other).astype(float), np.clip((equal - chance) / (1 - chance), 0, 1))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of consecutive texts; the last one is only there for the one before it."""
    changed = [edited(t, n) for t, n in zip(texts, texts[1:], strict=False)]
    own = compact(signatures(pa.array(texts, pa.large_string())))
    new = compact(signatures(pa.array(changed, pa.large_string())))
    n = len(texts) - 1
    text = lambda rows: pa.array([r.tobytes().hex() for r in rows.astype(">u2")], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            text(own[:n]),
            text(new),
            pa.array(likeness(own[:n], new)),
            pa.array(likeness(own[:n], own[1:])),
        ],
        names=[c.split()[0] for c in RESULT.split(",")],
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, which ends as the next document begins (by doc_id).

    The ids alone are sorted first, to learn the range partitions' first ids (one per partition, on the driver). The
    texts are then dealt out once, by those ids; each range's first document also goes to the range before it.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    chars = rows.select(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    parts = max(1, chars // PARTITION_CHARS)
    ranged = rows.select("doc_id").repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("part"))
    found = ranged.groupBy("part").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("known")).collect()
    firsts = np.array(sorted({r["first"] for r in found if r["known"]}), np.int64)
    ranges = max(1, len(firsts))
    has_null = rows.filter("doc_id IS NULL").limit(1).count() > 0
    bounds = firsts if len(firsts) else np.zeros(1, np.int64)

    @F.pandas_udf("array<int>")
    def places(ids):
        import pandas as pd

        known, value = ids.notna().to_numpy(), ids.fillna(0).astype("int64").to_numpy()
        part = np.where(known, np.maximum(np.searchsorted(bounds, value, "right") - 1, 0), 0)
        opens = known & (value == bounds[part])
        if has_null:
            opens = np.where(part == 0, ~known, opens)
        both = zip(part.tolist(), opens.tolist(), strict=True)
        return pd.Series([[p, ranges + (p - 1) % ranges] if o else [p] for p, o in both])

    # A place of `ranges` or more marks the first document of the range that follows, for the range before it.
    dealt = (
        rows.withColumn("place", F.explode(places("doc_id")))
        .withColumn("after", F.col("place") >= ranges)
        .withColumn("part", F.col("place") % ranges)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, closed = None, [], [], False
        for batch in pieces_of(batches, 2 << 20):
            for p, after, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part:
                    part, ids, texts, closed = p, [], [], False
                if closed:  # further rows with the id of the next range's first document
                    continue
                ids.append(doc_id)
                texts.append(text)
                closed = after
                if len(texts) > 1 and (after or sum(map(len, texts)) >= 2 << 20):
                    yield _compare(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
            if len(texts) > 1:
                yield _compare(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    ordered = (
        dealt.select("part", "after", "doc_id", "text")
        .repartition(ranges, "part")
        .sortWithinPartitions("part", "after", "doc_id", "text")
    )
    return ordered.mapInArrow(compare, RESULT)


def sign(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Compact signatures and band keys; a text without words has band keys of 0."""
    signature = signatures(texts)
    kept = compact(signature)
    bands = bands_of(kept, PERMUTATIONS // BANDS)
    bands[signature[:, 0] == NOTHING] = 0
    return kept, bands


def near_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies (doc_id, rep), links (a, b, similarity) between them and their components (node, root).

    Signature bands are joined in Spark and the Jaccard similarity of every candidate pair is verified on whole texts.
    """
    return near_links(docs, sign, multiset=False)
