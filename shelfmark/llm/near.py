"""Near-duplicate classes from banded signatures, with every candidate pair verified on whole texts.

Copies of a text are one class from the start. Signatures of the classes' least documents are banded; documents
that agree in a band share a bucket. First each bucket's members are compared with its least member; the verified
links are contracted to components. Only buckets in which several components remain are looked at again: all their
pairs across components whose signatures agree enough are verified on the spot (large buckets in slices of bounded
rows and bytes, so that no task holds a whole one), and those that link give the rest of the classes. Pairs inside a component can't change the
result and are left out.

Joins that carry a bucket or its least member spread hot keys over several tasks.

A pair is dropped unverified only if its signatures agree in fewer entries than the threshold less four standard
deviations, or if it agrees in no band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import mix64, pieces_of, stored, text_of
from shelfmark.llm.components import components
from shelfmark.llm.shingles import shingles

SIMILARITY = (4, 5)  # the least similarity, as a fraction
SLICE = 1024  # members of a bucket that a task compares with as many others, at most
SLICE_BYTES = 4 << 20  # of their shingles
TOGETHER = 1 << 18  # shingles that are looked up at a time
SPREAD = 2048  # rows of a join key that stay together
PIECE = 1 << 20  # bytes of text that are signed at a time: it takes some fifty times as much memory
Sign = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per text and band of `rows` signature entries; the band's number is part of it."""
    n, m = signature.shape
    bands = m // rows
    parts = signature[:, : bands * rows].astype(np.uint64).reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def classes_of_copies(docs: DataFrame) -> DataFrame:
    """doc_id and rep: the least doc_id of its text's copies. Rows that share a doc_id are one document."""
    keys = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text_of()).alias("key"))
    single = stored(keys.groupBy("doc_id").agg(F.min("key").alias("key")), "text-keys")
    reps = single.groupBy("key").agg(F.min("doc_id").alias("rep"))
    return stored(single.join(reps, "key").select("doc_id", "rep", "key"), "copies")


def signed(docs: DataFrame, copies: DataFrame, sign: Sign) -> DataFrame:
    """rep, signature and bands of every class of copies that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, PIECE):
            signature, bands = sign(batch.column(2))
            full = np.flatnonzero(bands[:, 0] != 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(full)), batch.column(1).take(pa.array(full)),
                    pa.array([signature[i].tobytes() for i in full], pa.binary()),
                    pa.array(list(bands[full]), pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "signature", "bands"],
            )

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text_of()).alias("key"), text_of().alias("text"))
    made = rows.mapInArrow(run, "doc_id bigint, key string, signature binary, bands array<bigint>")
    own = copies.filter("doc_id = rep").select("doc_id", "key")
    single = made.join(own, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    return stored(single.select(F.col("doc_id").alias("rep"), "signature", "bands"), "signatures")


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has one row per key; the rows of a hot key are spread by a hash of another column.

    counts: key and n, the rows of left per key, if they are known.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = stored(counts.filter(F.col("n") > SPREAD).select(key, F.ceil(F.col("n") / SPREAD).cast("int").alias("parts")), "hot-keys")
    parts = F.coalesce("parts", F.lit(1))
    many = left.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    one = right.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return many.join(one, [key, "part"]).drop("part")


def buckets(signatures: DataFrame) -> DataFrame:
    """key, band, rep and least of every bucket with several members."""
    each = signatures.select(F.posexplode("bands").alias("band", "key"), "rep")
    several = each.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("n"))
    several = stored(several.filter("least < most").select("key", "least", "n"), "bucket-keys")
    return stored(spread_join(each, several.select("key", "least"), "key", "rep", several), "buckets")


def least_agreement(entries: int) -> int:
    s = SIMILARITY[0] / SIMILARITY[1]
    return int(np.floor(entries * s - 4 * np.sqrt(entries * s * (1 - s))))


def agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs a, b whose signatures agree enough to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(i)) for i in (2, 3))
            keep = np.flatnonzero((x == y).sum(axis=1) >= least_agreement(x.shape[1])) if len(x) else np.zeros(0, np.int64)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    one = signatures.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    two = signatures.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    both = spread_join(pairs.join(two, "b"), one, "a", "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.uint16)


def shingle_sets(docs: DataFrame, ids: DataFrame, multiset: bool) -> DataFrame:
    """rep and the packed, sorted 32-bit hashes of its shingles, for the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, PIECE):
            hashes, number = shingles(batch.column(1))
            ends = np.cumsum(number)
            out = []
            for e, n in zip(ends, number, strict=True):
                some = (hashes[e - n : e] >> np.uint64(32)).astype(np.uint32)
                out.append((np.sort(some) if multiset else np.unique(some)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rep", "hashes"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.md5(text_of()).alias("key"), text_of().alias("text"))
    chosen = rows.join(ids, ["rep", "key"], "left_semi").dropDuplicates(["rep"])
    return stored(chosen.select("rep", "text").mapInArrow(run, "rep bigint, hashes binary"), "shingles")


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and union of two multisets."""
    a, n = np.unique(x, return_counts=True)
    b, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both, len(x) + len(y) - both


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose (weighted) Jaccard similarity reaches the threshold, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            for left, right, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                both, union = overlap(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))
                if both * SIMILARITY[1] >= union * SIMILARITY[0]:
                    a.append(left)
                    b.append(right)
                    s.append(both / union)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    pairs = stored(pairs, "pairs")
    joined = spread_join(pairs.join(sets.toDF("b", "y"), "b"), sets.toDF("a", "x"), "a", "b", pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    joined = joined.select("a", "b", "x", "y")
    return stored(joined.mapInArrow(run, "a bigint, b bigint, similarity double"), "links")


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """A sorted multiset as a set: each hash with the number of its occurrence."""
    first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint32(1)))
    nth = np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))
    return (hashes.astype(np.uint64) << np.uint64(32)) | nth.astype(np.uint64)


def across(members: DataFrame, roots: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, verified; as many as connect what they connect.

    A pair is looked at in the first band in which it agrees only. Its similarity is computed where its bucket's
    members meet, so pairs that fail are never rows.
    """
    placed = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = placed.join(sets.select("rep", F.octet_length("hashes").alias("bytes")), "rep")
    placed = stored(placed.select("key", "band", "rep", "root", "bytes"), "placed")
    mixed = stored(
        placed.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        .filter("low < high")
        .select("key", "n", F.greatest(F.ceil(F.col("n") / SLICE), F.ceil(F.col("bytes") / SLICE_BYTES)).cast("int").alias("slices")),
        "mixed",
    )
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    rows = (
        spread_join(placed.drop("bytes"), mixed.select("key", "slices"), "key", "rep", mixed)
        .join(signatures.select("rep", "signature", F.size("bands").alias("bands")), "rep")
        .join(sets, "rep")
        .withColumn("own", own)
        .withColumn("other", other)
        .select(
            "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
            "band", "bands", "rep", "root", "signature", "hashes",
        )
    )

    def run(table: pa.Table) -> pa.Table:
        i, j, band, bands = (table[c][0].as_py() for c in ("i", "j", "band", "bands"))
        own, rep, root = (table[c].to_numpy().copy() for c in ("own", "rep", "root"))
        matrix = _matrix(table["signature"])
        width = matrix.shape[1] // bands
        banded = matrix[:, : bands * width].reshape(len(matrix), bands, width)
        sets = [_numbered(np.frombuffer(h.as_buffer(), np.uint32)) for h in table["hashes"]]
        right, low, links = np.flatnonzero(own == j), least_agreement(matrix.shape[1]), []
        for at in np.flatnonzero(own == i):
            some = right[(root[right] != root[at]) & ((i != j) | (right > at))]
            some = some[(matrix[some] == matrix[at]).sum(axis=1) >= low]
            if not len(some):
                continue
            some = some[(banded[some] == banded[at]).all(axis=2).argmax(axis=1) == band]
            if not len(some):
                continue
            length = np.array([len(sets[x]) for x in some])
            both = np.zeros(len(some), np.int64)
            part = np.cumsum(length) // TOGETHER
            for p in np.unique(part):
                few = np.flatnonzero(part == p)
                same = np.isin(np.concatenate([sets[x] for x in some[few]]), sets[at], kind="sort")
                both[few] = np.bincount(np.repeat(np.arange(len(few)), length[few]), same, len(few))
            union = length + len(sets[at]) - both
            for n in np.flatnonzero(both * SIMILARITY[1] >= union * SIMILARITY[0]):
                x = some[n]
                if root[x] != root[at]:
                    links.append((min(rep[at], rep[x]), max(rep[at], rep[x]), both[n] / union[n]))
                    root[root == root[x]] = root[at]
        a, b, similarity = zip(*links, strict=True) if links else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(similarity, pa.float64())})

    return stored(rows.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint, similarity double"), "links")


def near_links(docs: DataFrame, sign: Sign, multiset: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """copies (doc_id, rep), verified links (a, b, similarity) between representatives, roots (node, root) of them.

    Links inside a component that others already connect may be missing; no component is.
    """
    copies = classes_of_copies(docs)
    signatures = signed(docs, copies, sign)
    members = buckets(signatures)
    # Their texts are read once, for both rounds.
    ids = members.select("rep").distinct().join(copies.filter("doc_id = rep").select("rep", "key"), "rep")
    sets = shingle_sets(docs, ids, multiset)
    star = members.filter("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(agreeing(star, signatures), sets)
    more = across(members, components(links.select("a", "b")), signatures, sets)
    links = links.unionByName(more)
    return copies, links, components(links.select("a", "b"))


def near_classes(docs: DataFrame, sign: Sign, multiset: bool) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row with a doc_id."""
    copies, _, roots = near_links(docs, sign, multiset)
    return copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("root", "rep").alias("class_id")
    )
