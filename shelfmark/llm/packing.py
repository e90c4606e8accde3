"""Packing documents into token windows by lexical retrieval.

All documents are grouped by lexical nearness first, over the whole table. A document's BM25 vector, projected to few
dimensions, goes to the nearest of the cells that k-means finds in a sample. Documents that overlap (that share one of
BANDS pairs of minima over their runs of RUN ids) go where the one among them with the least hash goes, so copies and
near copies aren't parted by a border between cells. Small cells share a shard; hot ones are split by the second nearest
cell, then by content, then evenly. A shard, of bounded size, holds a BM25 inverted index of its documents' token ids,
weighted by document frequencies over the whole table. A seed
document opens a window; the index ranks all unused documents by all of the seed's terms, and the best of them fill the
window greedily. The last one is cut where the window ends, and its rest seeds the next window. Only a shard's last
window can be short, and those which no document left shares an id with.

Defined results: a null text is empty and holds just the end id; repeated rows are packed as often as they occur; a
null doc_id is kept; a document of more than CHUNK ids is dealt out in chunks; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import mix64, pieces_of, slices_by_size, stored
from shelfmark.llm.tokens import counted, stored_tokens, token_counts

WINDOW = 2048
SHARD_TOKENS = 2_000_000
CHUNK = 1 << 18
QUERY_TERMS = 1 << 16  # a seed's terms that are looked up: all
DENSE = 16  # a term in more than this part of the documents has a row over all of them
SUMMED_BYTES = 1 << 20  # of rows that are added together
STEP = 64  # candidates that are sorted at a time
DIMENSIONS = 64  # of the projected vectors that cells are made of
MOST_CELLS = 4096  # they travel with the job; larger tables have more shards a cell
CELL_SAMPLE = 32  # sampled documents a cell
ROUNDS = 10  # of k-means
SIDES = 64  # parts of a hot cell, by the second nearest one
FINE = 16  # parts by content of a hot one of these
SLICE_IDS = 1 << 18  # ids whose runs are hashed at a time
RUN = 4  # ids in a row, for overlaps
BANDS = 8  # keys of a document that overlapping ones share, two minima each
MOST_BROADCAST = 500_000  # overlapping documents whose places travel to all tasks; more are joined by a shuffle
K1, B = 1.2, 0.75
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


class Index:
    """BM25 postings of one shard, by term and by document."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        doc, self.term, count = counted(ids)
        length = np.array([len(x) for x in ids], np.float64)
        norm = K1 * (1 - B + B * length / max(mean_length, 1.0))
        self.weight = idf[self.term] * count * (K1 + 1) / (count + norm[doc])
        self.begin = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.doc = doc
        self.order = np.argsort(self.term.astype(np.uint16), kind="stable")  # by radix
        self.slot = np.arange(len(ids))  # where a document's scores lie; kept() closes the gaps
        self.docs = len(ids)
        self._post(self.order)

    def _post(self, order: np.ndarray) -> None:
        """Postings by term; those of a term in many documents as a row over all of them."""
        term, doc, weight = self.term[order], self.slot[self.doc[order]], self.weight[order]
        self.by_term, self.by_weight = doc, weight
        self.first = np.searchsorted(term, np.arange((1 << 16) + 1))
        number = np.diff(self.first)
        frequent = np.flatnonzero(number * DENSE > self.docs)
        self.row = np.full(1 << 16, -1)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.docs))
        some = self.row[term] >= 0
        self.rows[self.row[term[some]], doc[some]] = weight[some]

    def kept(self, unused: np.ndarray) -> None:
        """Leave the postings of used documents."""
        self.order = self.order[unused[self.doc[self.order]]]
        self.slot = np.cumsum(unused) - 1
        self.docs = int(unused.sum())
        self._post(self.order)

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """BM25 of every unused document for the seed's terms; 0 for others."""
        own = slice(self.begin[seed], self.begin[seed + 1])
        terms, weights = self.term[own], self.weight[own]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-weights, QUERY_TERMS)[:QUERY_TERMS]]
        row = self.row[terms]
        rare = terms[row < 0]
        score = self._summed(row[row >= 0])
        if len(rare):
            lists = list(map(slice, self.first[rare].tolist(), self.first[rare + 1].tolist()))
            docs = np.concatenate([self.by_term[x] for x in lists])
            score += np.bincount(docs, np.concatenate([self.by_weight[x] for x in lists]), self.docs)
        return np.where(unused, score[np.minimum(self.slot, self.docs - 1)], 0.0)

    def _summed(self, rows: np.ndarray) -> np.ndarray:
        """The sum of these rows in their order, some at a time that stay in the cache."""
        step = max(1, SUMMED_BYTES // 8 // max(1, self.docs))
        some, out = np.empty((min(step, len(rows)) + 1, self.docs)), np.zeros(self.docs)
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            some[0] = out
            np.take(self.rows, part, axis=0, out=some[1 : len(part) + 1], mode="clip")
            np.add.reduce(some[: len(part) + 1], axis=0, out=out)
        return out

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; ties by place. Sorted as far as they are asked for."""
        score = self.scores(seed, unused)
        found = np.flatnonzero(score)
        while len(found):
            least = np.partition(score[found], -STEP)[-STEP] if len(found) > STEP else 0.0
            best = found[score[found] >= least]
            yield from best[np.lexsort((best, -score[best]))].tolist()
            found = found[score[found] < least]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        return np.array(list(self.ranked(seed, unused)), np.int64)


def projection(seed: int = 7) -> np.ndarray:
    """A row of random signs per token id."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (1 << 16, DIMENSIONS))


class Sketch:
    """Unit vectors of few dimensions that keep the cosines of documents' BM25 vectors nearly."""

    def __init__(self, idf: np.ndarray, mean_length: float):
        self.idf, self.mean_length, self.signs = idf, max(mean_length, 1.0), projection()

    def vectors(self, ids: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(ids), DIMENSIONS), np.float32)
        doc, term, count = counted(ids)
        norm = K1 * (1 - B + B * np.array([len(x) for x in ids], np.int64) / self.mean_length)
        weight = (self.idf[term] * count * (K1 + 1) / (count + norm[doc])).astype(np.float32)
        begin = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
        for i, (low, high) in enumerate(zip(begin, begin[1:])):
            out[i] = weight[low:high] @ self.signs[term[low:high]]
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def centres_of(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of spherical k-means, in an order in which neighbours are alike."""
    rng = np.random.default_rng(11)
    centres = vectors[np.sort(rng.choice(len(vectors), min(cells, len(vectors)), replace=False))]
    for _ in range(ROUNDS):
        home, _ = two_nearest(vectors, centres)
        order = np.argsort(home, kind="stable")
        held, at = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(vectors[order], at, axis=0)
        centres = centres.copy()
        centres[held] = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    chain, left = [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        chain.append(int(np.where(left, centres @ centres[chain[-1]], -2).argmax()))
        left[chain[-1]] = False
    return centres[chain]


def two_nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, side = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
    for at in range(0, len(vectors), 2048):
        cosine = vectors[at : at + 2048] @ centres.T
        cell[at : at + 2048] = best = cosine.argmax(axis=1)
        cosine[np.arange(len(cosine)), best] = -2
        side[at : at + 2048] = cosine.argmax(axis=1)
    return cell, side


def overlap_keys(ids: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each document; the more runs of RUN ids two documents share, the likelier they share a key."""
    data = np.concatenate([*ids, np.zeros(RUN - 1, np.uint16)]).astype(np.uint64)
    runs = np.zeros(len(data) - RUN + 1, np.uint64)
    for k in range(RUN):
        runs |= data[k : k + len(runs)] << np.uint64(16 * k)
    size = np.array([len(x) for x in ids])
    # A document's last runs would go over its end; one of fewer ids has one run, its first, with what follows cut off.
    number = np.maximum(1, size - RUN + 1)
    first = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(ids)), number)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + first[doc]
    found = runs[at]
    short = (size < RUN)[doc]
    found[short] &= (np.uint64(1) << (np.uint64(16) * size[doc[short]].astype(np.uint64))) - np.uint64(1)
    found = mix64(found + np.uint64(0x9E3779B97F4A7C15))
    bins = 2 * BANDS
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(len(ids) * bins, none)
    np.minimum.at(least, doc * bins + (found & np.uint64(bins - 1)).astype(np.int64), found)
    least = least.reshape(len(ids), bins)
    filled = least.copy()
    for k in range(1, bins):  # an empty bin borrows from the next full one
        filled = np.where(filled == none, np.roll(least, -k, axis=1), filled)
    band = np.arange(BANDS, dtype=np.uint64)
    return mix64(filled[:, 0::2] ^ mix64(filled[:, 1::2] + band)).view(np.int64)


def shards_of(parts: list[tuple[int, int, int, int]]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """First shard and number of shards of every (cell, side, fine), in order, from their ids: (cell, side, fine, ids).

    Parts in order share a shard while they fit it; one that is larger by itself has several. A cell that fits a shard
    isn't divided between two.
    """
    out, shard, filled = {}, 0, 0
    whole: dict[int, int] = {}
    for cell, _, _, n in parts:
        whole[cell] = whole.get(cell, 0) + n
    before = None
    for cell, side, fine, n in sorted(parts):
        fresh = cell != before
        before = cell
        need = whole[cell] if fresh and whole[cell] <= SHARD_TOKENS else n
        if filled and filled + need > SHARD_TOKENS and (fresh or whole[cell] > SHARD_TOKENS):
            shard, filled = shard + 1, 0
        many = max(1, -(-n // (2 * SHARD_TOKENS)))
        out[cell, side, fine] = (shard, many)
        shard, filled = (shard + many, 0) if many > 1 else (shard, filled + n)
    return out


def pack(ids: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, its ids before, length, sequence, offset) that fill windows of one shard's documents."""
    index = Index(ids, idf, mean_length)
    done = np.zeros(len(ids), np.int64)
    size = np.array([len(x) for x in ids], np.int64)
    unused = size > 0
    out: list[tuple[int, int, int, int, int]] = []
    sequence = offset = 0

    def place(i: int) -> bool:
        """Put what fits of document i into the open window; whether all of it is placed now."""
        nonlocal sequence, offset
        n = int(min(window - offset, size[i] - done[i]))
        out.append((i, int(done[i]), n, sequence, offset))
        done[i] += n
        offset += n
        if offset == window:
            sequence, offset = sequence + 1, 0
        unused[i] = done[i] < size[i]
        return not unused[i]

    cut, following = None, 0
    while True:
        if cut is None:
            while following < len(ids) and not unused[following]:
                following += 1
            if following == len(ids):
                return out
        seed, cut = (following if cut is None else cut), None
        while not place(seed):
            pass
        if offset and (number := int(unused.sum())):
            if number <= index.docs * 3 // 4:
                index.kept(unused)
            for i in index.ranked(seed, unused):
                whole = place(i)
                if offset == 0:
                    cut = None if whole else i
                    break


def packed(docs: DataFrame, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece of a document: where it lies in it, its crc32, its sequence and place there."""
    tokens = stored_tokens(docs, end_id)
    frequency = token_counts(tokens, per_document=True)
    count, total = tokens.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    shards = max(1, (total or 0) // SHARD_TOKENS)
    idf = np.log1p((count - frequency + 0.5) / (frequency + 0.5))
    mean_length = (total or 0) / max(1, count)

    cells = min(shards, MOST_CELLS)
    centres = None
    if shards > 1:
        # Copies of a text are sampled once.
        content = F.xxhash64("ids", F.lit(3))
        place = F.shiftrightunsigned(content, 2) / F.lit(float(1 << 62))
        sample = tokens.withColumn("content", content).filter(place < min(1.0, CELL_SAMPLE * cells / count))

        def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketch = Sketch(idf, mean_length)
            for batch in batches:
                ids = [np.frombuffer(x.as_buffer(), np.uint16)[:CHUNK] for x in batch.column(1)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                found = [v.tobytes() for a, b in slices_by_size(at, SLICE_IDS) for v in sketch.vectors(ids[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["content", "vec"])

        rows = sample.select("content", "ids").mapInArrow(sketched, "content bigint, vec binary")
        rows = rows.groupBy("content").agg(F.min("vec").alias("vec")).orderBy("content").collect()  # about CELL_SAMPLE a cell
        if len(rows) > 1:
            centres = centres_of(np.array([np.frombuffer(r.vec, np.float32) for r in rows]), cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(idf, mean_length) if centres is not None and len(centres) > 1 else None
        # The order of parts that are split evenly, begun at a place of the partition's own.
        turn = TaskContext.get().partitionId() * 7919
        for batch in pieces_of(batches, 2 * SLICE_IDS, "ids"):
            rows, parts = [], []
            for doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                packed_ids = ids.as_buffer()
                for start in range(0, n, CHUNK):
                    turn += 1
                    part = packed_ids[2 * start : 2 * min(n, start + CHUNK)].to_pybytes()
                    parts.append(np.frombuffer(part, np.uint16))
                    rows.append((zlib.crc32(part) % FINE, turn, doc_id, start, n, part))
            if not rows:
                continue
            cell = side = np.zeros(len(rows), np.int64)
            keys = np.zeros((len(rows), 0), np.int64)
            if shards > 1:
                at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                keys = np.concatenate([overlap_keys(parts[a:b]) for a, b in slices_by_size(at, SLICE_IDS)])
            if sketch:
                vectors = [sketch.vectors(parts[a:b]) for a, b in slices_by_size(at, SLICE_IDS)]
                cell, side = two_nearest(np.concatenate(vectors), centres)
                side = side * SIDES // len(centres)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)]
            cuts = pa.array(np.arange(len(rows) + 1) * keys.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(side), *columns, pa.ListArray.from_arrays(cuts, pa.array(keys.ravel()))],
                names=["cell", "side", "fine", "turn", "doc_id", "before", "doc_tokens", "ids", "keys"],
            )

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("before", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), np.uint16) for c in table["ids"].chunks for x in c]
        pieces = pack(ids, idf, mean_length, window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        crc = [zlib.crc32(ids[i][s : s + n].astype(np.uint32).tobytes()) for i, s, n, _, _ in pieces]
        rows = table.select(["doc_id", "before", "doc_tokens", "shard"]).take(pa.array(doc))
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "start": pa.array(start + rows["before"].to_numpy()),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": rows["doc_tokens"],
                "sequence_id": pa.array((rows["shard"].to_numpy() << 32) + sequence),
                "offset": pa.array(offset),
            }
        )

    dealt = tokens.mapInArrow(
        deal,
        "cell bigint, side bigint, fine bigint, turn bigint, doc_id bigint, before bigint, doc_tokens bigint, ids binary, keys array<bigint>",
    )
    return with_shards(dealt, shards).groupBy("shard").applyInArrow(fill, PIECES)


def with_shards(dealt: DataFrame, shards: int) -> DataFrame:
    """The rows of dealt with their shard."""
    columns = ["shard", "doc_id", "before", "doc_tokens", "ids"]
    if shards == 1:
        return dealt.withColumn("shard", F.lit(0).cast("bigint")).select(columns)
    spark = dealt.sparkSession
    number = (F.length("ids") / 2).cast("bigint")  # sums needn't read the ids
    dealt = stored(dealt.withColumns({"content": F.xxhash64("ids"), "number": number}), "packing-cells")
    place = F.struct("content", "cell", "side", "fine")
    keyed = dealt.select("content", place.alias("place"), F.explode("keys").alias("key"))
    # Copies of a text have all keys in common: they count once.
    keyed = keyed.groupBy("key", "content").agg(F.min("place").alias("place"))
    shared = keyed.groupBy("key").agg(F.min("place").alias("lead"), F.max("content").alias("last")).filter("lead.content < last")
    leads = keyed.join(shared, "key").groupBy("content").agg(F.min("lead").alias("lead")).filter("lead.content < content")
    leads = stored(leads.select("content", "lead"), "packing-leads")
    if leads.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        leads = F.broadcast(leads)
    dealt = dealt.join(leads, "content", "left")
    own = {c: F.coalesce(F.col(f"lead.{c}"), F.col(c)) for c in ("cell", "side", "fine")}
    dealt = dealt.select(*[x.alias(c) for c, x in own.items()], "turn", "doc_id", "before", "doc_tokens", "ids", "number")
    ids = F.sum("number").alias("n")
    # Only what is hot is divided: a cell by sides, a side by content. At most MOST_CELLS * SIDES rows, then FINE a shard.
    sums = [tuple(r) for r in dealt.groupBy("cell", "side").agg(ids).collect()]
    whole: dict[int, int] = {}
    for cell, _, n in sums:
        whole[cell] = whole.get(cell, 0) + n
    split = [(c, s, s if whole[c] > SHARD_TOKENS else -1, n > SHARD_TOKENS) for c, s, n in sums]
    split = spark.createDataFrame(split, "cell bigint, side bigint, by_side bigint, hot boolean")
    dealt = dealt.join(F.broadcast(split), ["cell", "side"])
    dealt = dealt.withColumn("by_fine", F.when(F.col("hot"), F.col("fine")).otherwise(F.lit(-1).cast("bigint")))
    parts: dict[tuple[int, int, int], int] = {}
    for cell, side, n in sums:
        if n <= SHARD_TOKENS:
            key = (cell, side if whole[cell] > SHARD_TOKENS else -1, -1)
            parts[key] = parts.get(key, 0) + n
    if any(n > SHARD_TOKENS for *_, n in sums):
        for r in dealt.filter("hot").groupBy("cell", "side", "by_fine").agg(ids).collect():
            parts[r.cell, r.side, r.by_fine] = r.n
    rows = [(*k, *v) for k, v in shards_of([(*k, n) for k, n in parts.items()]).items()]
    known = spark.createDataFrame(rows, "cell bigint, by_side bigint, by_fine bigint, first bigint, many bigint")
    dealt = dealt.join(F.broadcast(known), ["cell", "by_side", "by_fine"])
    return dealt.withColumn("shard", F.col("first") + F.pmod("turn", "many")).select(columns)
