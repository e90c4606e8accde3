"""Hard negatives: for every anchor and each of its nearest rows of the same label, the best rows of other labels whose
score lies in a window below the positive's.

Vectors become whole numbers, so that scores (inner products) are exact. Rows are laid out once as Parquet, ordered by
vector length, label and the place on a Hilbert curve over the axes that vary most, and cut into blocks of at most
BLOCK rows of one label; the first row of a block carries the block's zone map, its least and greatest value on every
axis. A search then goes in two jobs. The first compares zone maps only with the anchors: by interval arithmetic a
block's scores for an anchor lie between two bounds, and a block is read for a part of the anchors only if, for one of
them, these bounds meet a window. The second reads the chosen blocks, each once for a part, tries them from the highest
bound down, and leaves out, anchor by anchor, those whose bound has fallen below the k-th best score found.

Both jobs are made of cells: a slice of the rows with a part of the anchors, both bounded, so that no task grows with
the table. Each cell gives its best k per window; a rank filter that Spark applies before it shuffles merges them.

Defined results: rows with a null label, vector or vec_id, or with null or non-finite components, take no part; rows
that share a vec_id count once, with the least (label, vector); vectors of different length aren't compared; equal
scores go to the smaller vec_id; an anchor without another row of its label gives no rows; so does an empty table.
Scores that could pass 64 bits raise an error. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import stored
from shelfmark.llm.hilbert import hilbert_places

SCALE = 256  # components are multiplied by it and rounded down
POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90)  # per cent of the positive's score
BLOCK = 1024  # rows of a block
SLICE = 1 << 17  # rows of a slice, about
PART = 1 << 14  # anchors of a part, about
ZONES = 64  # slices whose zone maps are looked at together
CHUNK = 2048  # anchors that a task scores at a time
HELD = 1 << 14  # found pairs that a task gathers before it keeps the best
AXES, BITS = 15, 4  # of the Hilbert curve
EXACT = float(1 << 53)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (as text), dim and vec (packed 64-bit numbers) of every row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = [], []
            for v in batch.column(2):
                values = v.values
                x = None
                if values is not None and not values.null_count:
                    x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                    if not np.isfinite(x).all():
                        x = None
                    elif len(x) and np.abs(x).max() >= 2.0**62:
                        raise ValueError("components too large for exact scores")
                dims.append(None if x is None else len(x))
                out.append(None if x is None else x.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vec"]
            )

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    good = rows.mapInArrow(run, "vec_id bigint, label string, dim int, vec binary").filter("vec IS NOT NULL")
    first = good.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vec")).alias("row"))
    return first.select("vec_id", "row.label", "row.dim", "row.vec")


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.int64).reshape(len(packed), dim)


def _moments(rows: DataFrame) -> DataFrame:
    """dim, axis, mean, deviation of all rows; they decide over the layout only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                x = _matrix(batch.column(1).filter(pa.array(dims == dim)), int(dim)).astype(np.float64)
                held = sums.setdefault(int(dim), [0, 0.0, 0.0])
                held[0] += len(x)
                held[1] = held[1] + x.sum(axis=0)
                held[2] = held[2] + (x * x).sum(axis=0)
        for dim, (n, s, q) in sums.items():
            some = [pa.array(np.full(dim, dim), pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*some, pa.array(s, pa.float64()), pa.array(q, pa.float64())], names=["dim", "axis", "n", "s", "q"])

    parts = rows.filter("dim > 0").select("dim", "vec").mapInArrow(run, "dim int, axis int, n bigint, s double, q double")
    sums = parts.groupBy("dim", "axis").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("dim", "axis", mean.alias("mean"), spread.alias("spread"))


def _curve(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length: the axes that vary most, their means and deviations."""
    order = Window.partitionBy("dim").orderBy(F.desc("spread"), "axis")
    best = _moments(rows).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= AXES)
    out: dict[int, list] = {}
    for r in best.orderBy("dim", "rank").collect():  # AXES rows per vector length
        out.setdefault(r["dim"], []).append((r["axis"], r["mean"], r["spread"]))
    return {dim: tuple(np.array(x) for x in zip(*rows, strict=True)) for dim, rows in out.items()}


def _with_places(rows: DataFrame) -> DataFrame:
    """Rows with their place on the curve; an axis is cut into 2^BITS steps over two deviations each way."""
    curve, steps = _curve(rows), 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vec = batch.column(2).to_numpy(), batch.column(3)
            place = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims):
                if dim not in curve:
                    continue
                axes, mean, spread = curve[dim]
                at = np.flatnonzero(dims == dim)
                x = _matrix(vec.take(pa.array(at)), int(dim))[:, axes.astype(int)]
                step = np.floor(((x - mean) / np.where(spread > 0, spread, 1) / 4 + 0.5) * steps)
                place[at] = hilbert_places(np.clip(step, 0, steps - 1).astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return rows.select("vec_id", "label", "dim", "vec").mapInArrow(run, "vec_id bigint, label string, dim int, vec binary, place bigint")


BLOCKS = "slice int, block int, dim int, label string, vec_id bigint, vec binary, place bigint, low binary, high binary"


def candidate_blocks(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The stored rows, in blocks along the curve; `low` and `high` on a block's first row are its zone map."""
    rows = stored(whole_vectors(vectors, scale), "whole-vectors")
    number, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    slices = max(math.ceil(number / SLICE), min(2 * cores, math.ceil(number / block)), 1)
    order = ["dim", "label", "place", "vec_id"]
    ordered = _with_places(rows).repartitionByRange(slices, *order).sortWithinPartitions(*order)
    names = [f.split(" ")[0] for f in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []  # rows of the block that is being filled

        def filled() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            n, dim = part.num_rows, part["dim"][0].as_py()
            x = _matrix(part["vec"], dim)
            zones = [pa.array([z.tobytes()] + [None] * (n - 1), pa.binary()) for z in (x.min(axis=0), x.max(axis=0))]
            numbers = [pa.array(np.full(n, v), pa.int32()) for v in (at, number)]
            rest = [part[name].combine_chunks() for name in ("dim", "label", "vec_id", "vec", "place")]
            return pa.RecordBatch.from_arrays([*numbers, *rest, *zones], names=names)

        for batch in batches:
            dims = batch.column(2).to_numpy()
            labels = batch.column(1).to_pylist()
            edges = [0] + [i for i in range(1, len(dims)) if dims[i] != dims[i - 1] or labels[i] != labels[i - 1]] + [len(dims)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if held and (held[0]["dim"][0].as_py(), held[0]["label"][0].as_py()) != (dims[first], labels[first]):
                    yield filled()
                    held, number = [], number + 1
                while first < last:
                    room = block - sum(h.num_rows for h in held)
                    held.append(batch.slice(first, min(room, last - first)))
                    first += held[-1].num_rows
                    if sum(h.num_rows for h in held) == block:
                        yield filled()
                        held, number = [], number + 1
        if held:
            yield filled()

    return stored(ordered.mapInArrow(run, BLOCKS), "candidate-blocks")


def _bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor (rows) with each block (columns), by interval arithmetic."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _product(up, low) + _product(down, high), _product(up, high) + _product(down, low)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if 2 * most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if 2 * most >= 2.0**63:
        raise ValueError("scores too large for 64 bits")
    return a @ b.T


class Asked:
    """Anchors of one part and vector length with their windows, as arrays."""

    def __init__(self, rows: pa.Table, dim: int):
        self.ids = rows["anchor_id"].to_numpy()
        self.labels = np.array(rows["label"].to_pylist(), object)
        self.vectors = _matrix(rows["vec"], dim)
        windows = rows["windows"].to_pylist()
        width = max(map(len, windows), default=0)
        self.numbers = np.zeros((len(windows), width), np.int32)
        self.low = np.full((len(windows), width), 1, np.int64)  # no window: none of its scores are wanted
        self.high = np.zeros((len(windows), width), np.int64)
        for i, some in enumerate(windows):
            for j, w in enumerate(some):
                self.numbers[i, j], self.low[i, j], self.high[i, j] = w["window"], w["low"], w["high"]

    def wanted(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Whether a block of some label can hold what an anchor looks for."""
        equal = self.labels[:, None] == labels[None, :]
        return equal if same else ~equal


def _chosen(asked: pa.Table, zones: pa.Table, same: bool) -> Iterator[tuple[int, int]]:
    """slice and block of the zone maps that meet a window of some anchor."""
    for dim in np.unique(zones["dim"].to_numpy()):
        some = zones.filter(pa.compute.equal(zones["dim"], int(dim)))
        rows = asked.filter(pa.compute.equal(asked["dim"], int(dim)))
        if not rows.num_rows:
            continue
        a, labels = Asked(rows, int(dim)), np.array(some["label"].to_pylist(), object)
        low, high = _matrix(some["low"], int(dim)), _matrix(some["high"], int(dim))
        needed = np.zeros(some.num_rows, bool)
        for first in range(0, rows.num_rows, CHUNK):
            part = slice(first, first + CHUNK)
            least, most = _bounds(a.vectors[part], low, high)
            wanted = a.wanted(labels, same)[part]
            for j in range(a.low.shape[1]):
                meets = (most >= a.low[part, j, None]) & (least <= a.high[part, j, None])
                needed |= (meets & wanted).any(axis=0)
        yield from zip(some["slice"].filter(pa.array(needed)).to_pylist(), some["block"].filter(pa.array(needed)).to_pylist(), strict=True)


class Best:
    """The k best (score, id) per slot, gathered in batches."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.kept = 0, 0
        self.floor = np.full(slots, np.iinfo(np.int64).min)  # lower scores can't be among the best any more

    def add(self, slot: np.ndarray, score: np.ndarray, item: np.ndarray) -> None:
        self.parts.append((slot, score, item))
        self.size += len(slot)
        if self.size - self.kept > max(self.kept, HELD):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        slot, score, item = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        order = np.lexsort((item, -score, slot))
        slot, score, item = slot[order], score[order], item[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        full = rank == self.k - 1
        self.floor[slot[full]] = score[full]
        few = rank < self.k
        self.parts = [(slot[few], score[few], item[few])]
        self.size = self.kept = int(few.sum())
        return self.parts[0]


def _found(asked: pa.Table, rows: pa.Table, same: bool, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchor_id, window, item and score of the best k of the rows for each window."""
    for dim in np.unique(rows["dim"].to_numpy()):
        some = rows.filter(pa.compute.equal(rows["dim"], int(dim))).combine_chunks()
        mine = asked.filter(pa.compute.equal(asked["dim"], int(dim)))
        if not mine.num_rows:
            continue
        a = Asked(mine, int(dim))
        order = np.argsort(some["block"].to_numpy(), kind="stable")
        block, ids = some["block"].to_numpy()[order], some["vec_id"].to_numpy()[order]
        vectors = _matrix(some["vec"], int(dim))[order]
        begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        ends = np.append(begins[1:], len(block))
        labels = np.array(some["label"].to_pylist(), object)[order[begins]]
        low = np.minimum.reduceat(vectors, begins, axis=0) if dim else vectors[begins]
        high = np.maximum.reduceat(vectors, begins, axis=0) if dim else vectors[begins]
        width = a.low.shape[1]
        for first in range(0, len(a.ids), CHUNK):
            part = np.arange(first, min(first + CHUNK, len(a.ids)))
            best = Best(len(part) * width, k)
            wanted = a.wanted(labels, same)[part]
            least, most = _bounds(a.vectors[part], low, high)
            for at in np.argsort(-most.max(axis=0), kind="stable"):
                floor = np.maximum(best.floor.reshape(len(part), width), a.low[part])
                need = wanted[:, at, None] & (most[:, at, None] >= floor) & (least[:, at, None] <= a.high[part])
                who = np.flatnonzero(need.any(axis=1))
                if not len(who):
                    continue
                item = ids[begins[at] : ends[at]]
                score = _product(a.vectors[part[who]], vectors[begins[at] : ends[at]])
                other = item[None, :] != a.ids[part[who], None]
                for j in range(width):
                    good = other & (score >= floor[who, j, None]) & (score <= a.high[part[who], j, None]) & need[who, j, None]
                    if len(item) > k:  # no more than the block's own k best, and ties with the last of them
                        shown = np.where(good, score, np.iinfo(np.int64).min)
                        good &= score >= np.partition(shown, len(item) - k, axis=1)[:, len(item) - k, None]
                    x, y = np.nonzero(good)
                    best.add(who[x] * width + j, score[x, y], item[y])
            slot, score, item = best.cut()
            yield a.ids[part[slot // width]], a.numbers[part[slot // width], slot % width], item, score


def _search(blocks: DataFrame, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """anchor_id, window, item, score and rank of the k best rows for each window of the anchors asked.

    asked: part, anchor_id, dim, label, vec, windows (window, low, high; ends included).
    """
    r = blocks.agg(F.max("slice")).first()[0]
    p = asked.agg(F.max("part")).first()[0]
    slices, parts = (-1 if r is None else r) + 1, (-1 if p is None else p) + 1
    groups, zones = math.ceil(slices / ZONES), blocks.filter("low IS NOT NULL")
    zones = zones.select("slice", "block", "dim", "label", "low", "high", F.floor(F.col("slice") / ZONES).cast("int").alias("zone"))

    def dealt(df: DataFrame, name: str, number: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(max(number, 1) - 1))))

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(_chosen(left, right, same)) if left.num_rows and right.num_rows else []
        part = left["part"][0].as_py() if out else 0
        return pa.table({"slice": pa.array([o[0] for o in out], pa.int32()), "block": pa.array([o[1] for o in out], pa.int32()), "part": pa.array([part] * len(out), pa.int32())})

    chosen = stored(
        dealt(asked, "zone", groups).groupBy("zone", "part").cogroup(dealt(zones, "part", parts).groupBy("zone", "part")).applyInArrow(choose, "slice int, block int, part int"),
        f"{name}-chosen",
    )

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(_found(left, right, same, k)) if left.num_rows and right.num_rows else []
        kinds = {"anchor_id": np.int64, "window": np.int32, "item": np.int64, "score": np.int64}
        cols = zip(*out, strict=True) if out else [[np.zeros(0, kind)] for kind in kinds.values()]
        return pa.table({c: np.concatenate(x).astype(kind) for (c, kind), x in zip(kinds.items(), cols, strict=True)})

    rows = blocks.select("slice", "block", "dim", "label", "vec_id", "vec").join(chosen, ["slice", "block"])
    here = asked.join(chosen.select("slice", "part").distinct(), "part")
    found = here.groupBy("slice", "part").cogroup(rows.groupBy("slice", "part")).applyInArrow(best, "anchor_id bigint, window int, item bigint, score bigint")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_parts(anchors: DataFrame) -> DataFrame:
    """Anchors with their part: consecutive slices, until they hold PART anchors."""
    counted = anchors.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))  # a row per slice
    parts = counted.select("slice", F.floor(F.coalesce(before, F.lit(0)) / PART).cast("int").alias("at"))
    numbered = parts.select("slice", (F.dense_rank().over(Window.orderBy("at")) - 1).alias("part"))
    return anchors.join(numbered, "slice").drop("slice")


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding. `is_anchor` is a condition on vec_id. The window is in whole per cent of the
    positive's score, ends included.
    """
    blocks = candidate_blocks(vectors, scale)
    anchors = blocks.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "dim", "label", "vec", "slice")
    anchors = stored(_in_parts(anchors), "anchors")
    limit = (1 << 63) - 1
    all_ = F.array(F.struct(F.lit(0).alias("window"), F.lit(-limit).cast("bigint").alias("low"), F.lit(limit).cast("bigint").alias("high")))
    near = stored(_search(blocks, anchors.withColumn("windows", all_), True, positives, "positives"), "positives")
    low, high = (F.expr(f"{f}(CAST(score AS DECIMAL(19,0)) * {w} / 100)") for f, w in zip(("ceil", "floor"), window, strict=True))
    windows = near.withColumns({"low": low.cast("bigint"), "high": high.cast("bigint")}).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").alias("window"), "low", "high"))).alias("windows")
    )
    hard = _search(blocks, anchors.join(windows, "anchor_id"), False, negatives, "negatives")
    named = near.select("anchor_id", F.col("rank").alias("window"), F.col("item").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("item").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
