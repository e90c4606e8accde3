"""Nearest neighbours of two large sides that are each read once.

Both sides are packed into blocks (a block is one value: an Arrow record batch) and shuffled once into groups. In a
group one side is held in memory, a slice of bounded size; the blocks of the other side are streamed past it. Which
side is held follows from the bytes that would be moved:

* queries held, vectors streamed: a group sees all vectors for its queries, so what it gives is final;
* vectors held, queries streamed: a group gives its best k per query, packed in one row per query and merged by query;
  vectors of few bytes are held whole by every group, each with its own queries, and what it gives is final, too.

In a clustered search each cell is read once, and its vectors meet just the queries that ask for it. Where vectors are
held, a group is a cell, or a part of one that holds many vectors; where queries are held, a group has queries of
neighbouring cells, and gets the cells that any of them asks for. Which groups a cell belongs to is known to the tasks
by a join, not to the driver. Nothing of either side passes the driver, and no task holds more than a slice, a block
and their results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import blocks
from shelfmark.operators.blocks import core_tasks, filled, matrix_of, vector_bytes
from shelfmark.operators.topk_kernel import BestPairs, Everything, Items, Pairs, scan_block
from shelfmark.sources.workspace import new_folder

QUERY, ITEM, VECTOR, CELL, CELLS = "query_id", "product_id", "embedding", "cell", "cells"
BOUND = "bound"  # of a query: a cost that its k-th best doesn't exceed
HELD, STREAMED = 0, 1
PACKED = "group bigint, kind int, cell bigint, block binary"
STREAM_BYTES = 4 << 20  # of a block
HELD_BYTES = 256 << 20  # of a held slice
WHOLE_BYTES = 320 << 20  # of vectors that every group may hold
PARTIAL_BYTES = 128  # moved in the time that one partial result takes to be found, packed and merged
TOGETHER_BYTES = 64 << 20  # of streamed vectors that are scanned together
SORTED_BYTES = 16 << 20  # of rows that are put in the order of their cells together
ITEMS_AT_ONCE = 1 << 15
PAIRS_HELD = 4_200_000  # (query, item) pairs that a merging task looks at together
GROUPS_PER_CORE = 4
GROUP_SHARE = 4  # a group holds the results of queries up to this part of KEPT_PAIRS, whichever side is held
SHARED = "shared"  # the cells of a row, a bit each
SHARED_CELLS = 1024  # that rows may name by a bit
MOST_PAIRS = 0.5  # of all pairs; from there on, all are looked at

Loader = Callable[[pa.Array], np.ndarray]
Allowed = Callable[[pa.RecordBatch, pa.RecordBatch], Everything]


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows with a vector in batches of about `size` bytes."""
    waiting, held = [], 0
    for batch in filled(batches, VECTOR):
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for low in range(0, batch.num_rows, rows):
            part = batch.slice(low, rows)
            waiting.append(part)
            held += part.nbytes
            if held >= size:
                yield pa.concat_batches(waiting)
                waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Small batches together, up to about `rows` rows or STREAM_BYTES."""
    waiting, count, held = [], 0, 0
    for batch in batches:
        if waiting and (count + batch.num_rows > rows or held + batch.nbytes > STREAM_BYTES):
            yield pa.concat_batches(waiting)
            waiting, count, held = [], 0, 0
        waiting.append(batch)
        count, held = count + batch.num_rows, held + batch.nbytes
    if waiting:
        yield pa.concat_batches(waiting)


def _row(group: int, kind: int, cell: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    values = (group, kind, cell, _to_bytes(batch))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["group", "kind", "cell", "block"])


def _dealt(df: DataFrame, kind: int, groups: int, everywhere: bool) -> DataFrame:
    """Blocks of a side, dealt over the groups or given to all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # small blocks for the held side, so that a small table fills all groups alike
        at = TaskContext.get().partitionId()
        for batch in _gathered(batches, STREAM_BYTES):
            if everywhere:
                yield _row(0, kind, 0, batch)
                continue
            share = max(1, min(-(-batch.num_rows // groups), ITEMS_AT_ONCE))
            for low in range(0, batch.num_rows, share):
                yield _row(at % groups, kind, 0, batch.slice(low, share))
                at += 1

    packed = df.mapInArrow(run, PACKED)
    if everywhere:
        packed = packed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    return packed


def _in_cells(df: DataFrame, kind: int) -> DataFrame:
    """Blocks of a side, each of one cell; df has a column cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, SORTED_BYTES):
            cells = batch.column(CELL).to_numpy(zero_copy_only=False)
            order = np.argsort(cells, kind="stable")
            batch = batch.take(pa.array(order))
            names, begins = np.unique(cells[order], return_index=True)
            width = max(1, batch.nbytes // batch.num_rows)
            rows = max(1, STREAM_BYTES // width // 4)
            for cell, begin, end in zip(names, begins, np.append(begins[1:], len(order))):
                for low in range(begin, end, rows):
                    yield _row(0, kind, int(cell), batch.slice(low, min(rows, end - low)))

    return df.where(F.col(CELL).isNotNull()).mapInArrow(run, PACKED)


def _by_cell(df: DataFrame, kind: int, parts: DataFrame, few: bool) -> DataFrame:
    """Blocks of a side in the groups of their cells.

    A cell's vectors are dealt over its groups; a query goes to all of them.
    """
    packed = _in_cells(df, kind).drop("group")
    if kind == STREAMED:  # parts: cell, groups (all of the cell's)
        each = packed.join(F.broadcast(parts) if few else parts, CELL)
        return each.select(F.explode("groups").alias("group"), "kind", CELL, "block")
    each = packed.join(F.broadcast(parts) if few else parts, CELL)
    turn = F.pmod(F.xxhash64("block"), F.size("groups"))
    return each.select(F.get("groups", turn.cast("int")).alias("group"), "kind", CELL, "block")


def cell_groups(vectors: DataFrame, asked: DataFrame, width: int, least: int) -> tuple[DataFrame, int]:
    """(cell, groups) of the cells that are asked for, and the number of groups.

    Cells are numbered by size, so that neighbours in that order, which are about as large, go to different tasks.
    """
    sizes = vectors.where(F.col(CELL).isNotNull()).groupBy(CELL).agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.join(asked.select(CELL).distinct(), CELL, "left_semi")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    rows = max(1, min(HELD_BYTES // width, -(-total // least)))
    parts = sizes.withColumn("parts", F.ceil(F.col("rows") / rows).cast("bigint"))
    order = Window.orderBy(F.desc("rows"), CELL).rowsBetween(Window.unboundedPreceding, -1)  # a narrow row per cell
    first = F.coalesce(F.sum("parts").over(order), F.lit(0)).cast("bigint")
    numbered = parts.select(CELL, F.sequence(first, first + F.col("parts") - 1).alias("groups"))
    number = parts.agg(F.sum("parts")).first()[0] or 0
    return numbered, number


def _ready(batches: list[pa.RecordBatch], load: Loader, metric: str) -> tuple[pa.RecordBatch, Items]:
    """Ids and vectors of the batches, for one scan; empties the list."""
    ids = pa.Table.from_batches([batch.select([ITEM]) for batch in batches]).combine_chunks().to_batches()[0]
    pieces = (load(batches.pop(0).column(VECTOR)) for _ in range(len(batches)))
    return ids, Items(pieces, metric, ids.num_rows)


class _Slice:
    """The held vectors of a group: (cell, rows, vectors) of all of a cell, or batches of at most ITEMS_AT_ONCE rows
    where a rule reads what else they have. Empties the list that it is made from."""

    def __init__(self, held: list[tuple[int, pa.RecordBatch]], load: Loader, metric: str, ruled: bool):
        self.blocks = []
        if ruled:
            for cell, batch in held:
                for low in range(0, batch.num_rows, ITEMS_AT_ONCE):
                    some = batch.slice(low, ITEMS_AT_ONCE)
                    self.blocks.append((cell, some.drop_columns([VECTOR]), Items(load(some.column(VECTOR)), metric)))
            held.clear()
        cells: dict[int, list[pa.RecordBatch]] = {}
        while held:
            cell, batch = held.pop()
            cells.setdefault(cell, []).append(batch)
        self.blocks += [(cell, *_ready(cells.pop(cell), load, metric)) for cell in sorted(cells)]


def _streamed(
    stream: Iterator[tuple[int, pa.RecordBatch]], load: Loader, metric: str, rows: int
) -> Iterator[tuple[int, pa.RecordBatch, Items]]:
    """The vectors of a stream, those of a cell together, about ``rows`` of all cells at a time."""
    cells: dict[int, list[pa.RecordBatch]] = {}
    waiting = 0
    for cell, batch in stream:
        if waiting and waiting + batch.num_rows > rows:
            yield from ((cell, *_ready(cells.pop(cell), load, metric)) for cell in sorted(cells))
            waiting = 0
        cells.setdefault(cell, []).append(batch)
        waiting += batch.num_rows
    yield from ((cell, *_ready(cells.pop(cell), load, metric)) for cell in sorted(cells))


def _offer(
    best: BestPairs,
    queries: pa.RecordBatch,
    matrix: np.ndarray,
    items: pa.RecordBatch,
    vectors: np.ndarray | Items,
    metric: str,
    allowed: Allowed | None,
    rows: np.ndarray | None = None,
) -> None:
    ids = items.column(ITEM).to_numpy(zero_copy_only=False)
    rule = allowed(queries, items) if allowed is not None else None
    scan_block(best, matrix, np.arange(len(matrix)) if rows is None else rows, vectors, ids, metric, rule)


def _asking(queries: pa.RecordBatch) -> dict[int, np.ndarray] | None:
    """Positions of the queries that ask for each cell, where they have cells."""
    at = queries.schema.get_field_index(CELLS)
    if at < 0:
        return None
    lists = queries.column(at)
    cells = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((rows, cells))
    names, begins = np.unique(cells[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], begins[1:])))


def _bounds(queries: pa.RecordBatch) -> np.ndarray | None:
    at = queries.schema.get_field_index(BOUND)
    if at < 0:
        return None
    return queries.column(at).fill_null(np.inf).to_numpy(zero_copy_only=False)


def _emitted(portions: Iterable[Pairs], k: int, ids: pa.Array, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per query: its items and costs, packed."""
    for query, item, cost in portions:
        if not len(query):
            continue
        begins = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        ends = np.append(begins[1:], len(query))
        item, cost = item.astype(np.int64), cost.astype(np.float64)
        step = max(1, STREAM_BYTES // 16 // k)
        for low in range(0, len(begins), step):
            b, e = begins[low : low + step], ends[low : low + step]
            packed = [pa.array([x[i:j].tobytes() for i, j in zip(b, e)], pa.binary()) for x in (item, cost)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[b])), *packed], schema=schema)


def _flat(portions: Iterable[Pairs], ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    for query, item, cost in portions:
        for low in range(0, len(item), 100_000):
            part = slice(low, low + 100_000)
            columns = [ids.take(pa.array(query[part])), pa.array(item[part].astype(np.int64)), pa.array(cost[part])]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _scanned(
    packed: DataFrame,
    k: int,
    metric: str,
    load: Loader,
    allowed: Allowed | None,
    query_type: T.DataType,
    queries_held: bool,
    repeated: bool = False,
    final: bool = False,
) -> DataFrame:
    """Results of all groups: final rows where queries are held, else packed ones.

    ``final``: every group holds all vectors that its queries may find, so that there is nothing to merge.
    """
    names = [QUERY, ITEM, "cost"]
    flat = T.StructType([T.StructField(QUERY, query_type), T.StructField(ITEM, T.LongType()), T.StructField("cost", T.DoubleType())])
    wrapped = T.StructType([T.StructField(QUERY, query_type), T.StructField("items", T.BinaryType()), T.StructField("costs", T.BinaryType())])

    def of_queries(group: list[tuple[int, pa.RecordBatch]], stream: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        queries = pa.Table.from_batches([batch for _, batch in group]).combine_chunks().to_batches()[0]
        group.clear()
        matrix = matrix_of(queries.column(VECTOR))
        best = BestPairs(len(matrix), k, _bounds(queries), repeated)
        asking = _asking(queries)
        together = max(1, TOGETHER_BYTES // max(1, matrix.nbytes // len(matrix)))
        if allowed is None:
            coming = _streamed(stream, load, metric, together)
        else:  # a rule drops queries by what the rows of a block have in common
            coming = ((cell, items, load(items.column(VECTOR))) for cell, items in stream)
        for cell, items, vectors in coming:
            rows = None if asking is None else asking.get(cell, np.zeros(0, np.int64))
            _offer(best, queries, matrix, items, vectors, metric, allowed, rows)
        yield from _flat(best.portions(), queries.column(QUERY), names)

    def of_vectors(group: list[tuple[int, pa.RecordBatch]], stream: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        held = _Slice(group, load, metric, allowed is not None)
        step = max(1, blocks.KEPT_PAIRS // k // GROUP_SHARE)
        for queries in _joined((batch for _, batch in stream), step):
            matrix = matrix_of(queries.column(VECTOR))
            for low in range(0, len(matrix), step):
                some = queries.slice(low, step)
                best = BestPairs(some.num_rows, k, _bounds(some), final and repeated)
                asking = _asking(some)
                for cell, items, vectors in held.blocks:
                    rows = None if asking is None else asking.get(cell, np.zeros(0, np.int64))
                    _offer(best, some, matrix[low : low + step], items, vectors, metric, allowed, rows)
                ids = some.column(QUERY)
                if final:
                    yield from _flat(best.portions(), ids, names)
                    continue
                schema = pa.schema([(QUERY, ids.type), ("items", pa.binary()), ("costs", pa.binary())])
                yield from _emitted(best.portions(), k, ids, schema)

    work = of_queries if queries_held else of_vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3))
        )
        ahead = next(rows, None)
        while ahead is not None:
            group, held = ahead[0], []
            while ahead is not None and ahead[:2] == (group, HELD):
                held.append((ahead[2], _from_bytes(ahead[3].as_buffer())))
                ahead = next(rows, None)

            def stream() -> Iterator[tuple[int, pa.RecordBatch]]:
                nonlocal ahead
                while ahead is not None and ahead[0] == group:
                    yield ahead[2], _from_bytes(ahead[3].as_buffer())
                    ahead = next(rows, None)

            following = stream()
            if held:
                yield from work(held, following)
            for _ in following:  # nobody to meet
                pass

    return packed.mapInArrow(run, flat if queries_held or final else wrapped)


def _grouped(held: DataFrame, streamed: DataFrame, groups: int, tasks: int) -> DataFrame:
    both = held.unionByName(streamed)
    dealt = both.repartitionById(max(tasks, 1), (F.col("group") % max(tasks, 1)).cast("int"))
    return dealt.sortWithinPartitions("group", "kind")


def merge_packed(found: DataFrame, k: int, partials: int, tasks: int, repeated: bool = False) -> DataFrame:
    """(query_id, product_id, cost) of the k cheapest per query from packed rows.

    Rows are sorted by query and merged as they pass. Where a query has very many, they are first merged in salted
    groups. ``repeated``: an item may occur in several rows, and counts once.
    """
    kind = found.schema[QUERY].dataType
    wrapped = found.schema
    flat = T.StructType([T.StructField(QUERY, kind), T.StructField(ITEM, T.LongType()), T.StructField("cost", T.DoubleType())])

    def merged(batches: Iterator[pa.RecordBatch], pack: bool) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            ids = rows.column(QUERY).combine_chunks().dictionary_encode("encode")
            owner, names = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), ids.dictionary
            raw = [b"".join(rows.column(c).to_pylist()) for c in ("items", "costs")]
            size = np.asarray(pc.binary_length(rows.column("items"))) // 8
            best = BestPairs(len(names), k, repeated=repeated)
            best.offer(np.repeat(owner, size), np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.float64))
            query, item, cost = best.result()
            rest = None
            if not last:  # more rows of the last query may follow
                mine = query == len(names) - 1
                schema = rows.schema
                rest = pa.table([names[-1:], pa.array([item[mine].tobytes()], pa.binary()), pa.array([cost[mine].tobytes()], pa.binary())], schema=schema)
                query, item, cost = query[~mine], item[~mine], cost[~mine]
            if pack:
                return list(_emitted([(query, item, cost)], k, names, rows.schema)), rest
            return list(_flat([(query, item, cost)], names, [QUERY, ITEM, "cost"])), rest

        waiting, pairs = [], 0
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column(1))) // 8
            first = 0
            while first < batch.num_rows:
                room = np.searchsorted(np.cumsum(size[first:]), max(PAIRS_HELD - pairs, 1), "right")
                last = first + max(int(room), 1)
                waiting.append(batch.slice(first, last - first))
                pairs += int(size[first:last].sum())
                first = last
                if pairs >= PAIRS_HELD // 2:
                    out, rest = settle(pa.Table.from_batches(waiting), False)
                    yield from out
                    waiting = rest.to_batches()
                    pairs = sum(len(x.as_py()) // 8 for x in rest.column("items"))
        if waiting:
            yield from settle(pa.Table.from_batches(waiting), True)[0]

    tasks = max(tasks, 1)
    if partials * k > blocks.MERGE_ROWS:
        salts = math.isqrt(partials) + 1
        salted = found.withColumn("_salt", F.pmod(F.xxhash64("items"), F.lit(salts)))
        salted = salted.repartition(tasks, QUERY, "_salt").sortWithinPartitions("_salt", QUERY).drop("_salt")
        found = salted.mapInArrow(lambda batches: merged(batches, True), wrapped)
    whole = found.repartition(tasks, QUERY).sortWithinPartitions(QUERY)
    return whole.mapInArrow(lambda batches: merged(batches, False), flat)


def _with_bounds(queries: DataFrame, probe: DataFrame, k: int, metric: str, load: Loader, allowed: Allowed | None, held_bytes: int) -> DataFrame:
    """Queries with the k-th cost inside a part of the vectors, where it holds k for them."""
    first = search(queries, probe, k, metric, load=load, allowed=allowed, held_bytes=held_bytes)
    known = first.groupBy(QUERY).agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias(BOUND)).where(F.col("n") == k)
    return queries.join(known.select(QUERY, BOUND), QUERY, "left")


def search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    load: Loader = matrix_of,
    allowed: Allowed | None = None,
    probe: DataFrame | None = None,
    held_bytes: int | None = None,
    hold: str | None = None,
) -> DataFrame:
    """(query_id, product_id, cost) of the k nearest vectors per query.

    `allowed` gives the rule for which pairs may be found, from a block of either side (whose other columns it may read). `probe` is
    a small part of the vectors; a first search in it bounds what many groups would return. `hold` ("queries" or
    "vectors") overrides the choice of the held side.
    """
    limit = held_bytes or HELD_BYTES
    width, cores = vector_bytes(queries, VECTOR), core_tasks(queries.sparkSession, k)
    kind = queries.schema[QUERY].dataType
    asked, stored = queries.count(), vectors.count()
    by_query = max(math.ceil(asked * width / limit), math.ceil(asked * k * GROUP_SHARE / blocks.KEPT_PAIRS), min(cores, asked), 1)
    by_item = max(math.ceil(stored * width / limit), min(cores, math.ceil(stored / max(k, 1))), 1)
    slices, parts = _grid(asked, stored * width, k, width, by_item, held_bytes, max(1, min(cores, asked)))
    moved_held = stored * width * by_query
    moved_stream = stored * width * parts + asked * slices * (width + (16 * k if slices > 1 else 0))
    queries_held = moved_held <= moved_stream if hold is None else hold == "queries"
    if queries_held:
        packed = _grouped(_dealt(queries, HELD, by_query, False), _dealt(vectors, STREAMED, by_query, True), by_query, by_query)
        return _scanned(packed, k, metric, load, allowed, kind, queries_held)
    groups = slices * parts
    if probe is not None and slices >= blocks.PROBE_TASKS:
        queries = _with_bounds(queries, probe, k, metric, load, allowed, limit)
    held = _spread(_dealt(vectors, HELD, slices, False), parts, parts, 1)
    packed = _grouped(held, _spread(_dealt(queries, STREAMED, parts, False), 1, slices, parts), groups, groups)
    # rows of a repeated id are merged
    if slices == 1 and queries.groupBy(QUERY).count().where("count > 1").isEmpty():
        return _scanned(packed, k, metric, load, allowed, kind, queries_held, False, True)
    found = _scanned(packed, k, metric, load, allowed, kind, queries_held)
    return merge_packed(found, k, slices, max(cores, groups))


def _grid(asked: int, stored_bytes: int, k: int, width: int, by_item: int, held_bytes: int | None, tasks: int) -> tuple[int, int]:
    """(slices of the vectors, parts of the queries); a task sees one of each.

    Either every query goes to ``by_item`` slices, or slices are as large as may be held, and copied for each part.
    """
    least = 1 if stored_bytes <= (held_bytes or WHOLE_BYTES) else math.ceil(stored_bytes / (held_bytes or HELD_BYTES))
    copies = max(1, math.ceil(tasks / least))
    results = PARTIAL_BYTES * k
    few = stored_bytes * copies + asked * least * (width + (results if least > 1 else 0))
    return (least, copies) if few < stored_bytes + asked * by_item * (width + results) else (by_item, 1)


def _spread(packed: DataFrame, step: int, copies: int, apart: int) -> DataFrame:
    """Blocks of group g in the groups g * step, and ``copies`` - 1 more, each ``apart`` from the one before."""
    first = F.col("group") * step
    last = first + (copies - 1) * apart
    every = F.explode(F.sequence(first, last, F.lit(apart).cast("bigint")))
    return packed.select(every.alias("group"), "kind", "cell", "block")


def _query_groups(queries: DataFrame, query_cells: DataFrame, groups: int, asked: int) -> DataFrame:
    """The queries (``asked`` of them) with their cells and a group; queries whose least cells are neighbours share one.

    A query's place is the number of queries of lower cells, and a hashed one among those of its own: so the queries
    of a cell that very many ask for are spread over several groups.
    """
    cells = query_cells.groupBy(QUERY).agg(F.sort_array(F.collect_set(F.col(CELL).cast("bigint"))).alias(CELLS))
    first = cells.withColumn("first", F.col(CELLS)[0])
    counted = first.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a narrow row per cell
    places = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64(QUERY), F.col("n"))
    numbered = first.join(places, "first").withColumn("group", F.floor(place * groups / max(asked, 1)).cast("bigint"))
    return queries.join(numbered.select(QUERY, CELLS, "group"), QUERY)


def _by_group(df: DataFrame) -> DataFrame:
    """Held blocks of rows that know their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, SORTED_BYTES):
            groups = batch.column("group").to_numpy(zero_copy_only=False)
            order = np.argsort(groups, kind="stable")
            batch = batch.take(pa.array(order))
            names, begins = np.unique(groups[order], return_index=True)
            for group, begin, end in zip(names, begins, np.append(begins[1:], len(order))):
                yield _row(int(group), HELD, 0, batch.slice(begin, end - begin))

    return df.mapInArrow(run, PACKED)


class Sharing(Everything):
    """Pairs with a cell in common."""

    def __init__(self, queries: pa.RecordBatch, items: pa.RecordBatch):
        self.asked, self.own = (_words(batch.column(SHARED)) for batch in (queries, items))

    def dense(self, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        good = np.zeros((len(rows), high - low), dtype=bool)
        for asked, own in zip(self.asked[rows].T, self.own[low:high].T):
            good |= (asked[:, None] & own[None, :]) != 0
        return good

    def pairs(self, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        good = np.zeros(len(rows), dtype=bool)
        for asked, own in zip(self.asked.T, self.own.T):
            good |= (asked[rows] & own[items]) != 0
        return good


def _words(column: pa.Array) -> np.ndarray:
    """A column of equally long bit sets as 64-bit words."""
    if not len(column):
        return np.empty((0, 0), np.uint64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64).reshape(len(column), -1)


def _with_shared(df: DataFrame, names: np.ndarray) -> DataFrame:
    """The rows whose cells are among the sorted ``names``, with these as bits in place of the list."""
    kept = [name for name in df.columns if name != CELLS]
    schema = T.StructType([df.schema[name] for name in kept] + [T.StructField(SHARED, T.BinaryType())])
    words = -(-len(names) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(CELLS)
            cells = lists.flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            place = np.minimum(np.searchsorted(names, cells), len(names) - 1)
            known = names[place] == cells
            rows, place = rows[known], place[known]
            bits = np.zeros((len(lists), words), np.uint64)
            np.bitwise_or.at(bits, (rows, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
            some = np.flatnonzero(bits.any(axis=1))
            batch = batch.take(pa.array(some))
            shared = pa.array([row.tobytes() for row in bits[some]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in kept] + [shared], names=kept + [SHARED])

    return df.mapInArrow(run, schema)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _meets_most(vectors: DataFrame, query_cells: DataFrame) -> bool:
    """Whether the cells asked for, few enough for bits, make up half of all pairs or more."""
    asking = query_cells.groupBy(F.col(CELL).cast("bigint").alias(CELL)).agg(F.count(F.lit(1)).alias("asked"))
    if not blocks.fits(asking, CELL, SHARED_CELLS):
        return False
    inside = vectors.where(F.col(CELL).isNotNull()).groupBy(CELL).agg(F.count(F.lit(1)).alias("rows"))
    product = F.sum(F.col("asked").cast("double") * F.col("rows"))
    met = inside.join(F.broadcast(asking), CELL).agg(product).first()[0] or 0.0
    return met >= MOST_PAIRS * query_cells.select(QUERY).distinct().count() * vectors.select(ITEM).distinct().count() > 0


def _search_shared(
    queries: DataFrame, vectors: DataFrame, query_cells: DataFrame, k: int, metric: str, **options
) -> DataFrame:
    """As ``search_groups``, but a vector stands in one row, and whether it shares a cell with a query is looked at
    for the pairs that are near enough."""
    names = np.array(sorted(row[0] for row in query_cells.select(CELL).distinct().collect()), np.int64)  # SHARED_CELLS
    cell = F.col(CELL).cast("bigint")
    lists = query_cells.groupBy(QUERY).agg(F.collect_set(cell).alias(CELLS))
    once = vectors.where(F.col(CELL).isNotNull()).groupBy(ITEM, VECTOR).agg(F.collect_set(cell).alias(CELLS))
    asked = _stored(_with_shared(queries.join(lists, QUERY), names), "asked-shared")
    stored = _stored(_with_shared(once, names), "vectors-once")
    return search(asked, stored, k, metric, allowed=Sharing, **options)


def search_groups(
    queries: DataFrame,
    vectors: DataFrame,
    query_cells: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    load: Loader = matrix_of,
    held_bytes: int | None = None,
    hold: str | None = None,
    repeated: bool = False,
) -> DataFrame:
    """(query_id, product_id, cost) of the k nearest vectors in the cells of each query.

    ``repeated`` says that a vector may be stored in several cells. Where cells are so few, or so much the same, that
    going through them would compare a query with a vector more than about half a time on the average, each vector is
    compared with each query just once instead.
    """
    if repeated and _meets_most(vectors, query_cells):
        return _search_shared(queries, vectors, query_cells, k, metric, load=load, held_bytes=held_bytes, hold=hold)
    limit = held_bytes or HELD_BYTES
    width, wide = vector_bytes(queries, VECTOR), vector_bytes(vectors, VECTOR)
    spark, kind = queries.sparkSession, queries.schema[QUERY].dataType
    known = query_cells.agg(F.count(F.lit(1)), F.countDistinct(QUERY), F.countDistinct(CELL)).first()
    pairs, asked, cells = known
    stored, cores = vectors.count(), spark.sparkContext.defaultParallelism
    by_query = max(math.ceil(asked * width / limit), math.ceil(asked * k * GROUP_SHARE / blocks.KEPT_PAIRS), min(GROUPS_PER_CORE * cores, asked), 1)
    few = cells <= blocks.SIDE_ROWS
    moved_held = stored * wide * by_query
    least = max(GROUPS_PER_CORE * cores, math.ceil(stored * wide / limit))
    # a cell's vectors are dealt over several groups: its queries go to all of them, and get results from each
    moved_stream = stored * wide + math.ceil(pairs * max(1, least / max(1, cells))) * (width + 16 * k)
    copies = max(1, min(GROUPS_PER_CORE * cores, asked))
    whole = stored * wide <= (held_bytes or WHOLE_BYTES) and hold != "queries"
    if whole and stored * wide * copies + asked * width < (moved_stream if hold else min(moved_held, moved_stream)):
        lists = query_cells.groupBy(QUERY).agg(F.collect_set(F.col(CELL).cast("bigint")).alias(CELLS))
        held = _spread(_in_cells(vectors, HELD), 1, copies, 1)
        packed = _grouped(held, _dealt(queries.join(lists, QUERY), STREAMED, copies, False), copies, copies)
        return _scanned(packed, k, metric, load, None, kind, False, repeated, True)
    queries_held = moved_held <= moved_stream if hold is None else hold == "queries"
    if queries_held:
        held = _query_groups(queries, query_cells, by_query, asked)
        asking = held.select("group", F.explode(CELLS).alias(CELL)).distinct()
        parts = asking.groupBy(CELL).agg(F.collect_set("group").alias("groups"))
        packed = _grouped(_by_group(held), _by_cell(vectors, STREAMED, parts, few), by_query, by_query)
        return _scanned(packed, k, metric, load, None, kind, True, repeated)
    parts, groups = cell_groups(vectors, query_cells, wide, least)
    sent = queries.join(query_cells.select(QUERY, CELL).distinct(), QUERY)
    packed = _grouped(_by_cell(vectors, HELD, parts, few), _by_cell(sent, STREAMED, parts, few), groups, min(groups, blocks.ELASTIC_TASKS))
    found = _scanned(packed, k, metric, load, None, kind, False)
    each = max(1, math.ceil(groups / max(1, cells))) * max(1, math.ceil(pairs / max(1, asked)))
    return merge_packed(found, k, each, max(core_tasks(spark), groups), repeated)
