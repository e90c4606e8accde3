"""Exact nearest neighbours of a table of queries.

Three plans give the same rows:

* few vectors: they travel to every task, and the queries are scanned;
* few queries: they travel instead, the vectors are scanned where they lie, and
  each task gives its best k per query;
* both large: both sides are read once and meet in groups of bounded size
  (``operators.one_pass``).

A query id stands for one vector: an id that occurs twice is an error in every
plan. No plan ever emits a row per (query, vector) pair. Ties go to the lower item
id. ``cells`` restricts every query to some groups of vectors; that is how the
clustered and the hashed index search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import blocks, one_pass
from shelfmark.operators.blocks import (
    Block,
    core_tasks,
    filled,
    large_batches,
    matrix_of,
    scan_tasks,
    small_block,
)
from shelfmark.operators.one_pass import CELL, ITEM, QUERY, VECTOR, Loader
from shelfmark.operators.topk_kernel import SETTLED_AT_ONCE, BestPairs, Items, scan_block

CELLS, PROBE = "cells", "probe"
LITERAL_CELLS = 1000


def distance_name(metric: str) -> str:
    """L2 searches give a squared ``distance``, IP searches a ``similarity``."""
    return {"l2": "distance", "ip": "similarity"}[metric]


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "l2",
    *,
    query_cells: DataFrame | None = None,
    probe: DataFrame | None = None,
    load: Loader = matrix_of,
    repeated: bool = False,
    block_rows: int = blocks.BLOCK_ROWS,
    side_rows: int = blocks.SIDE_ROWS,
    held_bytes: int | None = None,
    checked: bool = False,
) -> DataFrame:
    """(query_id, product_id, distance) of the k nearest vectors per query.

    ``queries`` has ``query_id, embedding``; ``vectors`` has a unique bigint
    ``product_id`` and ``embedding``, a list or packed. With ``query_cells`` (``query_id, cell``)
    a query sees only vectors whose ``cell`` it lists. ``repeated`` says that a
    vector may be stored in more than one cell. ``probe`` is a small part of
    ``vectors``; with many scan tasks, the k-th cost found in it limits what the
    tasks of the full scan return. ``load`` turns the stored vector column into
    a matrix. ``checked`` says that no query id occurs twice.
    """
    if vectors.schema[ITEM].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{ITEM} must be a whole number")
    columns = [F.col(ITEM).cast("bigint").alias(ITEM), F.col(VECTOR)]
    if query_cells is not None:
        columns.append(F.col(CELL).cast("bigint").alias(CELL))
    vectors = vectors.select(*columns)
    queries = queries.select(QUERY, VECTOR)

    if not checked and not queries.groupBy(QUERY).count().where("count > 1").isEmpty():
        raise ValueError(f"a {QUERY} occurs more than once")

    plain = query_cells is None and load is matrix_of
    if plain:
        side = small_block(vectors, ITEM, VECTOR, side_rows)
        if side is not None:
            return named(_scan_queries(queries, side, k, metric), metric)
    block = query_block(queries, k, block_rows)
    if block is not None:
        bound = None
        if probe is not None and query_cells is None and _pays_off(vectors, block, k):
            bound = _probe_bound(queries, block, probe.select(*columns), k, metric, load)
        found, partials = _scan_vectors(
            queries, block, vectors, k, metric, query_cells, load, bound
        )
    else:
        if query_cells is not None:
            found = one_pass.search_groups(
                queries, vectors, query_cells, k, metric, load=load, held_bytes=held_bytes, repeated=repeated
            )
        else:
            small = probe.select(*columns) if probe is not None else None
            found = one_pass.search(queries, vectors, k, metric, load=load, probe=small, held_bytes=held_bytes)
        return named(found, metric)
    if repeated:
        found = found.groupBy(QUERY, ITEM).agg(F.min("cost").alias("cost"))
    return named(merge_best(found, k, partials), metric)


def query_block(queries: DataFrame, k: int, rows: int = blocks.BLOCK_ROWS) -> Block | None:
    """The queries as a block, if they and their k results each are few enough."""
    return small_block(queries, QUERY, VECTOR, min(rows, blocks.KEPT_PAIRS // k))


def merge_best(found: DataFrame, k: int, partials: int) -> DataFrame:
    """The k cheapest rows per query.

    ``partials`` tasks gave up to k rows per query each. When that is more than
    one task should sort, the rows are first reduced in salted groups.
    """
    order = [F.asc("cost"), F.asc(ITEM)]
    if partials * k > blocks.MERGE_ROWS:
        groups = math.isqrt(partials) + 1
        salted = found.withColumn("_salt", F.pmod(F.xxhash64(ITEM), F.lit(groups)))
        part = Window.partitionBy(QUERY, "_salt").orderBy(*order)
        found = (
            salted.withColumn("_nth", F.row_number().over(part))
            .where(F.col("_nth") <= k)
            .drop("_nth", "_salt")
        )
    whole = Window.partitionBy(QUERY).orderBy(*order)
    return found.withColumn("_nth", F.row_number().over(whole)).where(F.col("_nth") <= k).drop("_nth")


def named(found: DataFrame, metric: str) -> DataFrame:
    value: Column = F.col("cost") if metric == "l2" else -F.col("cost")
    return found.select(QUERY, ITEM, value.alias(distance_name(metric)))


def result_schema(queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField(QUERY, queries.schema[QUERY].dataType),
            T.StructField(ITEM, T.LongType()),
            T.StructField("cost", T.DoubleType()),
        ]
    )


def result_batches(best: BestPairs, ids: pa.Array, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for query, item, cost in best.portions():
        for low in range(0, len(query), rows):
            part = slice(low, low + rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(query[part])), pa.array(item[part]), pa.array(cost[part])],
                names=[QUERY, ITEM, "cost"],
            )


def _scan_vectors(
    queries: DataFrame,
    block: Block,
    vectors: DataFrame,
    k: int,
    metric: str,
    query_cells: DataFrame | None,
    load: Loader,
    bound: np.ndarray | None = None,
) -> tuple[DataFrame, int]:
    tasks = scan_tasks(vectors, k)
    asking: dict[int, np.ndarray] | None = None
    if query_cells is not None:
        asking = _queries_by_cell(block, query_cells)
        wanted = sorted(asking)
        if len(wanted) <= LITERAL_CELLS:  # a literal list prunes a table partitioned by cell
            vectors = vectors.where(F.col(CELL).isin(wanted))
        else:  # at most as many rows as the block has probes
            cells = blocks.local_table(queries.sparkSession, f"{CELL} bigint", [(c,) for c in wanted])
            vectors = vectors.join(F.broadcast(cells), CELL, "left_semi").select(*vectors.columns)
    ids, matrix = block.ids, block.matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestPairs(len(ids), k, bound)
        everyone = np.arange(len(ids))
        for batch in large_batches(batches, VECTOR):
            items = load(batch.column(VECTOR))
            item_ids = batch.column(ITEM).to_numpy(zero_copy_only=False)
            if asking is None:
                scan_block(best, matrix, everyone, items, item_ids, metric)
                continue
            cells = batch.column(CELL).to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                inside = np.flatnonzero(cells == cell)
                scan_block(best, matrix, asking[cell], items[inside], item_ids[inside], metric)
        yield from result_batches(best, ids)

    return vectors.coalesce(tasks).mapInArrow(run, result_schema(queries)), tasks


def _pays_off(vectors: DataFrame, block: Block, k: int) -> bool:
    tasks = scan_tasks(vectors, k)
    return tasks >= blocks.PROBE_TASKS and tasks * block.rows * k >= blocks.PROBE_RESULTS


def _probe_bound(
    queries: DataFrame, block: Block, probe: DataFrame, k: int, metric: str, load: Loader
) -> np.ndarray:
    """Per query the k-th cost inside a part of the vectors: the true one is no higher."""
    found, partials = _scan_vectors(queries, block, probe, k, metric, None, load)
    table = (
        merge_best(found, k, partials)
        .groupBy(QUERY)
        .agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("cost"))
        .where(F.col("n") == k)
        .toArrow()
    )
    bound = np.full(block.rows, np.inf)
    at = pc.index_in(table.column(QUERY).combine_chunks(), value_set=block.ids)
    bound[at.to_numpy(zero_copy_only=False)] = table.column("cost").to_numpy()
    return bound


def _queries_by_cell(block: Block, query_cells: DataFrame) -> dict[int, np.ndarray]:
    """Positions of the block's queries per cell; probes are few per query."""
    table = query_cells.select(QUERY, F.col(CELL).cast("bigint").alias(CELL)).toArrow()
    position = pc.index_in(table.column(QUERY).combine_chunks(), value_set=block.ids)
    cells = table.column(CELL).combine_chunks().to_numpy(zero_copy_only=False)
    known = position.is_valid().to_numpy(zero_copy_only=False)
    position = position.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
    cells = cells[known]
    order = np.lexsort((position, cells))
    cells, position = cells[order], position[order]
    names, starts = np.unique(cells, return_index=True)
    return dict(zip(names.tolist(), np.split(position, starts[1:])))


def _scan_queries(queries: DataFrame, side: Block, k: int, metric: str) -> DataFrame:
    items = side.matrix
    item_ids = side.ids.to_numpy(zero_copy_only=False)
    if blocks.fits(queries, QUERY, blocks.SIDE_ROWS):
        # so few may lie in one file; more are scanned as they lie
        queries = queries.repartition(core_tasks(queries.sparkSession), QUERY)
    step = max(256, min(2048, SETTLED_AT_ONCE // k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Items(items, metric)
        for batch in filled(batches, VECTOR):
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                best = BestPairs(part.num_rows, k, repeated=False)
                everyone = np.arange(part.num_rows)
                scan_block(best, matrix_of(part.column(VECTOR)), everyone, ready, item_ids, metric)
                yield from result_batches(best, part.column(QUERY))

    return queries.mapInArrow(run, result_schema(queries))


def attach_products(
    candidates: DataFrame, products: DataFrame, few_candidates: bool = False
) -> DataFrame:
    """Join candidates to product attributes on ``product_id``.

    A small catalog is sent to the tasks. Otherwise a candidate set known to be
    small (``HINTED_PAIRS`` rows) is, so that a large catalog is read in place
    and not shuffled. With neither, Spark joins by shuffle.
    """
    if blocks.fits(products, ITEM, blocks.SIDE_ROWS):
        return candidates.join(F.broadcast(products), ITEM)
    if few_candidates:
        return F.broadcast(candidates).join(products, ITEM)
    return candidates.join(products, ITEM)
