"""Clustered index: vectors grouped into cells, a search looks into few cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import blocks, kmeans
from shelfmark.operators.blocks import local_table, matrix_of, small_block
from shelfmark.operators.knn import CELL, ITEM, QUERY, VECTOR, nearest
from shelfmark.operators.order_statistics import sample_rows
from shelfmark.operators.topk_kernel import BestPairs, scan_block
from shelfmark.options import IvfOptions
from shelfmark.sources.workspace import new_folder


def training_rows(vectors: DataFrame, rows: int | None, seed: int) -> DataFrame:
    """All vectors, or a seeded sample of them, written once as training reads it several times."""
    present = vectors.where(F.col(VECTOR).isNotNull()).select(ITEM, VECTOR)
    if rows is None:
        return present
    path = new_folder(vectors.sparkSession, "training-rows")
    sample_rows(present, ITEM, rows, seed).write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def train_centroids(vectors: DataFrame, options: IvfOptions = IvfOptions()) -> DataFrame:
    """(cell, embedding) of the k-means centres; at most ``options.cells`` rows.

    For inner products the centres are those of the directions.
    """
    sample = training_rows(vectors, options.train_rows, options.seed)
    (centres,) = kmeans.train(sample, options.cells, options.iterations, options.seed, unit=options.metric != "l2")
    rows = [(cell, [float(x) for x in centre]) for cell, centre in enumerate(centres)]
    return local_table(vectors.sparkSession, f"{CELL} bigint, {VECTOR} array<float>", rows)


def label_centroids(vectors: DataFrame, label: str) -> DataFrame:
    """(cell, embedding): the mean vector of every given label."""
    return (
        vectors.select(F.col(label).cast("bigint").alias(CELL), F.posexplode(VECTOR).alias("at", "x"))
        .groupBy(CELL, "at")
        .agg(F.avg("x").alias("x"))
        .groupBy(CELL)
        .agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("pairs"))
        .select(CELL, F.col("pairs.x").cast("array<float>").alias(VECTOR))
    )


def assign_cells(vectors: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """Add the cell of the nearest centroid by ``metric``; NULL without a vector.

    Centroids that may go to every task make it a scan without a shuffle; more
    of them are searched as any other vectors are, and the cells joined.
    """
    block = small_block(centroids, CELL, VECTOR, blocks.SIDE_ROWS)
    if block is None:
        asked = vectors.where(F.col(VECTOR).isNotNull()).select(F.col(ITEM).alias(QUERY), VECTOR)
        found = nearest_cells(asked, centroids, 1, metric).withColumnRenamed(QUERY, ITEM)
        return vectors.drop(CELL).join(found, ITEM, "left").select(*[c for c in vectors.columns if c != CELL], CELL)
    order = np.argsort(block.ids.to_numpy(zero_copy_only=False))
    cells, centres = block.ids.to_numpy(zero_copy_only=False)[order], block.matrix[order]
    kept = [name for name in vectors.columns if name != CELL]
    schema = T.StructType(
        [vectors.schema[name] for name in kept] + [T.StructField(CELL, T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            known = batch.column(VECTOR).is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                matrix = matrix_of(batch.column(VECTOR).drop_null())
                best = BestPairs(len(matrix), 1)
                scan_block(best, matrix, np.arange(len(matrix)), centres, cells, metric)
                found[known] = best.result()[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + [pa.array(found, mask=~known)],
                names=kept + [CELL],
            )

    return vectors.mapInArrow(run, schema)


def nearest_cells(
    queries: DataFrame, centroids: DataFrame, probes: int, metric: str = "l2", checked: bool = False
) -> DataFrame:
    """(query_id, cell) of the ``probes`` nearest centroids of each query."""
    items = centroids.select(F.col(CELL).alias(ITEM), VECTOR)
    found = nearest(queries, items, probes, metric, checked=checked)
    return found.select(QUERY, F.col(ITEM).alias(CELL))


def search_cells(
    queries: DataFrame,
    cell_vectors: DataFrame,
    centroids: DataFrame,
    k: int,
    probes: int = IvfOptions.probes,
    metric: str = "l2",
    **sizes: int,
) -> DataFrame:
    """The k nearest vectors inside each query's ``probes`` nearest cells.

    A query whose cells hold fewer than k vectors gets fewer rows.
    """
    probed = nearest_cells(queries, centroids, probes, metric)
    path = new_folder(queries.sparkSession, "probed-cells")  # read several times
    probed.write.parquet(path)
    probed = queries.sparkSession.read.schema(probed.schema).parquet(path)
    return nearest(queries, cell_vectors, k, metric, query_cells=probed, checked=True, **sizes)
