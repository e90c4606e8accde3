"""A tree of cells, for more cells than one task can compare a vector with.

Every level is a table of centroids; below the first, a centroid has a parent in the level above. A search keeps the
``beam`` nearest centroids of a level and compares only their children at the next: each level is itself a clustered
index whose cells are the parents, and is searched as one. So a level may have any number of centroids, nothing about
them is on the driver, and a query costs beam times children comparisons per level, not one per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.operators import ivf
from shelfmark.operators.blocks import list_column, matrix_of, pack
from shelfmark.operators.kmeans import nearest_centres, unit_rows, whole_steps, STEPS_PER_UNIT
from shelfmark.operators.knn import CELL, ITEM, QUERY, VECTOR, nearest
from shelfmark.options import IvfTreeOptions
from shelfmark.sources.workspace import new_folder

PARENT = "parent"


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_cells(vectors: DataFrame, children: int, options: IvfTreeOptions = IvfTreeOptions()) -> DataFrame:
    """(cell, parent, embedding): centres of the next level, at most ``children`` for every ``cell`` of ``vectors``.

    Each cell is trained by a task of its own on at most ``options.rows_per_centre`` vectors per centre, the first by a
    seeded hash, which are cut off before the shuffle; so no task holds more, however large a cell is. Sums are whole
    numbers, as in ``operators.kmeans``.
    """
    rows, steps, unit = children * options.rows_per_centre, options.iterations, options.metric != "l2"
    order = F.md5(F.concat(F.col(ITEM).cast("string"), F.lit(f":{options.seed}")))
    nth = F.row_number().over(Window.partitionBy(CELL).orderBy("_order", ITEM))
    present = pack(vectors.where(F.col(VECTOR).isNotNull() & F.col(CELL).isNotNull()).select(CELL, ITEM, VECTOR), VECTOR)
    sample = present.withColumn("_order", order).withColumn("_nth", nth).where(F.col("_nth") <= rows)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_nth")
        parent = table.column(CELL)[0].as_py()
        matrix = matrix_of(table.column(VECTOR))
        matrix = unit_rows(matrix) if unit else matrix
        centres = matrix[:children].copy()
        for _ in range(steps):
            found = nearest_centres(matrix, centres)
            total, number = np.zeros(centres.shape, np.int64), np.bincount(found, minlength=len(centres))
            np.add.at(total, found, whole_steps(matrix))
            met = number > 0
            moved = centres.copy()
            moved[met] = (total[met] / STEPS_PER_UNIT / number[met, None]).astype(np.float32)
            if (moved == centres).all():
                break
            centres = moved
        names = pa.array(np.arange(len(centres)) + parent * children)
        return pa.table({CELL: names, PARENT: pa.array([parent] * len(centres), pa.int64()), VECTOR: list_column(centres)})

    kept = sample.select(F.col(CELL).cast("bigint").alias(CELL), VECTOR, "_nth")
    return kept.groupBy(CELL).applyInArrow(run, f"{CELL} bigint, {PARENT} bigint, {VECTOR} array<float>")


def train_levels(vectors: DataFrame, options: IvfTreeOptions = IvfTreeOptions()) -> list[DataFrame]:
    """Centroids of every level, ``options.branches`` of them under each of the level above; written down.

    The first level is trained over a seeded sample of all vectors, the next inside the cells of the one before.
    """
    first, *others = options.branches
    flat = options.flat(first)
    levels = [_stored(ivf.train_centroids(vectors, flat), "tree-level")]
    for children in others:
        assigned = assign_leaves(vectors.select(ITEM, VECTOR), levels, options.metric)
        levels.append(_stored(split_cells(assigned, children, options), "tree-level"))
    return levels


def leaves_of(
    queries: DataFrame, levels: Sequence[DataFrame], probes: int, beam: int, metric: str = "l2", checked: bool = False
) -> DataFrame:
    """(query_id, cell): the ``probes`` nearest cells of the last level that a descent with ``beam`` finds; written down.

    A query whose kept centroids have fewer children gets fewer.
    """
    if not levels:
        raise ValueError("a tree has at least one level")
    widths = [beam] * (len(levels) - 1) + [probes]
    found = _stored(ivf.nearest_cells(queries, levels[0], widths[0], metric, checked), "tree-beam")
    for level, width in zip(levels[1:], widths[1:]):
        children = level.select(F.col(CELL).alias(ITEM), VECTOR, F.col(PARENT).alias(CELL))
        below = nearest(queries, children, width, metric, query_cells=found, checked=True)
        found = _stored(below.select(QUERY, F.col(ITEM).alias(CELL)), "tree-beam")
    return found


def assign_leaves(vectors: DataFrame, levels: Sequence[DataFrame], metric: str = "l2", beam: int = 1) -> DataFrame:
    """Add the leaf cell that a descent with ``beam`` finds nearest; NULL without a vector."""
    if len(levels) == 1:
        return ivf.assign_cells(vectors, levels[0], metric)
    asked = vectors.where(F.col(VECTOR).isNotNull()).select(F.col(ITEM).alias(QUERY), VECTOR)
    found = leaves_of(asked, levels, 1, beam, metric, checked=True).withColumnRenamed(QUERY, ITEM)
    kept = [name for name in vectors.columns if name != CELL]
    return vectors.select(kept).join(found, ITEM, "left").select(*kept, CELL)


def search_tree(
    queries: DataFrame,
    leaf_vectors: DataFrame,
    levels: Sequence[DataFrame],
    k: int,
    probes: int = IvfTreeOptions.probes,
    beam: int = IvfTreeOptions.beam,
    metric: str = "l2",
    **sizes: int,
) -> DataFrame:
    """The k nearest vectors inside each query's ``probes`` leaves; fewer rows where the leaves hold fewer."""
    probed = leaves_of(queries, levels, probes, beam, metric)
    return nearest(queries, leaf_vectors, k, metric, query_cells=probed, checked=True, **sizes)


def write_tree(leaf_vectors: DataFrame, levels: Sequence[DataFrame], path: str, files: int) -> None:
    """Write a tree: a folder per level, and packed vectors sorted by leaf.

    Leaves may be too many for a folder each, so files hold ranges of them, which their statistics tell; a large leaf
    is spread over several files by the vectors' ids.
    """
    packed = pack(leaf_vectors.where(F.col(CELL).isNotNull()).select(ITEM, VECTOR, CELL), VECTOR)
    placed = packed.repartitionByRange(files, CELL, ITEM).sortWithinPartitions(CELL, ITEM)
    placed.write.mode("overwrite").parquet(f"{path}/leaves")
    for at, level in enumerate(levels):
        level.write.mode("overwrite").parquet(f"{path}/level={at}")


def read_tree(spark: SparkSession, path: str, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(vectors with their leaf, levels) of a written tree."""
    return spark.read.parquet(f"{path}/leaves"), [spark.read.parquet(f"{path}/level={at}") for at in range(depth)]
