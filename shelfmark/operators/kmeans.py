"""K-means of all vectors, repeatable to the last bit.

Lloyd's steps from hash-chosen vectors. A step is one job and one scan: each task assigns its vectors and adds them up
per centre, in whole numbers (components in steps of 2^-20), so a sum does not depend on the order of its parts and the
same table gives the same centres whatever its partitions. The vectors may be cut into sub-spaces, each with centres of
its own; all of them are updated in the same scan. Only the centres, whose number is an option, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.blocks import filled, large_batches, matrix_of
from shelfmark.operators.one_pass import ITEM, VECTOR
from shelfmark.operators.order_statistics import sample_rows
from shelfmark.operators.topk_kernel import BestPairs, scan_block

STEPS_PER_UNIT = 1 << 20
BATCH = 8 << 20


def whole_steps(matrix: np.ndarray) -> np.ndarray:
    return np.floor(matrix.astype(np.float64) * STEPS_PER_UNIT + 0.5).astype(np.int64)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
    return (matrix / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def nearest_centres(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, ties to the lower one."""
    best = BestPairs(len(matrix), 1)
    scan_block(best, np.ascontiguousarray(matrix), np.arange(len(matrix)), centres, np.arange(len(centres)), "l2")
    return best.result()[1]


def _first_centres(vectors: DataFrame, number: int, seed: int, unit: bool) -> np.ndarray:
    """The vectors of the first hashes, in the order of their ids."""
    table = sample_rows(vectors, ITEM, number, seed).orderBy(ITEM).toArrow()
    matrix = matrix_of(table.column(VECTOR))
    return unit_rows(matrix) if unit else matrix


def _sums(vectors: DataFrame, books: list[np.ndarray], unit: bool) -> pa.Table:
    """part, centre, at, n and sum: what a step adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(book.shape, np.int64) for book in books]
        number = [np.zeros(len(book), np.int64) for book in books]
        for batch in large_batches(filled(batches, VECTOR), VECTOR, BATCH):
            matrix = matrix_of(batch.column(VECTOR))
            matrix = unit_rows(matrix) if unit else matrix
            width = matrix.shape[1] // len(books)
            for part, book in enumerate(books):
                piece = matrix[:, part * width : (part + 1) * width]
                nearest = nearest_centres(piece, book)
                np.add.at(total[part], nearest, whole_steps(piece))
                number[part] += np.bincount(nearest, minlength=len(book))
        for part, book in enumerate(books):
            met = np.flatnonzero(number[part])
            sums = [pa.array(row.tolist(), pa.int64()) for row in total[part][met]]
            columns = [pa.array(np.full(len(met), part), pa.int32()), pa.array(met, pa.int32()), pa.array(number[part][met])]
            lists = pa.array([s.to_pylist() for s in sums], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["part", "centre", "n", "sums"])

    parts = vectors.select(VECTOR).mapInArrow(run, "part int, centre int, n bigint, sums array<bigint>")
    each = parts.select("part", "centre", "n", F.posexplode("sums").alias("at", "sum"))
    return each.groupBy("part", "centre", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).toArrow()


def train(vectors: DataFrame, centres: int, iterations: int, seed: int, subspaces: int = 1, unit: bool = False) -> list[np.ndarray]:
    """A matrix of centres per sub-space after ``iterations`` steps, or earlier once nothing changes.

    ``vectors``: ``product_id, embedding``. With fewer vectors than centres each is one. A centre without vectors
    stays where it is. ``unit``: of the vectors' directions.
    """
    first = _first_centres(vectors, centres, seed, unit)
    if not len(first):
        raise ValueError("no vectors to train on")
    books = [np.ascontiguousarray(part) for part in np.split(first, subspaces, axis=1)]
    for _ in range(iterations):
        table = _sums(vectors, books, unit)
        part, centre, at, n, total = (table.column(name).to_numpy() for name in ("part", "centre", "at", "n", "sum"))
        moved = [book.copy() for book in books]
        mean = (total / STEPS_PER_UNIT / n).astype(np.float32)
        for p in range(subspaces):
            mine = part == p
            moved[p][centre[mine], at[mine]] = mean[mine]
        same = all((a == b).all() for a, b in zip(books, moved))
        books = moved
        if same:
            break
    return books
