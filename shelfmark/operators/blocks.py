"""Size checks in front of everything that is sent to all tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A block of queries or vectors below these sizes may go to every task.
BLOCK_ROWS = 4096
SIDE_ROWS = 65_536
BLOCK_BYTES = 256 << 20
BATCH_BYTES = 64 << 20
KEPT_PAIRS = 8_400_000
HINTED_PAIRS = 4_200_000

# Partial results of one query that a single task may merge.
MERGE_ROWS = 1_000_000
# From so many tasks and partial results on, a first search in an index's probe
# part pays off; it holds one vector in PROBE_SHARE.
PROBE_TASKS = 200
PROBE_RESULTS = 10_000_000
PROBE_SHARE = 100
# What one scan task reads at most, about.
TASK_BYTES = 4 << 30
# Estimates from here on stand for tables whose size the optimizer doesn't know.
UNKNOWN_BYTES = 1 << 60
# Upper bound of scan tasks when the cluster grows on demand.
ELASTIC_TASKS = 20_000


def rows_up_to(df: DataFrame, key: str, rows: int) -> int:
    """The number of rows, counted no further than ``rows`` + 1.

    Reads one narrow column, and only as many partitions as it takes.
    """
    return df.select(key).limit(rows + 1).count()


def fits(df: DataFrame, key: str, rows: int) -> bool:
    return rows_up_to(df, key, rows) <= rows


def local_table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A small table held in the plan itself, so that Spark knows its size."""
    names = [part.split()[0] for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    table = pa.table(dict(zip(names, [pa.array(column) for column in columns])))
    casts = [f"cast({name} as {part.split()[1]}) {name}" for name, part in zip(names, schema.split(", "))]
    return spark.createDataFrame(table).selectExpr(*casts)


def large_batches(
    batches: Iterator[pa.RecordBatch], column: str, size: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows with a vector, in batches of about ``size`` bytes.

    The larger a batch, the fewer of its rows pass for being among the best.
    """
    waiting, held = [], 0
    for batch in filled(batches, column):
        waiting.append(batch)
        held += batch.nbytes
        if held >= size:
            yield pa.concat_batches(waiting)
            waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def filled(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows with a vector. A filter in the plan would run an encoder twice."""
    for batch in batches:
        if batch.column(column).null_count:
            batch = batch.filter(pc.is_valid(batch.column(column)))
        if batch.num_rows:
            yield batch


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long vectors, lists or packed, as a float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0), dtype=np.float32)
    if pa.types.is_binary(column.type):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + rows + 1]
        lengths = np.diff(ends)
        flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(np.float32)
    else:
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different length in one column")
    return np.ascontiguousarray(flat.reshape(rows, -1), dtype=np.float32)


def list_column(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def is_packed(df: DataFrame, vector: str) -> bool:
    return df.schema[vector].dataType.typeName() == "binary"


def pack(df: DataFrame, vector: str) -> DataFrame:
    """Store each vector as the bytes of its float32 values.

    Spark moves such a value between Parquet, its rows and Python in one piece;
    a list it copies number by number. Searches read both.
    """
    if is_packed(df, vector):
        return df

    def run(lists: pa.Array) -> pa.Array:
        valid = lists.is_valid().to_numpy(zero_copy_only=False)
        if not valid.any():
            return pa.nulls(len(lists), pa.binary())
        matrix = matrix_of(lists.drop_null())
        ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1] * matrix.itemsize
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(matrix)]
        packed = pa.Array.from_buffers(pa.binary(), len(matrix), buffers)
        return packed.take(pa.array(np.cumsum(valid) - 1, mask=~valid))

    packer = F.arrow_udf(run, "binary").asNondeterministic()
    return df.withColumn(vector, packer(F.col(vector).cast("array<float>")))


def unpack(df: DataFrame, vector: str) -> DataFrame:
    """Packed vectors as lists again."""
    if not is_packed(df, vector):
        return df

    def run(packed: pa.Array) -> pa.Array:
        rows = [None if value is None else np.frombuffer(value, np.float32) for value in packed.to_pylist()]
        return pa.array(rows, pa.list_(pa.float32()))

    unpacker = F.arrow_udf(run, "array<float>").asNondeterministic()
    return df.withColumn(vector, unpacker(vector))


@dataclass(frozen=True)
class Block:
    """A small table taken to the driver, to be sent along with a task."""

    ids: pa.Array
    matrix: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.ids)


def small_block(df: DataFrame, key: str, vector: str, rows: int) -> Block | None:
    """``df`` as a block, or None when it has more rows or bytes than a block may have."""
    count = rows_up_to(df, key, rows)
    if count > rows or count * vector_bytes(df, vector) > BLOCK_BYTES:
        return None
    return taken_block(df, key, vector)


def taken_block(df: DataFrame, key: str, vector: str) -> Block:
    """A table whose size has been checked, as a block."""
    table = df.select(key, vector).toArrow()
    table = table.filter(pc.is_valid(table.column(vector)))
    return Block(table.column(key).combine_chunks(), matrix_of(table.column(vector)))


def vector_bytes(df: DataFrame, vector: str) -> int:
    """Bytes of one vector as float32, measured on the first one."""
    size = F.octet_length(vector) if is_packed(df, vector) else F.size(vector) * 4
    first = df.where(F.col(vector).isNotNull()).select(size.alias("size")).first()
    return max(first["size"], 4) if first is not None else 4


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size, 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 0


def scan_tasks(df: DataFrame, k: int = 1) -> int:
    """How many tasks scan a large side at most; each gives k rows per query.

    For a large k there are fewer tasks per core, as each adds k rows; but no
    task scans much more than ``TASK_BYTES``, however few cores there are.
    """
    return max(core_tasks(df.sparkSession, k), -(-stored_bytes(df) // TASK_BYTES))


def core_tasks(spark: SparkSession, k: int = 1) -> int:
    """Tasks that keep all cores busy."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return ELASTIC_TASKS
    return max(1, min(4, 400 // k)) * spark.sparkContext.defaultParallelism
