"""What several operators of this subpackage share: stored tables, sizes, bytes of text in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.workspace import new_folder

# A word is a run of characters other than ASCII blanks; fixed by the contract of the queries.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that its work is not repeated and its lineage ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_crc(key: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def batch_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array in one buffer, and where each text begins (one more entry than texts)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_by_size(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive runs of texts of at most `most` bytes in all; a longer text stands alone."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        out.append((first, last))
        first = last
    return out


def pieces_of(batches, most: int = 4 << 20, text: str = "text"):
    """Arrow batches cut so that no piece holds more than about `most` bytes of text (one row at least)."""
    for batch in batches:
        _, offsets = batch_bytes(batch.column(batch.schema.get_field_index(text)))
        for first, last in slices_by_size(offsets, most):
            yield batch.slice(first, last - first)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (two multiply-xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n scrambled 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
