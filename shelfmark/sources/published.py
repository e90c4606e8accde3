"""Indexes that are published as a whole: all of their tables, then one manifest that names them.

A save writes its tables under a folder of its own and, last, appends one line to the manifests: version, kind, metric,
dimension, and the number of rows and a checksum of each table. A load takes the latest line and reads what it names,
so it never sees a half-written index, and readers of an older version keep theirs. Checksums do not depend on the
order of rows or on files.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.blocks import SIDE_ROWS, fits, local_table, matrix_of, pack, vector_bytes
from shelfmark.operators.knn import CELL, ITEM, VECTOR
from shelfmark.operators.lsh import bucket_rows

MANIFEST = (
    "version bigint, folder string, kind string, metric string, dimension int,"
    " tables map<string,struct<rows:bigint,checksum:bigint>>"
)


def _fingerprint(df: DataFrame) -> tuple[int, int]:
    """Rows, and the exclusive or of their hashes with the number of each hash's occurrences."""
    hashed = df.select(F.xxhash64(*df.columns).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    row = hashed.agg(F.sum("n").alias("rows"), F.bit_xor(F.xxhash64("h", "n")).alias("checksum")).first()
    return row["rows"] or 0, row["checksum"] or 0


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifests")


def _latest(spark: SparkSession, path: str):
    from pyspark.errors import AnalysisException

    try:
        return _manifests(spark, path).orderBy(F.desc("version")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(spark: SparkSession, path: str, kind: str, metric: str, dimension: int, tables: dict[str, DataFrame]) -> None:
    """Write the tables, then make them the index's latest version."""
    folder = f"v-{uuid.uuid4().hex}"
    described = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
        rows, checksum = _fingerprint(spark.read.parquet(f"{path}/{folder}/{name}"))
        described[name] = {"rows": rows, "checksum": checksum}
    latest = _latest(spark, path)
    version = 1 if latest is None else latest["version"] + 1
    line = [(version, folder, kind, metric, dimension, described)]
    spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")


def load(spark: SparkSession, path: str, kind: str, verify: bool = True) -> tuple[dict[str, DataFrame], str, int]:
    """(tables, metric, dimension) of the latest version; ``verify`` compares rows and checksums."""
    latest = _latest(spark, path)
    if latest is None:
        raise FileNotFoundError(f"no published index at {path}")
    if latest["kind"] != kind:
        raise ValueError(f"index of kind {latest['kind']}, not {kind}")
    tables = {name: spark.read.parquet(f"{path}/{latest['folder']}/{name}") for name in latest["tables"]}
    if verify:
        for name, df in tables.items():
            want = latest["tables"][name]
            if _fingerprint(df) != (want["rows"], want["checksum"]):
                raise ValueError(f"table {name} of the index at {path} is damaged")
    return tables, latest["metric"], latest["dimension"]


# Hashed index


@dataclass(frozen=True)
class Hashed:
    """A stored hashed index: vectors once, and narrow postings."""

    postings: DataFrame
    vectors: DataFrame
    lines: np.ndarray
    bucket_length: float
    metric: str


def save_hashed(
    vectors: DataFrame, lines: np.ndarray, bucket_length: float, path: str, metric: str = "l2", files: int = 8
) -> None:
    """Postings sorted by bucket, so that file statistics tell which hold a bucket; equal buckets spread by item."""
    spark = vectors.sparkSession
    postings = bucket_rows(vectors.select(ITEM, VECTOR), lines, bucket_length).select(CELL, ITEM)
    postings = postings.repartitionByRange(files, CELL, ITEM).sortWithinPartitions(CELL, ITEM)
    rows = [(at, [float(x) for x in line], float(bucket_length)) for at, line in enumerate(np.asarray(lines))]
    tables = {
        "postings": postings,
        "vectors": pack(vectors.select(ITEM, VECTOR), VECTOR),
        "lines": local_table(spark, "line int, direction array<double>, bucket_length double", rows),
    }
    publish(spark, path, "hashed", metric, vector_bytes(vectors, VECTOR) // 4, tables)


def load_hashed(spark: SparkSession, path: str) -> Hashed:
    tables, metric, _ = load(spark, path, "hashed")
    lines = tables["lines"].orderBy("line").collect()  # one row per table of the index
    axes = np.array([row["direction"] for row in lines])
    return Hashed(tables["postings"], tables["vectors"], axes, lines[0]["bucket_length"], metric)


# Compressed index


def save_codes(coded: DataFrame, codebook: DataFrame, path: str, metric: str = "l2") -> None:
    """Codes and the codebook that they refer to."""
    if not fits(codebook, "code", SIDE_ROWS):
        raise ValueError("codebook too large")
    centres = codebook.orderBy("subspace", "code").toArrow()
    parts = len(set(centres.column("subspace").to_pylist()))
    dimension = matrix_of(centres.column("centre")).shape[1] * parts
    publish(coded.sparkSession, path, "codes", metric, dimension, {"codes": coded, "codebook": codebook})


def load_codes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    tables, _, _ = load(spark, path, "codes")
    return tables["codes"], tables["codebook"]
