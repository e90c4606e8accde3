"""Time nearest-neighbour searches over 1,385,430 vectors of 384 dimensions.

The vectors are put together from the given embeddings, six to one, and written
once below the given folder:

    python bench_scale.py FOLDER [SF_DIR]
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import ivf
from shelfmark.operators.blocks import list_column, matrix_of
from shelfmark.options import IvfOptions
from shelfmark.plans.search import flat_index
from shelfmark.sources import indexes

ROWS, PIECES = 1_385_430, 6


def vectors(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    path = f"{folder}/vectors"
    if not os.path.exists(f"{path}/_SUCCESS"):
        given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toArrow()
        base = matrix_of(given.column("embedding"))

        def make(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                rng = np.random.default_rng(ids[0] if len(ids) else 0)
                joined = base[rng.integers(0, len(base), (len(ids), PIECES))].reshape(len(ids), -1)
                joined = (joined + rng.normal(0, 0.02, joined.shape)).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), list_column(joined)], ["product_id", "embedding"]
                )

        made = spark.range(0, ROWS, numPartitions=32).mapInArrow(
            make, "product_id bigint, embedding array<float>"
        )
        indexes.write_flat(made, path)
    return indexes.read_flat(spark, path)


def main() -> None:
    folder = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    items = vectors(spark, sf_dir, folder)

    def asked(rows: int) -> DataFrame:
        return items.where(F.col("product_id") < rows).select(
            F.col("product_id").alias("query_id"), "embedding"
        )

    def timed(name: str, queries: int, make) -> None:
        started = time.perf_counter()
        rows = make().count()
        took = time.perf_counter() - started
        print(
            json.dumps(
                {"run": name, "queries": queries, "rows": rows, "seconds": round(took, 2),
                 "ms_per_query": round(1000 * took / queries, 2)}
            ),
            flush=True,
        )

    for rows, k in ((1, 10), (100, 10), (1000, 10), (4000, 10), (100, 2000), (1000, 2000)):
        timed(f"flat, k={k}", rows, lambda: flat_index(items)(asked(rows), k))

    path = f"{folder}/ivf"
    options = IvfOptions(train_rows=20_000)
    started = time.perf_counter()
    if not os.path.exists(f"{path}/centroids/_SUCCESS"):
        centroids = ivf.train_centroids(items, options)
        sample = ivf.assign_cells(ivf.training_rows(items, 20_000, 1), centroids)
        sizes = indexes.estimated_sizes(sample, 20_000, ROWS)
        indexes.write_cells(ivf.assign_cells(items, centroids), centroids, path, sizes, 100_000)
        print(json.dumps({"run": "build ivf", "seconds": round(time.perf_counter() - started, 2)}))
    stored, centroids = indexes.read_cells(spark, path)
    for rows in (1, 100, 1000):
        timed("ivf, 10 of 100 cells, k=10", rows, lambda: ivf.search_cells(asked(rows), stored, centroids, 10))


if __name__ == "__main__":
    main()
