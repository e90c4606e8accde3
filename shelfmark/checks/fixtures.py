"""Catalog, searches and vectors as views over the given tables.

The texts run unchanged in Spark and in DuckDB. They use every row of their
tables. The catalog has, on purpose, repeated asins and titles, missing values,
prices that are no numbers and titles with special characters.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.prices import parse_price
from shelfmark.operators.blocks import SIDE_ROWS
from shelfmark.sources.workspace import new_folder

CATALOG = """
SELECT p.p_partkey AS product_id,
       CONCAT('B', LPAD(CAST(p.p_partkey - (CASE WHEN p.p_partkey % 29 = 0 AND p.p_partkey > 0
              THEN 1 ELSE 0 END) AS STRING), 9, '0')) AS asin,
       CASE WHEN p.p_partkey % 61 = 0 THEN NULL ELSE CONCAT(p.p_name, ' ',
         CASE p.p_partkey % 12
           WHEN 0 THEN 'Gaming Laptop' WHEN 1 THEN 'wireless headphones'
           WHEN 2 THEN 'smartphone case & cover' WHEN 3 THEN '4K TV' WHEN 4 THEN 'kitchen blender'
           WHEN 5 THEN 'mountain bike' WHEN 6 THEN 'gaming mouse' WHEN 7 THEN 'laser printer'
           WHEN 8 THEN 'WiFi router™' WHEN 9 THEN 'Café mug #9' WHEN 10 THEN 'phones stand'
           ELSE 'tool set' END,
         ' v', CAST(p.p_partkey % 100 AS STRING)) END AS title,
       CASE WHEN p.p_partkey % 41 = 0 THEN NULL WHEN p.p_partkey % 37 = 0 THEN 'call us'
            WHEN p.p_partkey % 43 = 0 THEN '$0.50'
            WHEN p.p_partkey % 5 = 0 THEN CONCAT('$1,', LPAD(CAST(p.p_partkey % 1000 AS STRING), 3, '0'), '.25')
            ELSE CONCAT('$', CAST(CAST(p.p_partkey * 7919 % 500 AS BIGINT) AS STRING), '.5') END AS price,
       CAST(CASE WHEN p.p_partkey % 53 = 0 THEN NULL ELSE p.p_partkey * 7 % 51 END AS DOUBLE) / 10.0 AS stars,
       CASE WHEN p.p_partkey % 59 = 0 THEN NULL ELSE COALESCE(l.sold, 0) * 97 END AS reviews,
       p.p_partkey % 17 = 0 AS isBestSeller,
       CAST(p.p_size AS BIGINT) AS category_id,
       p.p_brand AS brand,
       CONCAT('https://shop.example/dp/', CAST(p.p_partkey AS STRING)) AS productURL,
       CONCAT('https://img.example/', CAST(p.p_partkey AS STRING), '.jpg') AS imgUrl
FROM {part} p
LEFT JOIN (SELECT l_partkey, COUNT(*) AS sold FROM {lineitem} GROUP BY l_partkey) l
  ON p.p_partkey = l.l_partkey
"""

SEARCHES = """
SELECT p_partkey AS query_id,
       CASE p_partkey % 10
         WHEN 0 THEN CONCAT('wireless headphones under $', CAST(50 + p_partkey AS STRING))
         WHEN 1 THEN CONCAT('Gaming laptop $', CAST(100 + p_partkey AS STRING), '-$', CAST(400 + p_partkey AS STRING))
         WHEN 2 THEN CONCAT('no more than $', CAST(300 + p_partkey AS STRING), ' kitchen blender')
         WHEN 3 THEN CONCAT('smart tv over $', CAST(20 + p_partkey AS STRING), ' and under $', CAST(450 + p_partkey AS STRING))
         WHEN 4 THEN 'knife set with 4+ stars'
         WHEN 5 THEN CONCAT('brand: ', p_brand, ', 3.5 stars')
         WHEN 6 THEN 'gaming laptop'
         WHEN 7 THEN '  Mountain   Bike  minimum 50.50 '
         WHEN 8 THEN 'headphones'
         ELSE p_name END AS query_text
FROM {part}
"""

TABLES = ("part", "lineitem", "embeddings", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = [name for name in TABLES if f"{{{name}}}" in text]
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in used})


_STORED: dict[tuple[str, str, str], str] = {}


def built_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], None]) -> str:
    """The folder of something that is built once per session, as catalogs and indexes are in practice."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        folder = new_folder(spark, name)
        build(folder)
        _STORED[key] = folder
    return _STORED[key]


def _stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A view written down once per session.

    Left as a view, Catalyst would infer the formulas behind its columns as
    filters on every table joined to it.
    """

    def build(folder: str) -> None:
        make().write.mode("overwrite").parquet(folder)

    return spark.read.parquet(built_once(spark, sf_dir, name, build))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "catalog", lambda: _view(spark, sf_dir, CATALOG))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SEARCHES)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with numeric prices, otherwise as it is."""
    raw = catalog(spark, sf_dir)
    return _stored(
        spark, sf_dir, "products", lambda: raw.withColumn("price", parse_price(F.col("price")))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("product_id"), "embedding", F.col("label").cast("bigint").alias("cell")
    )


def vector_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All searches, each with the vector whose number is the search's modulo the number of vectors."""
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    count = given.count()
    # small files may hold very many searches: these must not be what Spark sends to all tasks
    side = F.broadcast(given) if count <= SIDE_ROWS else given.hint("merge")
    return searches(spark, sf_dir).withColumn("vec_id", F.col("query_id") % count).join(side, "vec_id").drop("vec_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# The same views as named parts of a DuckDB statement.
DUCK_TABLES = {name: name for name in TABLES}
DUCK_CATALOG = CATALOG.format(**DUCK_TABLES)
DUCK_SEARCHES = SEARCHES.format(**DUCK_TABLES)
