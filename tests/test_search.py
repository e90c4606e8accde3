import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from shelfmark.operators import blocks, categories, encode
from shelfmark.options import RankedSearchOptions, StoreSearchOptions
from shelfmark.plans import search as plans_search
from shelfmark.plans.search import (
    flat_index,
    parsed_prices,
    ranked_search,
    search_lines,
    store_search,
    with_defaults,
)
from shelfmark.plans.taxonomy import STARTER_CATEGORIES

WORDS = ["red", "blue", "tv", "laptop", "mouse", "phone", "case", "stand", "mug", "gaming", "4k"]
TEXTS = [
    "gaming laptop under $60",
    "red tv $10-$80",
    "blue mug over $20",
    "phones",
    "no more than $50 mouse",
    "oled tv",
]
DIM = 32


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(11)
    rows = [
        (
            at,
            " ".join(rng.choice(WORDS, 3)),
            None if at % 19 == 0 else round(float(rng.uniform(0.2, 100)), 2),
            float(rng.integers(0, 51)) / 10,
            int(rng.integers(0, 5000)),
            bool(at % 4 == 0),
        )
        for at in range(300)
    ]
    products = spark.createDataFrame(
        rows,
        "product_id bigint, title string, price double, stars double, reviews bigint,"
        " isBestSeller boolean",
    ).cache()
    vectors = coded(products, "title").select("product_id", "embedding").cache()
    searches = spark.createDataFrame(list(enumerate(TEXTS)), "query_id bigint, query_text string")
    return searches, products, vectors


def coded(df, text):
    return encode.hashed_embeddings(df, text, DIM)


@pytest.fixture(scope="module")
def taxonomy(spark):
    return categories.taxonomy_of(spark, STARTER_CATEGORIES)


SHELF = [
    (1, "laptop stand", 20.0, 4.0, 10, False, [1.0]),
    (2, "gaming laptop", 55.0, 3.0, 20, True, [2.0]),
    (3, "red mug", 5.0, 5.0, 30, False, [3.0]),
    (4, "laptops mouse", 70.0, 4.5, 40, True, [4.0]),
    (5, "laptop sleeve", None, 4.0, 50, False, [5.0]),
    (6, "laptop bag", 0.5, 4.0, 60, False, [6.0]),
    (7, "green mugs", 30.0, 2.0, 70, False, [7.0]),
    (8, "mouse pad", 15.0, 1.0, 80, False, [8.0]),
]
KINDS = {"computers": ["laptop", "mouse"], "kitchen": ["mug"], "phones": ["smart phone"]}
# Every search lies at 0, so products come in the order of their numbers unless their category scores differ.
EXPECTED = {
    "laptop under $60": [1, 2, 8],
    "mug $10-$80": [7],
    "lamp": [1, 2, 3, 4, 7, 8],
    "laptop": [4, 1, 2, 8],
    "chair at least $65": [4],
    "mug under $3": [],
    "smart phone mug": [3, 7],
}


@pytest.mark.parametrize(
    "options, expected",
    [
        (StoreSearchOptions(), EXPECTED),
        (StoreSearchOptions(top_k=2), {text: found[:2] for text, found in EXPECTED.items()}),
        (StoreSearchOptions(min_rating=3.0, bestsellers_only=True), {"laptop": [4, 2], "lamp": [2, 4], "mug under $3": []}),
        (StoreSearchOptions(price_max=50.0), {"lamp": [1, 3, 7, 8], "chair at least $65": []}),
        # three candidates are fetched, and one of them is left before categories are looked at
        (StoreSearchOptions(top_k=1, fetch_multiplier=3, category_multiplier=1), {"laptop": [1], "mug $10-$80": [1]}),
    ],
)
def test_store_search_of_a_small_shelf(spark, options, expected):
    shelf = spark.createDataFrame(
        SHELF,
        "product_id bigint, title string, price double, stars double, reviews bigint,"
        " isBestSeller boolean, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(at, text, [0.0]) for at, text in enumerate(expected)],
        "query_id bigint, query_text string, embedding array<float>",
    )
    index = flat_index(shelf.select("product_id", "embedding"))
    kinds = categories.taxonomy_of(spark, KINDS)
    found = {}
    for row in store_search(asked, shelf.drop("embedding"), index, kinds, options).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row["product_id"])
    assert {text: found.get(at, []) for at, text in enumerate(expected)} == expected


def test_cut_comes_before_the_filters(store, taxonomy):
    searches, products, vectors = store
    small = StoreSearchOptions(top_k=2, fetch_multiplier=2)
    large = StoreSearchOptions(top_k=2, fetch_multiplier=100)
    few, many = (
        store_search(searches, products, flat_index(vectors), taxonomy, o, coded).count()
        for o in (small, large)
    )
    assert few < many


def test_caller_columns_and_text_bounds(spark):
    searches = spark.createDataFrame(
        [(1, "tv under $5", 2.0, 9.0, 3.0), (2, "tv", None, None, None)],
        "query_id int, query_text string, price_min double, price_max double, min_rating double",
    )
    rows = (
        with_defaults(parsed_prices(searches), StoreSearchOptions(min_rating=1.0))
        .orderBy("query_id")
        .select("min_price", "max_price", "min_rating", "bestsellers_only")
        .collect()
    )
    assert [tuple(row) for row in rows] == [(2.0, 5.0, 3.0, False), (0.0, 10000.0, 1.0, False)]


def test_ranked_search_reads_filters_from_the_text(spark, store):
    _, products, vectors = store
    searches = spark.createDataFrame(
        [(1, "red tv $10-$80, 3+ stars"), (2, "red tv")], "query_id bigint, query_text string"
    )
    options = RankedSearchOptions(top_k=100, method="price")
    rows = ranked_search(searches, products, flat_index(vectors), options, coded).collect()
    first = [row for row in rows if row["query_id"] == 1]
    assert first and all(10 <= row["price"] <= 80 and row["stars"] >= 3 for row in first)
    assert len([row for row in rows if row["query_id"] == 2]) == 100
    assert {row["price_formatted"] for row in first} == {f"${row['price']:.2f}" for row in first}


def test_lines_use_only_given_filters(spark, store):
    _, products, vectors = store
    searches = spark.createDataFrame(
        [(1, "red tv 5 stars", 10.0, None), (2, "red tv 5 stars", 10.0, 40.0)],
        "query_id bigint, query_text string, price_min double, price_max double",
    )
    rows = search_lines(searches, products, flat_index(vectors), top_k=7, encode=coded).collect()
    prices = {
        q: [float(re.search(r"\$([\d.]+)", r["line"])[1]) for r in rows if r["query_id"] == q and "$" in r["line"]]
        for q in (1, 2)
    }
    # one bound alone does not filter, and stars in the text neither
    assert len([row for row in rows if row["query_id"] == 1]) == 7
    assert prices[2] and all(10 <= price <= 40 for price in prices[2])


def test_searches_need_a_vector(store, taxonomy):
    searches, products, vectors = store
    with pytest.raises(ValueError):
        store_search(searches, products, flat_index(vectors), taxonomy)


def test_plan_has_no_cross_join_and_cuts_early(store, taxonomy, monkeypatch):
    searches, products, vectors = store
    small = store_search(searches, products, flat_index(vectors), taxonomy, encode=coded)
    assert "row_number(), 50, Partial" in plan_of(small)
    monkeypatch.setattr(blocks, "SIDE_ROWS", 1)
    large = store_search(searches, products, flat_index(vectors), taxonomy, encode=coded)
    for plan in (plan_of(small), plan_of(large)):
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted(small.collect()) == sorted(large.collect())


@pytest.mark.parametrize("sides", [{}, {"side_rows": 0}, {"side_rows": 0, "block_rows": 0}])
def test_encoder_runs_once_a_search(spark, store, taxonomy, sides):
    from shelfmark.operators.knn import nearest

    searches, products, vectors = store
    seen = spark.sparkContext.accumulator(0)

    def counted(df, text):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return coded(df.mapInArrow(count, df.schema), text)

    store_search(
        searches, products, lambda asked, k: nearest(asked, vectors, k, **sides), taxonomy, encode=counted
    ).collect()
    assert seen.value == searches.count()


def test_workers_need_no_copy_of_the_package(spark, store):
    _, _, vectors = store
    asked = vectors.select(F.col("product_id").alias("query_id"), "embedding")
    from shelfmark.operators.knn import nearest

    def is_loaded(batches):
        import sys

        for batch in batches:
            yield batch
        assert "shelfmark" not in sys.modules

    assert nearest(asked, vectors, 2).mapInArrow(is_loaded, "query_id bigint, product_id bigint, distance double").count() == 600


def test_searches_of_one_file_are_encoded_by_all_cores(spark):
    """Those of one narrow file were encoded and scanned by one task."""
    asked = spark.createDataFrame([(i, f"word{i}") for i in range(64)], "query_id int, text string").coalesce(1)
    found = plans_search._vectors_of(asked, "text", lambda df, text: encode.hashed_embeddings(df, text, 4))
    files = found.select("query_id", F.input_file_name().alias("file")).collect()
    assert sorted(row.query_id for row in files) == list(range(64))
    assert len({row.file for row in files}) == spark.sparkContext.defaultParallelism
