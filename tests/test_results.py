import numpy as np
from pyspark.sql import functions as F

from shelfmark.functions import formatting as fmt
from shelfmark.operators import results


def test_price_labels(column):
    prices = [12.5, 1000.0, 0.99, None, 1.0, 0.125 + 1]
    label = lambda x: fmt.price_label(x, 1.0)
    assert column(prices, label, "double") == [
        "$12.50",
        "$1000.00",
        "N/A",
        "N/A",
        "$1.00",
        f"${0.125 + 1:.2f}",
    ]
    assert column([0.5, None], fmt.dollars, "double") == ["$0.50", None]


def test_stars(column):
    stars = [0.0, 0.5, 3.4, 4.5, 5.0, None]
    assert column(stars, fmt.star_icons, "double") == ["", "½", "★★★", "★★★★½", "★★★★★", "N/A"]
    assert column([4.25, 3.0, None], fmt.star_label, "double") == ["4.2 ★", "3.0 ★", None]


def test_reviews(column):
    assert column([0, 1234567, None], fmt.review_label, "bigint") == [
        "0 reviews",
        "1,234,567 reviews",
        "N/A",
    ]


SCHEMA = (
    "query_id int, product_id bigint, rank int, distance double, title string, price double,"
    " stars double, reviews bigint"
)


def test_result_lines(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0.5, "Tv", 9.5, 4.5, 12), (1, 2, 2, 0.5, None, None, None, None)], SCHEMA
    )
    lines = lambda rows: [row["line"] for row in rows.orderBy("rank").collect()]
    assert lines(results.result_lines(df)) == [
        "1. Tv - $9.50 - 4.5 ★ (12 reviews)",
        "2. Unknown Product",
    ]
    assert lines(results.result_lines(df, include_details=False)) == ["1. Tv", "2. Unknown Product"]
    assert lines(results.result_lines(df.drop("price", "reviews")))[0] == "1. Tv - 4.5 ★"


def test_result_rows_of_a_bare_table(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "query_id int, product_id bigint, distance double")
    row = results.result_rows(df).first().asDict()
    assert row == {
        "query_id": 1,
        "product_id": 2,
        "title": "Unknown Product",
        "price": None,
        "price_formatted": "N/A",
        "rating": None,
        "rating_stars": "N/A",
        "reviews": None,
        "reviews_formatted": "N/A",
        "url": None,
        "image_url": None,
        "is_bestseller": False,
        "relevance_score": 0.5,
        "category": None,
    }


def test_links(spark):
    df = spark.createDataFrame([("a", "b", "c")], "productURL string, url string, imgUrl string")
    assert df.select(results.link(df)).first()[0] == "a"
    bare = df.drop("productURL")
    assert bare.select(results.link(bare)).first()[0] == "b"


def test_labels(spark):
    df = spark.createDataFrame([(0.5, 4.25)], "price double, stars double")
    row = results.with_labels(df).first()
    assert (row["price_formatted"], row["stars_formatted"]) == ("$0.50", "4.2 ★")
    assert results.with_labels(df.select("price")).columns == ["price", "price_formatted"]


def test_summary(spark):
    searches = spark.createDataFrame(
        [(1, "tv", 0.0, 10.0), (2, "x", 5.5, 7.25)],
        "query_id int, query_text string, min_price double, max_price double",
    )
    found = spark.createDataFrame([(1, 5.0), (1, 0.5), (1, None)], "query_id int, price double")
    rows = results.search_summary(searches, found).orderBy("query_id").collect()
    assert [tuple(row) for row in rows] == [
        (1, "tv", 1, "$0.00 - $10.00", False),
        (2, "x", 0, "$5.50 - $7.25", True),
    ]


def test_labels_round_the_binary_value(column):
    from shelfmark.functions.formatting import fixed

    values = [1.015, 2.675, 0.005, 0.015, 0.125, 0.375, 9.995, 1e11 + 0.125, 0.004, 4.25, 0.25, 9.95, -1.015, 0.0, 123456.785]
    assert column(values, lambda x: fixed(x, 2), "double") == [f"{x:.2f}" for x in values]
    assert column(values, lambda x: fixed(x, 1), "double") == [f"{x:.1f}" for x in values]


def test_labels_are_short_expressions(spark):
    """Long ones are left uncompiled by the JVM: a row's labels took 38 microseconds. Near ties, they are still exact."""
    row = spark.range(1).select(F.col("id").cast("double").alias("x"))
    labels = row.select(fmt.price_label(F.col("x"), 1.0).alias("a"), fmt.star_label(F.col("x")).alias("b"))
    assert len(labels._jdf.queryExecution().optimizedPlan().toString()) < 1000
    ties = [i / 1000 * s for i in range(5, 4000, 10) for s in (1, -1)] + [i / 8 + 1e9 for i in range(16)]
    values = [y for x in ties for y in (x, float(np.nextafter(x, np.inf)), float(np.nextafter(x, -np.inf)))]
    found = spark.createDataFrame([(x,) for x in values], "x double").select("x", fmt.fixed(F.col("x"), 2).alias("y"))
    assert all(r.y == f"{r.x:.2f}" for r in found.collect())
