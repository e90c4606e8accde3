import pytest
from pyspark.sql import functions as F

from shelfmark.operators import filters, ranking
from shelfmark.options import HybridWeights

SCHEMA = (
    "query_id int, product_id bigint, distance double, price double, stars double,"
    " reviews bigint, isBestSeller boolean, brand string"
)
ROWS = [
    (1, 1, 0.0, 10.0, 5.0, 7, True, "Acme"),
    (1, 2, 1.0, 0.5, 3.0, None, False, "acme two"),
    (1, 3, 2.0, None, None, 90, None, None),
    (1, 4, 2.0, 20.0, 4.0, 7, True, "Zeta"),
    (2, 5, 0.0, 5.0, 2.0, 1, False, "Zeta"),
    (2, 6, 0.0, 5.0, 2.0, 1, False, "Zeta"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(row["product_id"] for row in df.collect())


def order(df, search=1):
    ranked = df.where(F.col("query_id") == search).orderBy("rank").collect()
    assert [row["rank"] for row in ranked] == list(range(1, len(ranked) + 1))
    return [row["product_id"] for row in ranked]


def given(df, **values):
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def test_price_filters(rows):
    assert ids(filters.valid_price(rows)) == [1, 4, 5, 6]
    assert ids(filters.displayable(rows)) == [1, 4, 5, 6]
    assert ids(filters.price_between(given(rows, min_price=5.0, max_price=10.0))) == [1, 5, 6]
    open_ended = given(rows, min_price=None, max_price=10.0)
    assert ids(filters.price_between(open_ended)) == [1, 2, 5, 6]


def test_rating_filter(rows):
    assert ids(filters.rating_at_least(given(rows, min_rating=4.0))) == [1, 4]
    assert len(ids(filters.rating_at_least(given(rows, min_rating=0.0)))) == 6
    assert len(ids(filters.rating_at_least(given(rows, min_rating=None)))) == 6
    strict = filters.rating_at_least(given(rows, min_rating=0.0), zero_is_off=False)
    assert ids(strict) == [1, 2, 4, 5, 6]


def test_flag_and_brand_filters(rows):
    assert ids(filters.bestsellers(given(rows, bestsellers_only=True))) == [1, 4]
    assert len(ids(filters.bestsellers(given(rows, bestsellers_only=False)))) == 6
    assert ids(filters.brand_contains(given(rows, brand_hint="ACME"))) == [1, 2]
    assert ids(filters.brand_contains(given(rows, brand_hint=""))) == [1, 2, 4, 5, 6]
    assert len(ids(filters.brand_contains(given(rows, brand_hint=None)))) == 6


def test_filters_without_their_column(rows):
    bare = rows.select("query_id", "product_id")
    for apply in (
        filters.valid_price,
        filters.price_between,
        filters.rating_at_least,
        filters.bestsellers,
        filters.brand_contains,
    ):
        assert apply(bare) is bare


def test_simple_orders(rows):
    assert order(ranking.rank(rows, "distance")) == [1, 2, 3, 4]
    assert order(ranking.rank(rows, "reviews")) == [3, 1, 4, 2]
    assert order(ranking.rank(rows, "price")) == [2, 1, 4, 3]
    assert order(ranking.rank(rows, "distance", 2)) == [1, 2]


def test_hybrid_scores(rows):
    scored = {r["product_id"]: r for r in ranking.with_hybrid_score(rows).collect()}
    assert scored[2]["relevance_score"] == 0.5
    assert scored[4]["rating_score"] == 0.5
    assert scored[1]["price_score"] == pytest.approx(1 - 9.5 / 19.5)
    assert scored[1]["hybrid_score"] == pytest.approx(0.5 + 0.3 + 0.2 * (1 - 9.5 / 19.5))
    # all distances zero: no relevance and no score; equal ratings and prices: 1
    assert scored[5]["relevance_score"] is None and scored[5]["hybrid_score"] is None
    assert (scored[5]["rating_score"], scored[5]["price_score"]) == (1.0, 1.0)


def test_hybrid_order(rows):
    ranked = ranking.rank(rows, "hybrid")
    assert order(ranked) == [1, 2, 4, 3]
    assert order(ranked, 2) == [5, 6]
    only_price = ranking.rank(rows, "hybrid", weights=HybridWeights(0.0, 0.0, 1.0))
    assert order(only_price) == [2, 1, 4, 3]


def test_orders_fall_back_to_distance(rows):
    bare = rows.select("query_id", "product_id", "distance")
    for method in ("reviews", "price", "hybrid"):
        assert order(ranking.rank(bare, method)) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ranking.rank(bare, "unknown")
