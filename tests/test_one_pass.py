"""Searches of two large sides that are read once, and searches that filter first."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from shelfmark.operators import blocks, categories, filtered, filters, ivf, knn, one_pass
from shelfmark.operators.ranking import rank
from shelfmark.options import RankedSearchOptions, StoreSearchOptions
from shelfmark.plans import search as plans
from shelfmark.sources import indexes
from test_knn import brute, by_query, data, tables  # noqa: F401

HOLD = ("queries", "vectors")


@pytest.mark.parametrize("hold", HOLD)
@pytest.mark.parametrize("held_bytes", [500, 8000, None])
@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_either_side_may_be_held(tables, data, hold, held_bytes, metric):  # noqa: F811
    found = one_pass.search(*tables, 12, metric, hold=hold, held_bytes=held_bytes)
    assert by_query(found, "cost") == brute(data[1], data[0], 12, metric)


def test_each_side_is_read_once(spark, tables):  # noqa: F811
    queries, vectors = tables
    seen = {side: spark.sparkContext.accumulator(0) for side in HOLD}

    def watched(df, side):
        def run(batches):
            for batch in batches:
                seen[side].add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    for hold in HOLD:
        held = one_pass._dealt(watched(queries if hold == "queries" else vectors, "queries" if hold == "queries" else "vectors"), 0, 5, False)
        other = one_pass._dealt(watched(vectors if hold == "queries" else queries, "vectors" if hold == "queries" else "queries"), 1, 5, True)
        before = {side: seen[side].value for side in HOLD}
        packed = one_pass._grouped(held, other, 5, 5)
        one_pass._scanned(packed, 3, "l2", blocks.matrix_of, None, queries.schema["query_id"].dataType, hold == "queries").count()
        assert seen["queries"].value - before["queries"] == queries.count()
        assert seen["vectors"].value - before["vectors"] == vectors.count()


def test_many_partial_results_merge_in_salted_groups(tables, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(blocks, "MERGE_ROWS", 10)
    monkeypatch.setattr(one_pass, "PAIRS_HELD", 40)
    found = one_pass.search(*tables, 12, hold="vectors", held_bytes=2000)
    assert by_query(found, "cost") == brute(data[1], data[0], 12)


def test_probe_bounds_what_groups_return(tables, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(blocks, "PROBE_TASKS", 1)
    probe = tables[1].where("product_id % 5 = 0")
    found = one_pass.search(*tables, 9, hold="vectors", held_bytes=2000, probe=probe)
    assert by_query(found, "cost") == brute(data[1], data[0], 9)
    few = one_pass.search(*tables, 9, hold="vectors", held_bytes=2000, probe=probe.where("product_id < 20"))
    assert by_query(few, "cost") == brute(data[1], data[0], 9)


def test_choice_of_the_held_side_moves_fewer_bytes(tables, monkeypatch):  # noqa: F811
    chosen = []
    scanned = one_pass._scanned
    monkeypatch.setattr(one_pass, "_scanned", lambda *a: chosen.append(a[-1]) or scanned(*a))

    def often(df, key):
        copies = df.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(99))))
        return copies.select((F.col(key) * 100 + F.col("n")).alias(key), "embedding")

    queries, vectors = tables
    one_pass.search(often(queries, "query_id"), vectors, 5)
    one_pass.search(queries, often(vectors, "product_id"), 5)
    assert chosen == [True, False]


def test_no_plan_makes_all_pairs(tables):  # noqa: F811
    for hold in HOLD:
        plan = plan_of(one_pass.search(*tables, 3, hold=hold))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def celled(tables):  # noqa: F811
    vectors = tables[1]
    centroids = ivf.label_centroids(vectors.withColumn("mark", F.col("product_id") % 6), "mark").cache()
    return ivf.assign_cells(vectors, centroids).cache(), centroids


@pytest.mark.parametrize("held_bytes", [None, 1500])
@pytest.mark.parametrize("probes", [1, 3])
@pytest.mark.parametrize("hold", HOLD)
def test_cells_meet_the_queries_that_ask(tables, data, celled, held_bytes, probes, hold):  # noqa: F811
    cells, centroids = celled
    asked = ivf.nearest_cells(tables[0], centroids, probes)
    found = one_pass.search_groups(tables[0], cells, asked, 8, held_bytes=held_bytes, hold=hold)
    member = {r.product_id: r.cell for r in cells.collect()}
    wanted = {}
    for r in asked.collect():
        wanted.setdefault(r.query_id, set()).update(i for i, c in member.items() if c == r.cell)
    want = brute(data[1], data[0], 8, allowed=wanted)
    assert by_query(found, "cost") == {q: ids for q, ids in want.items() if ids}


def test_hot_cell_is_split(spark, tables, data):  # noqa: F811
    """All vectors in one cell, and a cell that nobody has."""
    cells = tables[1].withColumn("cell", F.lit(7).cast("bigint"))
    asked = tables[0].select("query_id", F.explode(F.array(F.lit(7).cast("bigint"), F.lit(8).cast("bigint"))).alias("cell"))
    width = blocks.vector_bytes(cells, "embedding")
    parts, number = one_pass.cell_groups(cells, asked, width, 10)
    assert number == 10 and [len(r.groups) for r in parts.collect()] == [10]
    for hold in HOLD:
        found = one_pass.search_groups(tables[0], cells, asked, 5, held_bytes=3000, hold=hold)
        assert by_query(found, "cost") == brute(data[1], data[0], 5)


def test_queries_of_one_cell_are_spread(tables):  # noqa: F811
    asked = tables[0].select("query_id", F.lit(3).cast("bigint").alias("cell"))
    sizes = one_pass._query_groups(tables[0], asked, 4, 40).groupBy("group").count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == 40


def test_empty_sides(tables):  # noqa: F811
    queries, vectors = tables
    for hold in HOLD:
        assert one_pass.search(queries.limit(0), vectors, 3, hold=hold).count() == 0
        assert one_pass.search(queries, vectors.limit(0), 3, hold=hold).count() == 0
    cells = vectors.withColumn("cell", F.lit(1).cast("bigint"))
    none = queries.select("query_id", F.lit(2).cast("bigint").alias("cell"))
    for hold in HOLD:
        assert one_pass.search_groups(queries, cells, none, 3, hold=hold).count() == 0
        assert one_pass.search_groups(queries.limit(0), cells, none.limit(0), 3, hold=hold).count() == 0


# Filters before the cut


@pytest.fixture(scope="module")
def shelf(spark, tables):  # noqa: F811
    """Products with missing attributes, searches with some of the conditions."""
    n = F.col("product_id")
    products = tables[1].select(
        "product_id",
        F.when(n % 9 != 0, (n * 37 % 200).cast("double") / 2).alias("price"),
        F.when(n % 7 != 0, (n % 11).cast("double") / 2).alias("stars"),
        F.when(n % 13 != 0, n % 5 == 0).alias("isBestSeller"),
        F.when(n % 8 != 0, F.concat(F.lit("Brand#"), (n % 12).cast("string"))).alias("brand"),
        F.concat(F.lit("Item "), n.cast("string")).alias("title"),
        F.lit("https://x").alias("productURL"),
        n.alias("reviews"),
    ).cache()
    q = F.col("query_id")
    asked = tables[0].select(
        "query_id",
        "embedding",
        F.when(q % 2 == 0, (q % 30).cast("double")).alias("min_price"),
        F.when(q % 3 == 0, (q % 30 + 20).cast("double")).alias("max_price"),
        F.when(q % 5 < 3, (q % 4).cast("double")).alias("min_rating"),
        F.when(q % 4 < 3, q % 4 == 0).alias("bestsellers_only"),
        F.when(q % 6 == 1, F.concat(F.lit("BRAND#"), (q % 3).cast("string"))).alias("brand_hint"),
        F.when(q % 2 == 0, F.lit("shoes")).otherwise(F.lit("hat")).alias("query_text"),
    ).cache()
    return asked, products


def filter_then_rank(asked, products, vectors, k, rule):
    """Every pair, the filters of the other module, then the cut."""
    pairs = knn.nearest(asked.select("query_id", "embedding"), vectors, vectors.count())
    found = pairs.join(products, "product_id").join(asked.drop("embedding"), "query_id")
    if rule.least_price is not None:
        found = filters.valid_price(found, rule.least_price)
    found = filters.bestsellers(filters.price_between(found))
    found = filters.brand_contains(filters.rating_at_least(found, zero_is_off=rule.zero_rating_is_off))
    return by_query(rank(found, "distance", k))


PLANS = ({}, {"block_rows": 0}, {"block_rows": 0, "held_bytes": 1500})


@pytest.mark.parametrize("options", PLANS)
@pytest.mark.parametrize("rule", [filtered.STORE_RULE, filtered.RANKED_RULE])
@pytest.mark.parametrize("k", [1, 6, 1000])
def test_filter_first_equals_filter_then_rank(tables, shelf, options, rule, k):  # noqa: F811
    asked, products = shelf
    items = tables[1].join(products, "product_id")
    found = by_query(filtered.nearest_matching(asked, items, k, rule=rule, **options))
    want = filter_then_rank(asked, products, tables[1], k, rule)
    assert found == want and (k < 1000 or any(len(ids) < k for ids in want.values()))


def test_stored_index_prunes_by_price(spark, tables, shelf, tmp_path):  # noqa: F811
    asked, products = shelf
    indexes.write_matching(tables[1], products, str(tmp_path), rows_per_file=50)
    stored = indexes.read_matching(spark, str(tmp_path))
    bounds = stored.groupBy(F.input_file_name().alias("file")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert len(bounds) >= 6 and max(b.n for b in bounds) < 250
    narrow = [b.high - b.low for b in bounds if b.low is not None]
    assert max(narrow) < 60
    some = asked.where("query_id % 6 = 0").withColumns({"min_price": F.lit(10.0), "max_price": F.lit(12.0)})
    found = filtered.nearest_matching(some, stored, 4)
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(price,10.0)" in plan and "LessThanOrEqual(price,12.0)" in plan
    assert by_query(found) == filter_then_rank(some, products, tables[1], 4, filtered.STORE_RULE)


def test_missing_columns_are_skipped(tables, data):  # noqa: F811
    queries, vectors = tables
    assert by_query(filtered.nearest_matching(queries, vectors, 5)) == brute(data[1], data[0], 5)
    asked = queries.withColumns({"min_price": F.lit(3.0), "brand_hint": F.lit("x")})
    assert by_query(filtered.nearest_matching(asked, vectors, 5)) == brute(data[1], data[0], 5)
    none = vectors.withColumn("price", F.lit(None).cast("double"))
    assert filtered.nearest_matching(queries, none, 5).count() == 0
    assert filtered.nearest_matching(queries.limit(0), none, 5).count() == 0


def test_repeated_query_is_an_error(tables):  # noqa: F811
    with pytest.raises(ValueError, match="more than once"):
        filtered.nearest_matching(tables[0].union(tables[0]), tables[1], 3)


def test_searches_never_lose_matches_behind_the_cut(spark, tables, shelf):  # noqa: F811
    asked, products = shelf
    searches = asked.drop("brand_hint").withColumns({"price_min": F.lit(30.0), "price_max": F.lit(34.0)}).drop("min_price", "max_price")
    taxonomy = categories.taxonomy_of(spark, {"footwear": ["boots"]})
    options = StoreSearchOptions(top_k=4, fetch_multiplier=5, category_multiplier=2)
    items = tables[1].join(products, "product_id")
    index = plans.matching_index(items)
    first = plans.store_search(searches, products, index, taxonomy, options, filter_first=True)
    cut = plans.store_search(searches, products, plans.flat_index(tables[1]), taxonomy, options)
    bound = searches.select("query_id", "embedding", F.lit(30.0).alias("min_price"), F.lit(34.0).alias("max_price"), "min_rating", "bestsellers_only")
    want = filter_then_rank(bound.withColumn("brand_hint", F.lit(None).cast("string")), products, tables[1], 4, filtered.STORE_RULE)
    got = {}
    for r in first.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    assert got == want
    assert cut.count() < first.count()
    ranked = plans.ranked_search(asked, products, plans.matching_index(items, rule=filtered.RANKED_RULE), RankedSearchOptions(top_k=3), given_filters=True, filter_first=True)
    assert ranked.groupBy("query_id").count().agg(F.max("count")).first()[0] == 3


def test_hints_are_looked_up_by_distinct_text():
    queries = pa.record_batch({"brand_hint": pa.array(["a", None, "b", "a"])})
    items = pa.record_batch({"brand": pa.array(["xax", None, "b", "b"])})
    found = filtered.matches(queries, items, np.arange(4), filtered.RANKED_RULE)
    assert found.tolist() == [[True, False, False, False], [True] * 4, [False, False, True, True], [True, False, False, False]]


def test_queries_are_not_sent_to_all_parts_of_few_cells(spark, monkeypatch):
    """With few cells, each is dealt over many groups; sending every query to all of them moves more than the vectors do."""
    rng = np.random.default_rng(4)
    stored, asking = (rng.normal(size=(n, 64)).astype(np.float32) for n in (300, 2000))
    vectors = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(stored)], "product_id bigint, embedding array<float>, cell bigint")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asking)], "query_id bigint, embedding array<float>")
    asked = queries.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("cell"))
    seen, scanned = [], one_pass._scanned
    monkeypatch.setattr(one_pass, "_scanned", lambda *given: seen.append(given[6:]) or scanned(*given))
    found = one_pass.search_groups(queries, vectors, asked, 5)
    assert by_query(found, "cost") == brute(asking, stored, 5, "l2")
    assert seen == [(True, False)]  # queries held; before, vectors were, in partial results of 32 groups
