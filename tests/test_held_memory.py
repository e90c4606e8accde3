"""Memory and moved rows of searches with many results."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators import one_pass
from shelfmark.operators.topk_kernel import BestPairs
from test_knn import brute, by_query, data, tables  # noqa: F401


def test_best_pairs_take_few_times_what_they_keep():
    queries, k = 2000, 1000
    draw = np.random.default_rng(3)
    rows, costs = np.repeat(np.arange(queries), 100), []
    best = BestPairs(queries, k, repeated=False)
    tracemalloc.start()
    for turn in range(40):
        cost = draw.random(len(rows))
        best.offer(rows, np.tile(np.arange(100) + 100 * turn, queries), cost)
        costs.append(cost[:100].copy())
    found = [(query, item, cost) for query, item, cost in best.portions()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(query) for query, _, _ in found) == queries * k
    assert peak < 80 * queries * k  # bytes; a pair itself takes 20
    first = np.sort(found[0][2][found[0][0] == 0])
    assert np.allclose(first, np.sort(np.concatenate(costs))[:k])


def test_vectors_held_whole_need_no_merge(tables, data, monkeypatch):  # noqa: F811
    def merged(*_):
        raise AssertionError("partial results")

    monkeypatch.setattr(one_pass, "merge_packed", merged)
    found = one_pass.search(*tables, 2000, hold="vectors")
    assert by_query(found, "cost") == brute(data[1], data[0], 2000)


def test_cells_held_whole_need_no_merge(tables, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(one_pass, "merge_packed", None)
    vectors = tables[1].withColumn("cell", F.explode(F.array(F.col("product_id") % 3, F.lit(5).cast("bigint"))))
    asked = tables[0].select("query_id", F.explode(F.array(*[F.lit(c).cast("bigint") for c in (0, 1, 2, 5)])).alias("cell"))
    found = one_pass.search_groups(tables[0], vectors, asked, 2000, hold="vectors", repeated=True)
    assert by_query(found, "cost") == brute(data[1], data[0], 2000)


def test_slices_meet_parts_of_the_queries(tables, data, monkeypatch):  # noqa: F811
    shapes = []
    grid = one_pass._grid
    monkeypatch.setattr(one_pass, "_grid", lambda *a: shapes.append((3, 4)) or grid(*a) and shapes[-1])
    found = one_pass.search(*tables, 12, hold="vectors")
    assert shapes == [(3, 4)] and by_query(found, "cost") == brute(data[1], data[0], 12)


def test_rows_of_a_repeated_id_are_merged(tables):  # noqa: F811
    queries, vectors = tables
    twice = queries.unionByName(queries.where("query_id = 3"))
    found = one_pass.search(twice, vectors, 150, hold="vectors").where("query_id = 3")
    assert found.count() == 150 and found.select("product_id").distinct().count() == 75


def test_groups_of_held_queries_keep_a_part_of_the_pairs(tables, data, monkeypatch):  # noqa: F811
    """As many results a group as where vectors are held."""
    held = []
    dealt = one_pass._dealt
    monkeypatch.setattr(one_pass, "_dealt", lambda df, kind, n, all: held.append((kind, n)) or dealt(df, kind, n, all))
    monkeypatch.setattr(one_pass.blocks, "KEPT_PAIRS", tables[0].count() * 12 // 10)
    found = one_pass.search(*tables, 12, hold="queries")
    assert max(n for kind, n in held if kind == one_pass.HELD) >= 40
    assert by_query(found, "cost") == brute(data[1], data[0], 12)
