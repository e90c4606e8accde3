"""How many pairs a search looks at."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import one_pass, topk_kernel
from shelfmark.operators.blocks import matrix_of
from shelfmark.operators.topk_kernel import BestPairs, Everything, scan_block
from test_knn import brute, by_query, data, tables  # noqa: F401


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("k", [1, 7, 300])
def test_a_rule_is_asked_for_few_pairs(metric, k):
    draw = np.random.default_rng(k)
    items, queries = draw.normal(size=(9000, 8)).astype(np.float32), draw.normal(size=(300, 8)).astype(np.float32)
    passes, looked = draw.random((300, 9000)) < 0.4, []
    passes[:3] = False
    passes[:2, 5000:5002] = True

    class Rule(Everything):
        def dense(self, rows, low, high):
            looked.append(len(rows) * (high - low))
            return passes[rows, low:high]

        def pairs(self, rows, items):
            looked.append(len(rows))
            return passes[rows, items]

    best = BestPairs(300, k, repeated=False)
    scan_block(best, queries, np.arange(300), items, np.arange(9000), metric, Rule())
    query, item, _ = best.result()
    left, right = queries.astype(np.float64)[:, None], items.astype(np.float64)[None]
    cost = ((left - right) ** 2).sum(axis=2) if metric == "l2" else -(left * right).sum(axis=2)
    cost[~passes] = np.inf
    for q in range(300):
        want = np.argsort(cost[q], kind="stable")[: min(k, passes[q].sum())]
        assert set(item[query == q]) == set(want)
    if k < 300:
        assert sum(looked) < 0.4 * passes.size


def test_few_wide_cells_meet_each_vector_once(tables, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(one_pass, "_in_cells", None)
    queries, vectors = tables
    cells = F.array(F.col("product_id") % 2, F.col("product_id") % 3 + 10, F.lit(70).cast("bigint") + F.col("product_id") % 5)
    stored = vectors.withColumn("cell", F.explode(cells))
    own = F.array(F.col("query_id") % 2, F.col("query_id") % 3 + 10, F.lit(70) + F.col("query_id") % 5, F.lit(999))
    asked = queries.select("query_id", F.explode(own).alias("cell"))
    found = one_pass.search_groups(queries, stored, asked, 6, repeated=True)
    ids = np.arange(len(data[0]))
    allowed = {q: [i for i in ids if any(q % m == i % m for m in (2, 3, 5))] for q in range(len(data[1]))}
    assert by_query(found, "cost") == brute(data[1], data[0], 6, allowed=allowed)


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("k", [1, 30, 900])
def test_items_in_one_call_are_costed_once(metric, k, monkeypatch):
    """Costs in float64 are for what is left of all items, not of every block of them."""
    draw = np.random.default_rng(k)
    items, queries = (draw.normal(size=(n, 16)).astype(np.float32) for n in (30_000, 700))
    items[20_000:20_008] = items[4]
    costed, exact = [], topk_kernel.exact_costs
    monkeypatch.setattr(topk_kernel, "exact_costs", lambda left, *rest: costed.append(len(left)) or exact(left, *rest))
    best = BestPairs(700, k, repeated=False)
    pieces = (items[low : low + 7001] for low in range(0, 30_000, 7001))
    scan_block(best, queries, np.arange(700), topk_kernel.Items(pieces, metric, 30_000), np.arange(30_000), metric)
    query, item, cost = best.result()
    assert sum(costed) < 1.1 * 700 * k + 700 * 8
    left, right = queries.astype(np.float64), items.astype(np.float64)
    for q in range(0, 700, 29):
        costs = -(right @ left[q]) if metric == "ip" else ((right - left[q]) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(30_000), np.round(costs, 9)))[:k]
        assert set(item[query == q]) == set(want)


def test_groups_of_items_are_not_lost_with_an_empty_one():
    rough = np.full((32, 3), 9, np.float32)
    rough[1, 0], rough[2, 0], rough[31, 2], rough[17] = np.nan, 1, 2, np.nan
    for limit in (3, np.inf):
        item, query = topk_kernel._near(rough, np.array([3, 3, limit], np.float32))
        assert {(2, 0), (31, 2)} <= set(zip(item, query)) and not np.isnan(rough[item, query]).any()


def test_streamed_vectors_of_a_cell_are_scanned_together():
    batch = lambda *ids: pa.record_batch({"product_id": pa.array(ids, pa.int64()), "embedding": pa.array([[float(i)] for i in ids], pa.list_(pa.float32()))})
    stream = iter([(1, batch(0, 1)), (2, batch(2)), (1, batch(3)), (1, batch(4, 5))])
    found = [(cell, ids.column(0).to_pylist(), len(ready)) for cell, ids, ready in one_pass._streamed(stream, matrix_of, "l2", 4)]
    assert found == [(1, [0, 1, 3], 3), (2, [2], 1), (1, [4, 5], 2)]
    held = [(0, batch(i)) for i in range(5)]
    (block,) = one_pass._Slice(held, matrix_of, "l2", False).blocks
    assert sorted(block[1].column(0).to_pylist()) == list(range(5)) and not held


def test_partial_results_weigh_more_than_copies_of_vectors():
    """200,000 searches on 157 MB of vectors: 6.4 million lists of 30 were found and merged, to move as many bytes."""
    assert one_pass._grid(200_000, 615_384 * 256, 30, 256, 32, None, 32) == (1, 32)
    assert one_pass._grid(100, 615_384 * 256, 30, 256, 32, None, 32) == (32, 1)
