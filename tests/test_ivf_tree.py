import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import ivf_tree
from shelfmark.options import IvfTreeOptions

DIM, GROUPS = 12, 30
OPTIONS = IvfTreeOptions(branches=(6, 5), iterations=6)


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(7)
    middle = draw.normal(size=(GROUPS, DIM)) * 4
    items = (middle[draw.integers(GROUPS, size=1500)] + draw.normal(size=(1500, DIM))).astype(np.float32)
    asked = (middle[draw.integers(GROUPS, size=60)] + draw.normal(size=(60, DIM))).astype(np.float32)
    return items, asked


@pytest.fixture(scope="module")
def tables(spark, data):
    def table(rows, key):
        made = [(at, [float(x) for x in row]) for at, row in enumerate(rows)]
        return spark.createDataFrame(made, f"{key} bigint, embedding array<float>")

    return table(data[1], "query_id"), table(data[0], "product_id").repartition(5)


@pytest.fixture(scope="module")
def tree(tables):
    levels = ivf_tree.train_levels(tables[1], OPTIONS)
    return ivf_tree.assign_leaves(tables[1], levels).cache(), levels


def matrix(rows):
    return np.array([row["embedding"] for row in rows], np.float32)


def by_query(found):
    out = {}
    for row in found.orderBy("query_id", found.columns[-1], "product_id").collect():
        out.setdefault(row["query_id"], []).append(row["product_id"])
    return out


def exact(data, k, allowed=None):
    items, asked = (rows.astype(np.float64) for rows in data)
    cost = ((asked[:, None] - items[None]) ** 2).sum(axis=2)
    if allowed is not None:
        cost[~allowed] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(items)), cost.shape), cost), axis=1)[:, :k]
    return {q: [int(i) for i in row if np.isfinite(cost[q, i])] for q, row in enumerate(order)}


def descended(rows, levels, probes, beam):
    """The leaves of every row by brute force."""
    top, leaves = (level.orderBy("cell").collect() for level in levels)
    names, parents = np.array([r["cell"] for r in leaves]), np.array([r["parent"] for r in leaves])
    near = lambda centres: ((rows[:, None].astype(np.float64) - centres[None]) ** 2).sum(axis=2)
    kept = np.array([r["cell"] for r in top])[np.argsort(near(matrix(top)), axis=1, kind="stable")[:, :beam]]
    cost = near(matrix(leaves))
    cost[~(kept[:, :, None] == parents[None, None]).any(axis=1)] = np.inf
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return [[int(names[i]) for i in line if np.isfinite(cost[q, i])] for q, line in enumerate(order)]


def test_levels_hold_children_of_every_cell(tree):
    top, leaves = tree[1]
    assert top.count() == 6 and leaves.count() == 30
    assert {(r["parent"], r["cell"] // 5) for r in leaves.collect()} == {(p, p) for p in range(6)}


def test_training_is_repeatable_whatever_the_layout(tables, tree):
    again = ivf_tree.train_levels(tables[1].repartition(3), OPTIONS)
    for one, other in zip(tree[1], again):
        assert one.exceptAll(other).isEmpty()


def test_vectors_lie_in_the_leaf_of_their_descent(tree, data):
    expected = descended(data[0], tree[1], 1, 1)
    assert {r["product_id"]: [r["cell"]] for r in tree[0].collect()} == dict(enumerate(expected))


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 0}])
def test_search_equals_brute_force_inside_the_leaves(tables, tree, data, sizes):
    leaf = np.array([r["cell"] for r in tree[0].orderBy("product_id").collect()])
    probed = descended(data[1], tree[1], 4, 2)
    allowed = np.array([np.isin(leaf, own) for own in probed])
    found = ivf_tree.search_tree(tables[0], tree[0], tree[1], 7, probes=4, beam=2, **sizes)
    assert by_query(found) == exact(data, 7, allowed)


def test_trained_tree_finds_most_in_a_fifth_of_the_leaves(tables, tree, data):
    found = by_query(ivf_tree.search_tree(tables[0], tree[0], tree[1], 10, probes=6, beam=3))
    hits = [len(set(found[q]) & set(ids)) / 10 for q, ids in exact(data, 10).items()]
    assert np.mean(hits) >= 0.9


def test_everything_probed_is_exact_and_survives_writing(spark, tables, tree, data, tmp_path):
    ivf_tree.write_tree(*tree, str(tmp_path / "tree"), 3)
    stored, levels = ivf_tree.read_tree(spark, str(tmp_path / "tree"), 2)
    found = ivf_tree.search_tree(tables[0], stored, levels, 7, probes=30, beam=6)
    assert by_query(found) == exact(data, 7)


def test_few_and_missing_vectors(spark, tables):
    few = tables[1].where("product_id < 3").unionByName(
        spark.range(900, 902).select(F.col("id").alias("product_id"), F.lit(None).cast("array<float>").alias("embedding"))
    )
    levels = ivf_tree.train_levels(few, IvfTreeOptions(branches=(2, 2, 2)))
    placed = ivf_tree.assign_leaves(few, levels)
    assert placed.count() == 5 and placed.where("cell is null").count() == 2
    found = ivf_tree.search_tree(tables[0], placed.where("cell is not null"), levels, 5, probes=8, beam=8)
    assert found.groupBy("query_id").count().where("count = 3").count() == 60


def test_one_cell_with_a_third_of_all_vectors_trains_on_a_bounded_sample(tables):
    hot = tables[1].withColumn("cell", F.when(F.col("product_id") % 3 == 0, 0).otherwise(F.col("product_id") % 7).cast("bigint"))
    centres = ivf_tree.split_cells(hot, 4, IvfTreeOptions(rows_per_centre=8))
    assert centres.groupBy("cell").count().where("count > 1").isEmpty()
    assert centres.groupBy("parent").count().where("count = 4").count() == 7
