import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from shelfmark.operators import blocks, encode, ivf, knn, lsh, pq
from shelfmark.options import IvfOptions, LshOptions, PqOptions

DIM = 16
ITEMS, QUERIES = 600, 40


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, DIM)) * 3
    items = (centres[rng.integers(0, 8, ITEMS)] + rng.normal(size=(ITEMS, DIM))).astype(np.float32)
    items[100:110] = items[0]  # equal vectors: ties by id
    queries = (items[rng.integers(0, ITEMS, QUERIES)] + rng.normal(size=(QUERIES, DIM))).astype(
        np.float32
    )
    queries[0] = items[0]
    return items, queries


@pytest.fixture(scope="module")
def tables(spark, data):
    items, queries = data
    make = lambda rows, name: spark.createDataFrame(
        [(at, row.tolist()) for at, row in enumerate(rows)], f"{name} bigint, embedding array<float>"
    )
    return (
        make(queries, "query_id").repartition(3).cache(),
        make(items, "product_id").repartition(7).cache(),
    )


def brute(queries, items, k, metric="l2", allowed=None):
    left, right = queries.astype(np.float64), items.astype(np.float64)
    cost = (
        ((left[:, None] - right[None]) ** 2).sum(axis=2) if metric == "l2" else -(left @ right.T)
    )
    found = {}
    for q, row in enumerate(cost):
        ids = np.arange(len(items)) if allowed is None else np.array(sorted(allowed[q]), dtype=int)
        order = np.lexsort((ids, np.round(row[ids], 9)))[:k]
        found[q] = ids[order].tolist()
    return found


def by_query(df, value="distance"):
    found = {}
    rows = df.collect()
    sign = -1 if value == "similarity" else 1
    for row in sorted(rows, key=lambda r: (r["query_id"], sign * r[value], r["product_id"])):
        found.setdefault(row["query_id"], []).append(row["product_id"])
    return found


PLANS = {
    "scan queries": {},
    "scan vectors": {"side_rows": 0},
    "one pass": {"side_rows": 0, "block_rows": 0, "held_bytes": 2000},
}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("metric,value", [("l2", "distance"), ("ip", "similarity")])
@pytest.mark.parametrize("k", [1, 12])
def test_every_plan_equals_brute_force(tables, data, plan, metric, value, k):
    queries, vectors = tables
    items, asked = data
    found = knn.nearest(queries, vectors, k, metric, **PLANS[plan])
    assert by_query(found, value) == brute(asked, items, k, metric)


@pytest.mark.parametrize("plan", PLANS)
def test_packed_vectors_give_the_same(tables, data, plan):
    queries, vectors = tables
    packed = blocks.pack(vectors, "embedding")
    found = knn.nearest(queries, packed, 12, **PLANS[plan])
    assert by_query(found) == brute(data[1], data[0], 12)


def test_small_batches_are_joined(data):
    import pyarrow as pa

    items = data[0]
    batches = [
        pa.RecordBatch.from_arrays([blocks.list_column(items[low : low + 10])], ["embedding"])
        for low in range(0, ITEMS, 10)
    ]
    sizes = [b.num_rows for b in blocks.large_batches(iter(batches), "embedding", 5000)]
    assert sum(sizes) == ITEMS and min(sizes[:-1]) > 10


@pytest.mark.parametrize("held_bytes", [1000, 20_000, 1 << 20])
def test_groups_of_two_large_sides(tables, data, held_bytes):
    found = knn.nearest(*tables, 9, side_rows=0, block_rows=0, held_bytes=held_bytes)
    assert by_query(found) == brute(data[1], data[0], 9)


def test_large_sides_are_scanned_in_place(spark, tables, data, tmp_path):
    """Few queries travel: no exchange lies below a vector scan."""
    tables[1].write.parquet(f"{tmp_path}/vectors")
    stored = spark.read.parquet(f"{tmp_path}/vectors")
    block = knn.query_block(tables[0], 9)
    found, _ = knn._scan_vectors(tables[0], block, stored, 9, "l2", None, blocks.matrix_of)
    assert "Exchange" not in plan_of(found)


@pytest.mark.parametrize("plan", PLANS)
def test_a_repeated_query_id_is_an_error_in_every_plan(tables, plan):
    queries, vectors = tables
    with pytest.raises(ValueError, match="more than once"):
        knn.nearest(queries.union(queries.limit(1)), vectors, 2, **PLANS[plan])


@pytest.mark.parametrize("metric,value", [("l2", "distance"), ("ip", "similarity")])
@pytest.mark.parametrize("share", [4, 500])
def test_probe_part_bounds_the_scan(spark, tables, data, tmp_path, monkeypatch, metric, value, share):
    from shelfmark.plans.search import flat_index
    from shelfmark.sources import indexes

    indexes.write_flat(tables[1], str(tmp_path), share)
    stored = indexes.read_flat(spark, str(tmp_path))
    monkeypatch.setattr(blocks, "PROBE_TASKS", 1)
    monkeypatch.setattr(blocks, "PROBE_RESULTS", 1)
    probe = stored.where("probe = 1")
    found = knn.nearest(tables[0], stored, 9, metric, probe=probe, side_rows=0)
    assert by_query(found, value) == brute(data[1], data[0], 9, metric)
    block = knn.query_block(tables[0], 9)
    bound = knn._probe_bound(tables[0], block, probe, 9, metric, blocks.matrix_of)
    assert np.isfinite(bound).all() == (probe.count() >= 9)
    assert by_query(flat_index(stored, metric)(tables[0], 9), value) == by_query(found, value)


def test_merge_in_salted_groups(tables, data, monkeypatch):
    monkeypatch.setattr(blocks, "MERGE_ROWS", 10)
    found = knn.nearest(*tables, 9, side_rows=0)
    assert "_salt" in found._jdf.queryExecution().analyzed().toString()
    assert by_query(found) == brute(data[1], data[0], 9)


def test_kernel_settles_often(data):
    from shelfmark.operators.topk_kernel import BestPairs, scan_block

    items, queries = data
    best = BestPairs(len(queries), 5)
    best.room = 50
    everyone = np.arange(len(queries))
    for low in range(0, ITEMS, 64):
        part = slice(low, low + 64)
        scan_block(best, queries, everyone, items[part], np.arange(ITEMS)[part], "l2")
    query, item, _ = best.result()
    expected = brute(queries, items, 5)
    assert {q: item[query == q].tolist() for q in everyone} == expected


def test_a_large_query_side_is_not_shuffled(tables, data, monkeypatch):
    assert "REPARTITION" in plan_of(knn.nearest(*tables, 3))
    monkeypatch.setattr(blocks, "SIDE_ROWS", 5)
    found = knn.nearest(*tables, 3)
    assert "Exchange" not in plan_of(found).split("InMemoryRelation")[0]
    assert by_query(found) == brute(data[1], data[0], 3)


def test_equal_vectors_tie_by_id(tables):
    found = knn.nearest(*tables, 11)
    assert by_query(found)[0] == [0, *range(100, 110)]


def test_fewer_vectors_than_k(tables):
    queries, vectors = tables
    assert knn.nearest(queries, vectors.where("product_id < 4"), 10).count() == 4 * QUERIES


def test_more_neighbours_extend_fewer(tables):
    few, more = by_query(knn.nearest(*tables, 5)), by_query(knn.nearest(*tables, 6))
    assert all(more[q][:5] == few[q] for q in few)


def test_missing_vectors_are_left_out(spark, tables):
    queries, vectors = tables
    holes = vectors.withColumn(
        "embedding", F.when(F.col("product_id") % 2 == 0, F.col("embedding"))
    )
    for sizes in PLANS.values():
        found = knn.nearest(queries, holes, 3, **sizes)
        assert all(row["product_id"] % 2 == 0 for row in found.collect())


def test_no_queries(tables):
    queries, vectors = tables
    for sizes in PLANS.values():
        assert knn.nearest(queries.where("query_id < 0"), vectors, 3, **sizes).count() == 0


def test_text_ids_of_queries(spark, tables, data):
    queries, vectors = tables
    named = queries.withColumn("query_id", F.concat(F.lit("q"), F.col("query_id")))
    found = by_query(knn.nearest(named, vectors, 3, side_rows=0))
    assert found == {f"q{q}": ids for q, ids in brute(data[1], data[0], 3).items()}


def test_bad_input(spark, tables):
    queries, vectors = tables
    with pytest.raises(TypeError):
        knn.nearest(queries, vectors.withColumn("product_id", F.lit("x")), 3)


def test_no_plan_makes_all_pairs(tables):
    for sizes in PLANS.values():
        plan = plan_of(knn.nearest(*tables, 3, **sizes))
        assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def cells(tables):
    vectors = tables[1]
    centroids = ivf.train_centroids(vectors, IvfOptions(cells=8)).cache()
    return ivf.assign_cells(vectors, centroids).cache(), centroids


def test_vectors_go_to_the_nearest_centroid(cells, data):
    assigned, centroids = cells
    centres = np.array([row["embedding"] for row in centroids.orderBy("cell").collect()])
    expected = {q: ids[0] for q, ids in brute(data[0], centres.astype(np.float32), 1).items()}
    assert {row["product_id"]: row["cell"] for row in assigned.collect()} == expected


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 0}])
def test_probed_cells_equal_brute_force(tables, cells, data, sizes):
    assigned, centroids = cells
    probed, inside = {}, {}
    for row in ivf.nearest_cells(tables[0], centroids, 2).collect():
        probed.setdefault(row["query_id"], set()).add(row["cell"])
    for row in assigned.collect():
        inside.setdefault(row["cell"], set()).add(row["product_id"])
    allowed = {q: set().union(*(inside.get(c, set()) for c in own)) for q, own in probed.items()}
    found = ivf.search_cells(tables[0], assigned, centroids, 7, probes=2, **sizes)
    assert by_query(found) == brute(data[1], data[0], 7, allowed=allowed)


def test_all_cells_equal_exact_search(tables, cells, data):
    found = ivf.search_cells(tables[0], *cells, 7, probes=8)
    assert by_query(found) == brute(data[1], data[0], 7)


def recall(found, exact):
    return np.mean([len(set(found.get(q, [])) & set(ids)) / len(ids) for q, ids in exact.items()])


def test_probing_few_cells_finds_most(tables, cells, data):
    found = ivf.search_cells(tables[0], *cells, 10, probes=2)
    assert recall(by_query(found), brute(data[1], data[0], 10)) >= 0.8


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 0}])
def test_shared_buckets_equal_brute_force(tables, data, sizes):
    queries, vectors = tables
    items, asked = data
    lines = lsh.directions(DIM, LshOptions(tables=4))
    width = 2.0
    cell = lambda rows: np.floor(rows.astype(np.float64) @ lines.T / width)
    shared = (cell(asked)[:, None] == cell(items)[None]).any(axis=2)
    allowed = {q: np.flatnonzero(row).tolist() for q, row in enumerate(shared)}
    stored = lsh.bucket_rows(vectors, lines, width)
    found = lsh.search_buckets(queries, stored, lines, width, 6, **sizes)
    assert by_query(found) == brute(asked, items, 6, allowed=allowed)


def test_buckets_find_most(tables, data):
    queries, vectors = tables
    lines = lsh.directions(DIM, LshOptions())
    stored = lsh.bucket_rows(vectors, lines, 4.0)
    found = lsh.search_buckets(queries, stored, lines, 4.0, 10)
    assert recall(by_query(found), brute(data[1], data[0], 10)) >= 0.9


@pytest.fixture(scope="module")
def coded(tables):
    codebook = pq.train_codebook(tables[1], PqOptions(subspaces=4, bits=4)).cache()
    return pq.encode_vectors(tables[1], codebook).cache(), codebook


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 0}])
def test_coded_search_equals_brute_force_on_decoded(tables, coded, data, sizes):
    codes, codebook = coded
    books = {}
    for row in codebook.collect():
        books[row["subspace"], row["code"]] = row["centre"]
    decoded = np.zeros_like(data[0])
    for row in codes.collect():
        decoded[row["product_id"]] = sum(
            (books[part, code] for part, code in enumerate(row["codes"])), []
        )
    found = pq.search_codes(tables[0], codes, codebook, 8, **sizes)
    assert by_query(found) == brute(data[1], decoded, 8)


def test_codes_find_many(tables, data):
    codebook = pq.train_codebook(tables[1], PqOptions(subspaces=8, bits=6))
    codes = pq.encode_vectors(tables[1], codebook)
    found = pq.search_codes(tables[0], codes, codebook, 10)
    assert recall(by_query(found), brute(data[1], data[0], 10)) >= 0.6


def test_subspaces_divide_the_dimension():
    assert [pq.subspaces(d, 8) for d in (384, 64, 12, 7, 10)] == [8, 8, 6, 7, 5]


def test_training_is_repeatable(tables):
    options = IvfOptions(cells=5, train_rows=200)
    first, again = (ivf.train_centroids(tables[1], options).collect() for _ in range(2))
    assert first == again


def test_hashed_embedding_counts_tokens(spark):
    import hashlib

    df = spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "id int, text string")
    rows = encode.hashed_embeddings(df, "text", 8).orderBy("id").collect()
    expected = [0.0] * 8
    for token in "b a b".split():
        expected[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 8] += 1
    assert rows[0]["embedding"] == expected
    assert rows[1]["embedding"] == rows[2]["embedding"] == [0.0] * 8


def test_encoder_sees_batches(spark):
    def load():
        return lambda texts: np.array([[len(texts), len(text)] for text in texts])

    df = spark.createDataFrame([("x" * n,) for n in range(70)], "title string").coalesce(1)
    rows = encode.encode(df, load, batch_rows=32).collect()
    assert sorted({row["embedding"][0] for row in rows}) == [6.0, 32.0]
    assert [row["embedding"][1] for row in rows] == [float(len(row["title"])) for row in rows]


def test_attach_products_reads_a_large_catalog_in_place(spark, tables, monkeypatch):
    found = knn.nearest(*tables, 3, side_rows=0)
    products = spark.range(ITEMS).withColumnRenamed("id", "product_id")
    monkeypatch.setattr(blocks, "SIDE_ROWS", 10)
    plan = plan_of(knn.attach_products(found, products, few_candidates=True))
    assert "BuildLeft" in plan and "SortMergeJoin" not in plan
