"""Published indexes, postings, and repeatable training."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import kmeans, lsh, pq
from shelfmark.options import PqOptions
from shelfmark.sources import published
from test_knn import brute, by_query, data, tables  # noqa: F401


@pytest.fixture(scope="module")
def saved(tables, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("hashed"))
    published.save_hashed(tables[1], lsh.directions(16), 4.0, path)
    return path


def folder_bytes(path, name):
    return sum(f.stat().st_size for f in Path(path).glob(f"v-*/{name}/*.parquet"))


def test_vectors_are_stored_once_and_postings_are_narrow(spark, saved, tables):  # noqa: F811
    index = published.load_hashed(spark, saved)
    assert index.vectors.count() == 600 and index.postings.count() == 600 * len(index.lines)
    assert index.postings.columns == ["cell", "product_id"]


@pytest.mark.parametrize("extra", [0, 5])
def test_postings_find_what_shares_a_bucket(spark, saved, tables, data, extra):  # noqa: F811
    items, asked = data
    index = published.load_hashed(spark, saved)
    place = lambda rows: rows.astype(np.float64) @ index.lines.T / 4.0
    of = np.floor(place(items)).astype(int)
    wanted = {}
    for q, at in enumerate(place(asked)):
        base = np.floor(at).astype(int)
        sides = sorted((d, line, b) for line in range(len(at)) for d, b in ((at[line] - base[line], base[line] - 1), (1 - (at[line] - base[line]), base[line] + 1)))
        buckets = {(line, b) for line, b in enumerate(base)} | {(line, b) for _, line, b in sides[:extra]}
        wanted[q] = {i for i, row in enumerate(of) if any((line, b) in buckets for line, b in enumerate(row))}
    found = lsh.search_postings(tables[0], index.postings, index.vectors, index.lines, index.bucket_length, 9, extra=extra)
    assert by_query(found) == {q: ids for q, ids in brute(asked, items, 9, allowed=wanted).items() if ids}
    many = lsh.search_postings(tables[0], index.postings, index.vectors, index.lines, 4.0, 9, extra=extra, block_rows=0)
    assert by_query(many) == by_query(found)


def test_half_written_and_damaged_indexes_are_refused(spark, saved, tables, tmp_path):  # noqa: F811
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        published.load_hashed(spark, path)
    spark.range(5).write.parquet(f"{path}/v-unfinished/postings")  # a save that never came to its manifest
    with pytest.raises(FileNotFoundError):
        published.load_hashed(spark, path)
    with pytest.raises(ValueError, match="kind"):
        published.load_codes(spark, saved)
    published.publish(spark, path, "x", "l2", 3, {"t": spark.range(10), "u": spark.range(3)})
    (line,) = [json.loads(x) for f in Path(path).glob("manifests/*.json") for x in f.read_text().splitlines()]
    spark.range(9).write.mode("overwrite").parquet(f"{path}/{line['folder']}/t")
    with pytest.raises(ValueError, match="damaged"):
        published.load(spark, path, "x")


def test_the_latest_version_is_read(spark, tmp_path):
    path = str(tmp_path)
    for n in (3, 5, 4):
        published.publish(spark, path, "x", "ip", 7, {"t": spark.range(n)})
    found, metric, dimension = published.load(spark, path, "x")
    assert (found["t"].count(), metric, dimension) == (4, "ip", 7)


def test_codes_come_back(spark, tables, tmp_path):  # noqa: F811
    codebook = pq.train_codebook(tables[1], PqOptions(subspaces=4, bits=4, iterations=3))
    coded = pq.encode_vectors(tables[1], codebook)
    published.save_codes(coded, codebook, str(tmp_path))
    again, book = published.load_codes(spark, str(tmp_path))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(again) == rows(coded) and rows(book) == rows(codebook)


# Training


def lloyd(rows, first, steps):
    centres = first.astype(np.float32)
    for _ in range(steps):
        d = ((rows[:, None].astype(np.float64) - centres[None].astype(np.float64)) ** 2).sum(axis=2)
        nearest = d.argmin(axis=1)
        for c in range(len(centres)):
            mine = rows[nearest == c]
            if len(mine):
                total = np.floor(mine.astype(np.float64) * kmeans.STEPS_PER_UNIT + 0.5).astype(np.int64).sum(axis=0)
                centres[c] = (total / kmeans.STEPS_PER_UNIT / len(mine)).astype(np.float32)
    return centres


@pytest.mark.parametrize("parts", [1, 4])
def test_steps_are_those_of_lloyd(tables, data, parts):  # noqa: F811
    first = kmeans._first_centres(tables[1], 6, 42, False)
    got = kmeans.train(tables[1], 6, 3, 42, parts)
    for book, rows, start in zip(got, np.split(data[0], parts, axis=1), np.split(first, parts, axis=1)):
        assert (book == lloyd(rows, start, 3)).all()


def test_training_does_not_depend_on_partitions(tables):  # noqa: F811
    a, b = (kmeans.train(tables[1].repartition(n), 5, 4, 7, 2) for n in (1, 6))
    assert all((x == y).all() for x, y in zip(a, b))


def test_fewer_vectors_than_centres(tables):  # noqa: F811
    (centres,) = kmeans.train(tables[1].where("product_id < 3"), 9, 2, 1)
    assert centres.shape == (3, 16)
    with pytest.raises(ValueError):
        kmeans.train(tables[1].where("product_id < 0"), 9, 2, 1)


def test_directions_have_unit_length(tables):  # noqa: F811
    (centres,) = kmeans.train(tables[1].withColumn("embedding", F.transform("embedding", lambda x: x * 7)), 4, 1, 1, unit=True)
    assert (np.linalg.norm(centres, axis=1) <= 1 + 1e-4).all()
