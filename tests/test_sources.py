import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import plan_of
from shelfmark.operators import blocks, ivf
from shelfmark.sources import catalog as files
from shelfmark.sources import csv_splits, indexes
from shelfmark.sources.workspace import new_folder, shared_folder

TEXT = (
    "asin,title,price,stars,reviews,isBestSeller,category_id\n"
    'a,"He said ""hi"", ok","$1,000.50",4.5,10,True,3\n'
    'b,"two\nlines",N/A,NaN,12.0,False,\n'
    "c,nan,5,,,,7\n"
)
SCHEMA = (
    "asin string, title string, price string, stars double, reviews bigint,"
    " isBestSeller boolean, category_id bigint"
)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(TEXT)
    return str(path)


EXPECTED = [
    ("a", 'He said "hi", ok', "$1,000.50", 4.5, 10, True, 3),
    ("b", "two\nlines", None, None, 12, False, None),
    ("c", None, "5", None, None, None, 7),
]


def test_csv_quotes_breaks_and_missing_values(spark, csv):
    for df in (
        files.read_csv(spark, csv, SCHEMA, multi_line=True),
        files.read_catalog(spark, csv, multi_line=True),
    ):
        assert [tuple(row) for row in df.orderBy("asin").collect()] == EXPECTED


def test_csv_round_trip(spark, csv, tmp_path):
    df = files.read_csv(spark, csv, SCHEMA, multi_line=True)
    files.write_csv(df, str(tmp_path / "out"))
    again = files.read_csv(spark, str(tmp_path / "out"), SCHEMA, multi_line=True)
    assert [tuple(row) for row in again.orderBy("asin").collect()] == EXPECTED


def test_malformed_and_missing_files_raise(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("asin,title,price\na,b,1\na,b,1,extra,more\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_catalog(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_with_backup(spark, str(tmp_path / "none.csv"))


def test_backup(spark, csv, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("asin,title,price\nz,t,1\n")
    assert files.read_with_backup(spark, str(good), csv).first()["asin"] == "z"
    absent = str(tmp_path / "absent.csv")
    assert files.read_with_backup(spark, absent, str(good)).first()["asin"] == "z"
    bad = tmp_path / "bad.csv"
    bad.write_text("asin,title,price\na,b,1\na,b,1,extra,more\n")
    assert files.read_with_backup(spark, str(bad), str(good)).first()["asin"] == "z"


def test_landing_keeps_file_order(spark, tmp_path):
    lines = [f"k{at % 700},t{at},{at}" for at in range(5000)]
    (tmp_path / "big.csv").write_text("asin,title,price\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        landed = files.land(spark, str(tmp_path / "big.csv"), str(tmp_path / "landed"))
        assert spark.read.parquet(str(tmp_path / "landed")).count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = landed.orderBy(files.ROW_ORDER).collect()
    assert [int(row["price"]) for row in rows] == list(range(5000))


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def broken_lines(rows, seed):
    """CSV text and its rows: values with breaks, quotes, commas, a few longer than several splits."""
    draw = random.Random(seed)
    kept = []
    for at in range(rows):
        words = [draw.choice(["x", "two\nlines", 'say ""so""', "a,b", "\n\n", "\r\nend", "é☕"]) for _ in range(draw.randrange(6))]
        title = " ".join(words) if at % 97 else "long\n" * 900
        kept.append((str(at), title.replace('""', '"') or None, str(at * 3)))
    quoted = ['"' + (t or "").replace('"', '""') + '"' if t else "" for _, t, _ in kept]
    return [f"{a},{q},{p}" for (a, _, p), q in zip(kept, quoted)], kept


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("limit", [blocks.SIDE_ROWS, 1])
def test_values_with_breaks_are_read_in_splits(spark, tmp_path, small_splits, monkeypatch, end, limit):
    monkeypatch.setattr(blocks, "SIDE_ROWS", limit)  # with 1, splits are joined by shuffle
    expected = []
    (tmp_path / "in").mkdir()
    for name in range(2):
        lines, kept = broken_lines(400, name)
        head = '"asin",title,price'
        (tmp_path / "in" / f"{name}.csv").write_bytes(end.join([head, *lines, "", ""]).encode())
        expected += kept
    source = str(tmp_path / "in")
    splits = csv_splits.look_through(spark, source)
    assert splits.count() > 20 and not splits.where("begins_inside and ends_inside").isEmpty()
    ours = files.read_catalog(spark, source)
    assert ours.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted(expected, key=repr)
    landed = files.land(spark, source, str(tmp_path / "landed")).orderBy(files.ROW_ORDER)
    assert [tuple(row) for row in landed.drop(files.ROW_ORDER).collect()] == expected
    if end == "\n":  # Spark's own reader turns CR LF inside values into LF where lines end in CR LF
        at_once = files.read_catalog(spark, source, multi_line=True)
        assert sorted(map(tuple, at_once.collect()), key=repr) == sorted(expected, key=repr)


def test_split_files_with_wrong_records_raise(spark, tmp_path, small_splits):
    lines, _ = broken_lines(200, 1)
    for name, wrong in (("more", "1,2,3,4"), ("fewer", "1,2"), ("open", '1,"never closed,3')):
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join(["asin,title,price", *lines, wrong, *([] if name == "open" else lines)]) + "\n")
        with pytest.raises((PySparkException, Py4JJavaError)):
            files.read_catalog(spark, str(path)).collect()


def test_breaks_in_files_without_rows(spark, tmp_path):
    (tmp_path / "head.csv").write_text('"as\nin",title\n')
    assert files.read_csv(spark, str(tmp_path / "head.csv"), "asin string, title string").collect() == []
    (tmp_path / "empty.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "empty.csv"), "asin string, title string").collect() == []


def test_union_of_parts(spark):
    df = spark.range(10)
    parts = [df.where("id < 3"), df.where("id >= 3 and id < 5"), df.where("id >= 5")]
    assert sorted(row["id"] for row in files.union_all(parts).collect()) == list(range(10))


def test_loaded_tables_are_kept_until_released(spark):
    df = files.keep_loaded(spark.range(10))
    assert df.count() == 10 and df.storageLevel == StorageLevel.MEMORY_AND_DISK
    df.unpersist()
    assert df.storageLevel == StorageLevel.NONE


def test_shared_folder_is_the_session_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


@pytest.fixture
def vectors(spark):
    # a third of all vectors in one cell
    return spark.range(300).select(
        F.col("id").alias("product_id"),
        F.array(*[(F.hash("id", F.lit(at)) % 100 / 100).cast("float") for at in range(4)]).alias(
            "embedding"
        ),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).cast("bigint").alias("cell"),
    )


def test_vectors_round_trip(spark, vectors, tmp_path):
    indexes.write_vectors(vectors, str(tmp_path / "v"))
    again = indexes.read_vectors(spark, str(tmp_path / "v"))
    assert again.exceptAll(vectors.select("product_id", "embedding")).isEmpty()
    assert again.count() == 300


def test_packed_vectors(spark, vectors):
    holes = vectors.withColumn("embedding", F.when(F.col("product_id") != 7, F.col("embedding")))
    packed = blocks.pack(holes, "embedding")
    assert packed.schema["embedding"].dataType.typeName() == "binary"
    assert blocks.pack(packed, "embedding") is packed
    assert blocks.unpack(packed, "embedding").exceptAll(holes).isEmpty()
    rows = packed.where("embedding is not null").select("embedding").toArrow()
    matrix = blocks.matrix_of(rows.column("embedding").slice(5, 9))
    assert matrix.shape == (9, 4)
    assert indexes.index_metadata(packed, "Flat").first()["dimension"] == 4


def test_cells_round_trip_and_pruning(spark, vectors, tmp_path):
    centroids = ivf.label_centroids(vectors, "cell")
    sizes = vectors.groupBy("cell").agg(F.count("*").alias("rows"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexes.write_cells(vectors, centroids, str(tmp_path / "i"), sizes, rows_per_file=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored, centres = indexes.read_cells(spark, str(tmp_path / "i"))
    lists = blocks.unpack(stored, "embedding").withColumn("cell", F.col("cell").cast("bigint"))
    assert lists.select(vectors.columns).exceptAll(vectors).isEmpty()
    assert lists.count() == 300
    assert centres.count() == 5
    assert len(list((tmp_path / "i" / "cells" / "cell=0").glob("*.parquet"))) > 1
    queries = vectors.where("product_id = 1").select(F.col("product_id").alias("query_id"), "embedding")
    plan = plan_of(ivf.search_cells(queries, stored, centres, 3, probes=2))
    assert "PartitionFilters: [cell" in plan and "cell#" in plan.split("PartitionFilters: [")[1]


def test_metadata_round_trip(spark, vectors, tmp_path):
    described = indexes.index_metadata(vectors, "PQ", "ip", pq_m=8)
    indexes.write_metadata(described, str(tmp_path / "m"))
    read = indexes.read_metadata(spark, str(tmp_path / "m"))
    assert tuple(read.first()) == ("PQ", 4, 300, "ip", None, None, 8)
    assert indexes.stored_probes(read) == 10
    probed = indexes.index_metadata(vectors, "IVF", nprobe=4)
    assert indexes.stored_probes(probed) == 4


def test_sizes_are_scaled_up(spark):
    sample = spark.createDataFrame([(0,), (0,), (1,)], "cell bigint")
    sizes = indexes.estimated_sizes(sample, 3, 300).orderBy("cell").collect()
    assert [row["rows"] for row in sizes] == [200, 100]


def test_whole_numbers_are_exact_and_line_breaks_are_found(spark, tmp_path):
    path = str(tmp_path / "exact.csv")
    with open(path, "w") as file:
        file.write('product_id,title\n9007199254740993,"a ""q"" x"\n5.0,"two\nlines"\n1e3,\n')
    schema = "product_id bigint, title string"
    rows = files.read_csv(spark, path, schema).collect()
    assert sorted(tuple(r) for r in rows) == [(5, "two\nlines"), (1000, None), (9007199254740993, 'a "q" x')]
    assert files.has_line_breaks(spark, path)
    with open(path, "w") as file:
        file.write("product_id,title\n12.7,x\n")
    assert not files.has_line_breaks(spark, path)
    with pytest.raises((PySparkException, Py4JJavaError), match="not a whole number"):
        files.read_csv(spark, path, schema).collect()
