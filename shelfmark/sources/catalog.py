"""Catalog files: CSV in and out, several files, a backup file, reuse."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.prices import without_nan
from shelfmark.sources import csv_splits
from shelfmark.sources.workspace import new_folder

# The texts that mean "missing" in a catalog file.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
ROW_ORDER = "row_order"

# Types of a catalog's known columns; other columns stay text. The price is
# text, because it may carry a currency sign.
KNOWN_TYPES = {
    "stars": "double",
    "reviews": "bigint",
    "category_id": "bigint",
    "isBestSeller": "boolean",
}


def has_line_breaks(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether a quoted value runs over a line's end; the files are looked through in splits."""
    return csv_splits.has_breaks(csv_splits.look_through(spark, path))


def _read_text(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool | None
) -> DataFrame:
    """The columns as text, beside the place of each row: file, start of its split, number inside it."""
    if multi_line is None:
        splits = csv_splits.look_through(spark, path)
        if csv_splits.has_breaks(splits):
            found = csv_splits.parsed(csv_splits.records(spark, path, splits), schema, CSV_OPTIONS)
            fields = [F.col("fields").getField(f.name).alias(f.name) for f in schema]
            return found.select(F.col("place").alias(ROW_ORDER), *fields)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).options(**CSV_OPTIONS, multiLine=bool(multi_line)).csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(place.alias(ROW_ORDER), *[F.col(f"`{f.name}`") for f in schema])


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read catalog CSV files with a declared schema.

    Everything is read as text first, missing-value texts become NULL, then the
    columns are cast. A malformed row raises. The files are looked through
    first, and those in which values hold line breaks are read in splits whose
    records are put together (``sources.csv_splits``). ``multi_line`` saves the
    look: False says that there are no such values; with True each file is read
    by one task.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = _read_text(spark, path, wanted, multi_line)
    return raw.select(*[_typed(field) for field in wanted])


def _typed(field: T.StructField):
    text = F.col(field.name)
    present = F.when(~text.isin(*MISSING_TEXTS), text)
    kind = field.dataType.typeName()
    if kind == "string":
        return present.alias(field.name)
    if kind == "long":
        return _whole(present).alias(field.name)
    if kind == "double":
        return without_nan(present.cast("double")).alias(field.name)
    return present.cast(field.dataType).alias(field.name)


def _whole(text: Column) -> Column:
    """An exact whole number, which may be written as 12.0; any other text raises."""
    exact, decimal = text.try_cast("bigint"), text.try_cast("decimal(38,10)")
    wrong = F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast("bigint")
    return (
        F.when(text.isNull(), F.lit(None).cast("bigint"))
        .when(exact.isNotNull() & ~text.contains("."), exact)
        .when(decimal == F.floor(decimal), F.floor(decimal).try_cast("bigint"))
        .otherwise(wrong)
    )


def header_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of a CSV file with the types this package knows for them."""
    names = spark.read.options(**CSV_OPTIONS).csv(path).columns
    return T.StructType.fromDDL(
        ", ".join(f"`{name}` {KNOWN_TYPES.get(name, 'string')}" for name in names)
    )


def read_catalog(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read a catalog CSV whose columns are taken from its header."""
    return read_csv(spark, path, header_schema(spark, path), multi_line)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header; NULL is written as nothing."""
    df.write.mode("overwrite").options(
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables with the same columns."""
    return reduce(DataFrame.unionByName, parts)


def read_with_backup(
    spark: SparkSession, path: str, backup: str | None = None, check_all: bool = True
) -> DataFrame:
    """Read a catalog; when that fails, the backup.

    Spark reads late, so the file is parsed here to see a failure now. All of
    it is written down as it is parsed and reread from there, so that no file
    is parsed twice; with ``check_all=False`` only its first row is looked at.
    """
    try:
        df = read_catalog(spark, path)
        if not check_all:
            df.isEmpty()
            return df
        folder = new_folder(spark, "checked-catalog")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)
    except (PySparkException, Py4JJavaError):
        if backup is None:
            raise
        return read_catalog(spark, backup)


def land(
    spark: SparkSession, source: str, target: str, multi_line: bool | None = None
) -> DataFrame:
    """Copy a catalog CSV to Parquet and give every row its place in the input.

    ``row_order`` (file, start of the split, number inside it) sorts rows as
    they stand in the files. It is written down, because a second scan of the
    text need not number rows alike.
    """
    schema = header_schema(spark, source)
    raw = _read_text(spark, source, schema, multi_line)
    raw.select(ROW_ORDER, *[_typed(field) for field in schema]).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def keep_loaded(df: DataFrame) -> DataFrame:
    """Keep a table for several searches; ``df.unpersist()`` lets it go."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
