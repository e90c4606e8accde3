"""The cleaning job: duplicates, missing values, text, numbers, statistics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.prices import parse_price
from shelfmark.operators.cleaning import (
    clean_columns,
    drop_missing,
    fill_defaults,
    fill_with,
    impute_price,
    is_valid,
    keep_first,
    known_columns,
    numeric_price,
)
from shelfmark.operators.order_statistics import median_of
from shelfmark.operators.textprep import with_embedding_text
from shelfmark.options import REQUIRED_COLUMNS, CleaningOptions, EmbeddingTextOptions


def first_copies(df: DataFrame, order: str) -> DataFrame:
    """The rows left by removing repeated asins, then repeated titles.

    Returns a narrow table: ``order``, whether all critical columns are filled,
    and the parsed price. Titles are compared by a 128-bit digest, so the two
    shuffles carry a few dozen bytes per row instead of the whole row.
    """
    critical = known_columns(df, REQUIRED_COLUMNS)
    complete = F.lit(True)
    for name in critical:
        complete = complete & F.col(name).isNotNull()
    columns = [F.col(order), complete.alias("_complete")]
    if "price" in df.columns:
        columns.append(parse_price(F.col("price")).alias("_price"))
    if "asin" in df.columns:
        columns.append(F.col("asin").alias("_asin"))
    if "title" in df.columns:
        columns.append(F.unhex(F.md5("title")).alias("_title"))
    narrow = df.select(*columns)
    return keep_first(keep_first(narrow, "_asin", order).drop("_asin"), "_title", order).drop(
        "_title"
    )


def clean(df: DataFrame, order: str, options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """Clean a raw catalog. ``order`` is a unique column giving the row order.

    Duplicates go before missing values: a row without asin can displace a
    complete row of the same title and then be dropped itself.
    """
    if options.remove_duplicates and options.handle_missing:
        kept = first_copies(df, order).where("_complete").drop("_complete")
        joined = fill_defaults(df.join(kept, order))
        if "price" in df.columns:
            joined = fill_with(joined, "_price", median_of(kept, "_price")).withColumn(
                "price", F.col("_price")
            )
        df = joined.select(*df.columns)
    elif options.remove_duplicates:
        df = df.join(first_copies(df, order).select(order), order, "left_semi")
    elif options.handle_missing:
        df = impute_price(fill_defaults(drop_missing(df)))
    df = clean_columns(
        df, options.columns_to_clean, options.normalize_text, options.remove_special_chars
    )
    return numeric_price(df)


def cleaning_stats(
    df: DataFrame, order: str, options: CleaningOptions = CleaningOptions()
) -> DataFrame:
    """One row: how many rows each step of ``clean`` removes."""
    rows = F.count(F.lit(1))
    staged = first_copies(df, order) if options.remove_duplicates else _unreduced(df)
    final = F.sum(F.col("_complete").cast("bigint")) if options.handle_missing else rows
    counted = staged.agg(
        rows.alias("unique_rows"), F.coalesce(final, F.lit(0).cast("bigint")).alias("final_rows")
    ).withColumn("original_rows", df.agg(rows).scalar())
    return counted.select(
        "original_rows",
        F.lit(len(df.columns)).alias("original_columns"),
        (F.col("original_rows") - F.col("unique_rows")).alias("duplicate_rows_removed"),
        (F.col("unique_rows") - F.col("final_rows")).alias("missing_rows_removed"),
        F.lit(",".join(options.columns_to_clean)).alias("columns_cleaned"),
        "final_rows",
        F.lit(len(df.columns)).alias("final_columns"),
        (F.col("original_rows") - F.col("final_rows")).alias("rows_removed"),
        F.when(
            F.col("original_rows") > 0,
            F.round(F.col("final_rows") / F.col("original_rows") * 100, 2),
        )
        .otherwise(0.0)
        .alias("percent_data_retained"),
    )


def _unreduced(df: DataFrame) -> DataFrame:
    complete = F.lit(True)
    for name in known_columns(df, REQUIRED_COLUMNS):
        complete = complete & F.col(name).isNotNull()
    return df.select(complete.alias("_complete"))


def build_catalog(
    raw: DataFrame,
    order: str,
    cleaning: CleaningOptions = CleaningOptions(),
    text: EmbeddingTextOptions = EmbeddingTextOptions(),
) -> DataFrame:
    """Validate, clean and add the text to embed."""
    if not is_valid(raw):
        raise ValueError("the catalog is empty or lacks a required column")
    return with_embedding_text(clean(raw, order, cleaning), text)


def without_step(**switches: bool) -> CleaningOptions:
    return replace(CleaningOptions(), **switches)
