"""Validation, order-aware de-duplication, missing values and text cleaning.

Every operator takes the columns it works on by name and is skipped when the
table does not have them, so the same job serves differently shaped catalogs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.prices import parse_price
from shelfmark.functions.text import drop_special
from shelfmark.operators.order_statistics import median_of
from shelfmark.options import REQUIRED_COLUMNS


def validation_report(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row: which required columns are missing, and whether any row exists."""
    missing = [name for name in required if name not in df.columns]
    return df.limit(1).agg(
        F.lit(",".join(missing)).alias("missing_columns"),
        (F.count(F.lit(1)) == 0).alias("is_empty"),
        (F.lit(not missing) & (F.count(F.lit(1)) > 0)).alias("is_valid"),
    )


def is_valid(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> bool:
    return all(name in df.columns for name in required) and not df.isEmpty()


def known_columns(df: DataFrame, requested: Sequence[str]) -> list[str]:
    """The requested columns the table really has."""
    return [name for name in requested if name in df.columns]


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per ``key`` in ``order``; rows without a key are one group.

    The rank filter becomes a WindowGroupLimit on both sides of the shuffle:
    each task sends at most one row per key, so a key that holds a large part
    of the table does not end up in one task.
    """
    if key not in df.columns:
        return df
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def drop_missing(df: DataFrame, critical: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    present = known_columns(df, critical)
    return df.na.drop(subset=present) if present else df


def fill_defaults(df: DataFrame, columns: Sequence[str] = ("reviews", "stars")) -> DataFrame:
    return df.na.fill({name: 0 for name in known_columns(df, columns)})


def impute_price(df: DataFrame, column: str = "price") -> DataFrame:
    """Parse prices; texts without a number get the exact median of the rest."""
    if column not in df.columns:
        return df
    priced = df.withColumn(column, parse_price(F.col(column)))
    return fill_with(priced, column, median_of(priced, column))


def fill_with(df: DataFrame, column: str, one_value: DataFrame) -> DataFrame:
    """Fill NULLs from a one-row table, read as a scalar subquery."""
    return df.withColumn(column, F.coalesce(F.col(column), one_value.scalar()))


def cleaned_text(text: Column, normalize: bool = True, remove_special: bool = True) -> Column:
    if normalize:
        text = F.lower(text)
    if remove_special:
        text = drop_special(text)
    return text


def clean_columns(
    df: DataFrame,
    columns: Sequence[str] = ("title",),
    normalize: bool = True,
    remove_special: bool = True,
) -> DataFrame:
    for name in known_columns(df, columns):
        df = df.withColumn(name, cleaned_text(F.col(name), normalize, remove_special))
    return df


def numeric_price(df: DataFrame, column: str = "price") -> DataFrame:
    """Parse prices that are still text, without filling gaps."""
    if column not in df.columns or df.schema[column].dataType.typeName() != "string":
        return df
    return df.withColumn(column, parse_price(F.col(column)))
