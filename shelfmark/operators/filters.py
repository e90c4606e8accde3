"""Attribute filters on search candidates.

They run after the candidate cut: a matching product outside the fetched
candidates is not found. A filter is skipped when its column does not exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.options import MIN_VALID_PRICE


def valid_price(df: DataFrame, least: float = MIN_VALID_PRICE) -> DataFrame:
    return df.where(F.col("price") >= least) if "price" in df.columns else df


def price_between(df: DataFrame, low: str = "min_price", high: str = "max_price") -> DataFrame:
    """Price inside the search's bounds, ends included; a missing bound is open."""
    if "price" not in df.columns:
        return df
    above = F.col(low).isNull() | (F.col("price") >= F.col(low))
    below = F.col(high).isNull() | (F.col("price") <= F.col(high))
    return df.where(above & below)


def rating_at_least(
    df: DataFrame, threshold: str = "min_rating", zero_is_off: bool = True
) -> DataFrame:
    if "stars" not in df.columns:
        return df
    asked = F.col(threshold)
    off = asked.isNull() | (asked <= 0) if zero_is_off else asked.isNull()
    return df.where(off | (F.col("stars") >= asked))


def bestsellers(df: DataFrame, flag: str = "bestsellers_only") -> DataFrame:
    if "isBestSeller" not in df.columns:
        return df
    return df.where(~F.coalesce(F.col(flag), F.lit(False)) | F.col("isBestSeller"))


def brand_contains(df: DataFrame, hint: str = "brand_hint") -> DataFrame:
    if "brand" not in df.columns:
        return df
    wanted = F.lower(F.col(hint))
    return df.where(wanted.isNull() | F.lower("brand").contains(wanted))


def displayable(df: DataFrame, least: float = MIN_VALID_PRICE) -> DataFrame:
    """Rows that may be shown: with a price of at least ``least``."""
    return df.where(F.col("price").isNotNull() & (F.col("price") >= least))
