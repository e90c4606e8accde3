"""The columns a search returns, and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import formatting as fmt
from shelfmark.operators.filters import displayable
from shelfmark.operators.knn import ITEM, QUERY
from shelfmark.options import MIN_VALID_PRICE


def _column(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or NULL when the table has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def link(df: DataFrame) -> Column:
    name = "productURL" if "productURL" in df.columns else "url"
    return _column(df, name, "string")


def image(df: DataFrame) -> Column:
    return _column(df, "imgUrl", "string")


def result_columns(df: DataFrame, least: float = MIN_VALID_PRICE) -> list[Column]:
    """Display columns of the storefront search."""
    price, stars = _column(df, "price", "double"), _column(df, "stars", "double")
    reviews = _column(df, "reviews", "bigint")
    return [
        F.coalesce(_column(df, "title", "string"), F.lit(fmt.UNKNOWN_TITLE)).alias("title"),
        fmt.valid_price(price, least).alias("price"),
        fmt.price_label(price, least).alias("price_formatted"),
        stars.alias("rating"),
        fmt.star_icons(stars).alias("rating_stars"),
        reviews.cast("bigint").alias("reviews"),
        fmt.review_label(reviews).alias("reviews_formatted"),
        link(df).alias("url"),
        image(df).alias("image_url"),
        F.coalesce(_column(df, "isBestSeller", "boolean").cast("boolean"), F.lit(False)).alias(
            "is_bestseller"
        ),
        F.col("distance").alias("relevance_score"),
        _column(df, "category_id", "bigint").alias("category"),
    ]


def result_rows(df: DataFrame, least: float = MIN_VALID_PRICE, *carry: str) -> DataFrame:
    return df.select(QUERY, ITEM, *result_columns(df, least), *carry)


def with_labels(df: DataFrame) -> DataFrame:
    """Add the price and star labels of the re-ranked search."""
    if "price" in df.columns:
        df = df.withColumn("price_formatted", fmt.dollars(F.col("price")))
    if "stars" in df.columns:
        df = df.withColumn("stars_formatted", fmt.star_label(F.col("stars")))
    return df


def result_lines(df: DataFrame, include_details: bool = True) -> DataFrame:
    """One line of text per ranked result; each part shows if its column exists."""
    parts: dict[str, Column] = {}
    if include_details:
        if "price" in df.columns:
            parts["price"] = fmt.dollars(F.col("price"))
        if "stars" in df.columns:
            parts["stars"] = fmt.star_label(F.col("stars"))
        if "reviews" in df.columns:
            parts["reviews"] = F.col("reviews")
    title = _column(df, "title", "string")
    return df.select(QUERY, "rank", fmt.result_line(F.col("rank"), title, **parts).alias("line"))


def search_summary(
    searches: DataFrame,
    results: DataFrame,
    low: str = "min_price",
    high: str = "max_price",
    least: float = MIN_VALID_PRICE,
) -> DataFrame:
    """Per search the number of results to show and the price bounds used."""
    shown = displayable(results, least).groupBy(QUERY).agg(F.count(F.lit(1)).alias("_shown"))
    count = F.coalesce(F.col("_shown"), F.lit(0).cast("bigint"))
    return searches.join(shown, QUERY, "left").select(
        QUERY,
        "query_text",
        count.alias("n_results"),
        F.concat(fmt.dollars(F.col(low)), F.lit(" - "), fmt.dollars(F.col(high))).alias(
            "price_range"
        ),
        (count == 0).alias("no_match"),
    )
