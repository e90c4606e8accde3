"""Orders of search candidates, one window per search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.knn import ITEM, QUERY
from shelfmark.options import HybridWeights

METHODS = ("distance", "reviews", "price", "hybrid")


def _share(value: str) -> Column:
    """Place of ``value`` between its least and greatest per search, 0 to 1."""
    search = Window.partitionBy(QUERY)
    low, high = F.min(value).over(search), F.max(value).over(search)
    return F.when(high > low, (F.col(value) - low) / (high - low))


def _is_spread(value: str) -> Column:
    search = Window.partitionBy(QUERY)
    return F.max(value).over(search) > F.min(value).over(search)


def with_hybrid_score(df: DataFrame, weights: HybridWeights = HybridWeights()) -> DataFrame:
    """Add relevance, rating, price and weighted score over a search's candidates.

    Equal ratings or prices score 1 for all. When all distances are zero there
    is no relevance, and the score is NULL.
    """
    farthest = F.max("distance").over(Window.partitionBy(QUERY))
    return (
        df.withColumn("relevance_score", 1 - F.try_divide(F.col("distance"), farthest))
        .withColumn("rating_score", F.when(_is_spread("stars"), _share("stars")).otherwise(1.0))
        .withColumn("price_score", F.when(_is_spread("price"), 1 - _share("price")).otherwise(1.0))
        .withColumn(
            "hybrid_score",
            weights.relevance * F.col("relevance_score")
            + weights.rating * F.col("rating_score")
            + weights.price * F.col("price_score"),
        )
    )


def ordering(df: DataFrame, method: str) -> list[Column]:
    """Sort columns of a method; by distance when its columns are missing."""
    by_distance = [F.asc("distance"), F.asc(ITEM)]
    if method == "reviews" and "reviews" in df.columns:
        return [F.desc_nulls_last("reviews"), *by_distance]
    if method == "price" and "price" in df.columns:
        return [F.asc_nulls_last("price"), *by_distance]
    if method == "hybrid" and "hybrid_score" in df.columns:
        return [F.desc_nulls_last("hybrid_score"), *by_distance]
    if method == "category":
        return [F.desc("category_score"), *by_distance]
    if method not in METHODS:
        raise ValueError(f"unknown ranking method: {method}")
    return by_distance


def rank(
    df: DataFrame,
    method: str = "distance",
    top: int | None = None,
    weights: HybridWeights = HybridWeights(),
    into: str = "rank",
) -> DataFrame:
    """Number every search's candidates from 1, and keep the first ``top``."""
    if method == "hybrid" and {"stars", "price"} <= set(df.columns):
        df = with_hybrid_score(df, weights)
    place = F.row_number().over(Window.partitionBy(QUERY).orderBy(*ordering(df, method)))
    ranked = df.withColumn(into, place)
    return ranked if top is None else ranked.where(F.col(into) <= top)
