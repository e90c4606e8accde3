"""Display forms of result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts shown to a user.
MISSING = "N/A"
STAR = "★"
HALF = "½"
UNKNOWN_TITLE = "Unknown Product"


def fixed(number: Column, places: int) -> Column:
    """``number`` with ``places`` decimals, rounded from its exact binary value.

    Only a true half goes to the even digit. A short expression: one that
    computes the digits is so long that the JVM leaves it uncompiled.
    """
    number = number.cast("double")
    size = F.abs(number)
    text = F.concat(
        F.when(number < 0, F.lit("-")).otherwise(F.lit("")),
        F.translate(F.format_number(size, places), ",", ""),
    )
    return F.when(size < 1e12, text).otherwise(F.format_string(f"%.{places}f", number))


def dollars(price: Column) -> Column:
    """``$12.50``, NULL without a price."""
    return F.when(price.isNotNull(), F.concat(F.lit("$"), fixed(price, 2)))


def valid_price(price: Column, least: float) -> Column:
    return F.when(price >= least, price)


def price_label(price: Column, least: float) -> Column:
    return F.coalesce(dollars(valid_price(price, least)), F.lit(MISSING))


def star_icons(stars: Column) -> Column:
    """One star per whole point and a half sign from .5 on."""
    whole = F.repeat(F.lit(STAR), F.floor(stars).cast("int"))
    half = F.when(F.pmod(stars, F.lit(1.0)) >= 0.5, F.lit(HALF)).otherwise(F.lit(""))
    return F.coalesce(F.concat(whole, half), F.lit(MISSING))


def star_label(stars: Column) -> Column:
    return F.when(stars.isNotNull(), F.concat(fixed(stars, 1), F.lit(f" {STAR}")))


def review_label(reviews: Column) -> Column:
    return F.coalesce(
        F.concat(F.format_number(reviews.cast("bigint"), 0), F.lit(" reviews")),
        F.lit(MISSING),
    )


def result_line(
    rank: Column,
    title: Column,
    price: Column | None = None,
    stars: Column | None = None,
    reviews: Column | None = None,
) -> Column:
    """``1. title - $9.50 - 4.5 ★ (12 reviews)``; absent parts are left out."""
    parts = [rank.cast("string"), F.lit(". "), F.coalesce(title, F.lit(UNKNOWN_TITLE))]
    for lead, label in ((" - ", price), (" - ", stars)):
        if label is not None:
            parts.append(F.coalesce(F.concat(F.lit(lead), label), F.lit("")))
    if reviews is not None:
        counted = reviews.cast("bigint").cast("string")
        parts.append(F.coalesce(F.concat(F.lit(" ("), counted, F.lit(" reviews)")), F.lit("")))
    return F.concat(*parts)
