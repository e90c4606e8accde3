"""What a free-text search says about price, brand and rating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import SPACE, squeeze, strip

# The phrases a search may use, and the shapes around them.
UPPER_PHRASES = ("under", "less than", "below", "cheaper than", "at most", "no more than")
LOWER_PHRASES = (
    "over",
    "more than",
    "above",
    "at least",
    "exceeding",
    "min",
    "minimum",
    "starting at",
)
NUMBER = r"(\d+(?:\.\d+)?)"
GAP = f"[{SPACE}]*"

RANGE = rf"\${NUMBER}{GAP}-{GAP}\$?{NUMBER}"
UPPER = rf"(?i)(?:{'|'.join(UPPER_PHRASES)}){GAP}\$?{NUMBER}"
LOWER = rf"(?i)(?:{'|'.join(LOWER_PHRASES)}){GAP}\$?{NUMBER}"
BRAND = rf"brand:?{GAP}([a-zA-Z0-9_{SPACE}]+)"
RATING = rf"{NUMBER}\+?{GAP}stars?"


def first_number(text: Column, pattern: str, group: int = 1) -> Column:
    """The numeric group of the first match, NULL without a match."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).cast("double")


def range_bounds(query: Column) -> tuple[Column, Column]:
    """Bounds of the first ``$A - $B``."""
    return first_number(query, RANGE, 1), first_number(query, RANGE, 2)


def without(query: Column, pattern: str) -> Column:
    return strip(F.regexp_replace(query, pattern, ""))


def upper_bound(query: Column) -> Column:
    """Number after an "under" phrase; a range in the text goes first."""
    return F.when(~query.rlike(RANGE), first_number(query, UPPER))


def lower_bound(query: Column) -> Column:
    """Number after an "over" phrase; a range in the text goes first."""
    return F.when(~query.rlike(RANGE), first_number(query, LOWER))


def price_bounds(query: Column) -> tuple[Column, Column, Column]:
    """(min price, max price, query text without the price phrase).

    A range wins. Otherwise an upper and a lower phrase may both apply; the
    remaining text then loses only the lower phrase.
    """
    low, high = range_bounds(query)
    has_range = query.rlike(RANGE)
    rest = (
        F.when(has_range, without(query, RANGE))
        .when(query.rlike(LOWER), without(query, LOWER))
        .when(query.rlike(UPPER), without(query, UPPER))
        .otherwise(query)
    )
    return (
        F.when(has_range, low).otherwise(first_number(query, LOWER)),
        F.when(has_range, high).otherwise(first_number(query, UPPER)),
        rest,
    )


def normalize_query(query: Column) -> Column:
    """Lower case, single blanks, no price range."""
    plain = squeeze(F.lower(query))
    return F.when(plain.rlike(RANGE), without(plain, RANGE)).otherwise(plain)


def brand_hint(query: Column) -> Column:
    """Text after the word "brand"; may be empty, NULL without the word."""
    lowered = F.lower(query)
    return F.when(lowered.rlike(BRAND), strip(F.regexp_extract(lowered, BRAND, 1)))


def rating_hint(query: Column) -> Column:
    """Number before "star" or "stars"."""
    return first_number(F.lower(query), RATING)
