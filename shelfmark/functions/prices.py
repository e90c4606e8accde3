"""Price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is cut out of a price and what a plain number looks like.
PRICE_MARKS = "[$,]"
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_price(price: Column) -> Column:
    """A price text as double; anything that is no finite number is NULL.

    The pattern keeps out the forms Spark's cast would accept on its own
    (``1.0d``, ``nan``, ``infinity``).
    """
    bare = F.regexp_replace(price.cast("string"), PRICE_MARKS, "")
    return F.when(bare.rlike(PLAIN_NUMBER), F.trim(bare).try_cast("double"))


def without_nan(number: Column) -> Column:
    """NaN becomes NULL, so that only one kind of missing value exists."""
    return F.when(~F.isnan(number), number)
