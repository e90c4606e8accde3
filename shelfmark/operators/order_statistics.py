"""Exact order statistics and samples that never sort a table in one task.

Both work in two steps. A histogram with a bounded number of bins finds the
bin that holds the wanted rank; only the rows of that bin are then ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_UNIT = 4096
HASH_DIGITS = 4


def median_of(df: DataFrame, column: str) -> DataFrame:
    """One row with the exact median of ``column``, the mean of the middle two.

    Equal values are merged first, so a value that fills a third of the table
    is one row afterwards. Bins are a monotone function of the value: at most
    some millions exist for any double, so their running total is bounded.
    """
    value = F.col(column).cast("double")
    values = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    scale = F.floor(F.log1p(F.abs("value")) * BINS_PER_UNIT)
    binned = values.withColumn("bin", F.when(F.col("value") < 0, -scale - 1).otherwise(scale))
    # the join below would add this filter to one branch only, and part the two
    # branches from their common shuffle
    binned = binned.where("bin is not null")

    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = (
        binned.groupBy("bin")
        .agg(F.sum("n").alias("in_bin"))
        .withColumn("before", F.coalesce(F.sum("in_bin").over(running), F.lit(0)))
        .withColumn("total", F.sum("in_bin").over(everything))
        .withColumn("low", F.floor((F.col("total") - 1) / 2))
        .withColumn("high", F.floor(F.col("total") / 2))
        .where("before <= high and low < before + in_bin")
        .select("bin", "before", "low", "high")
    )
    inside = Window.partitionBy("bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        binned.join(F.broadcast(bins), "bin")  # one or two bins
        .withColumn("upto", F.col("before") + F.sum("n").over(inside))
        .withColumn("start", F.col("upto") - F.col("n"))
    )

    def at(rank: str):
        hit = (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
        return F.max(F.when(hit, F.col("value")))

    return ranked.agg(((at("low") + at("high")) / 2).alias("median"))


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows (all, if fewer), by the order of a seeded hash.

    The choice depends on key and seed only, not on the layout of the table.
    ``key`` must be unique. Bins are the leading hex digits of the hash, so
    65,536 at most; only the bin where the sample ends is ordered.
    """
    hashed = df.withColumn(
        "_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ).withColumn("_bin", F.substring("_hash", 1, HASH_DIGITS))
    running = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        hashed.groupBy("_bin")
        .agg(F.count(F.lit(1)).alias("_in_bin"))
        .withColumn("_before", F.coalesce(F.sum("_in_bin").over(running), F.lit(0)))
        .where(F.col("_before") < rows)
        .withColumn("_whole", F.col("_before") + F.col("_in_bin") <= rows)
        .select("_bin", "_before", "_whole")
    )
    chosen = hashed.join(F.broadcast(bins), "_bin")  # at most 65,536 bins
    last = Window.partitionBy("_bin").orderBy("_hash", key)
    return (
        chosen.where("_whole").drop("_before")
        .unionByName(
            chosen.where("not _whole")
            .withColumn("_nth", F.row_number().over(last))
            .where(F.col("_nth") <= rows - F.col("_before"))
            .drop("_nth", "_before")
        )
        .drop("_bin", "_hash", "_whole")
    )
