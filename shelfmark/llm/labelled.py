"""A bounded, seeded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import id_crc, stored, text_of

MOST_PER_CLASS = 20_000  # labelled rows of a class that a classifier is fitted on, at most


def held_out(modulus: int, remainder: int, key: str = "doc_id"):
    """Whether a row belongs to the fold that is never learned from; false for a null id."""
    return F.coalesce(F.pmod(id_crc(key), F.lit(modulus)) == remainder, F.lit(False))


def sample_labels(
    labels: DataFrame, label: str, modulus: int, remainder: int, most: int = MOST_PER_CLASS, seed: int = 4
) -> tuple[DataFrame, dict[int, float]]:
    """doc_id and label of at most about `most` rows a class, and each class's weight (labelled rows per sampled one).

    A document with several labels counts once, with the largest. The sample is those whose seeded hash lies below the
    class's share, so that it is the same in every run.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(modulus, remainder))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    number = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {c: min(1.0, most / number[c]) for c in number}
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 2) / F.lit(float(1 << 62))
    limit = F.lit(0.0)
    for c, x in share.items():
        limit = F.when(F.col("label") == c, F.lit(x)).otherwise(limit)
    return known.filter(place < limit).select("doc_id", "label"), {c: 1 / x for c, x in share.items()}


def sampled_texts(docs: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """doc_id, text and label of the sampled documents, stored; copies of a text count once, under their least id.

    The sample is bounded, so its ids go to all tasks.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"))
    return stored(found.select("doc_id", "text", "label"), name)
