"""Registered queries: each applies one operator to its whole table; SQL where it can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bagminhash,
    fingerprint,
    hard_negatives,
    hmm,
    metric_join,
    mixing,
    packing,
    periodic,
    quality,
    rank_order,
    rans,
    secret_scan,
    toxicity,
)
from shelfmark.llm.common import table


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    own = F.col("quotas")[0]
    return mixed.select("doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"), "taken")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = [secret_scan.count_of(F.col("spans"), rule[0]).alias(f"n_{rule[0]}") for rule in secret_scan.RULES]
    text = secret_scan.label(F.col("spans"))
    return found.select("doc_id", *count, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"))


def op8_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op9_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.duplicates(table(spark, sf_dir, "documents"))


def op10_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


def _planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the contract of op11 has them: a tenth of the documents repeat a period up to their end."""
    n = len(words)
    if doc is None or not n:
        return words
    rest, last = divmod(zlib.crc32(str(doc).encode()), 10)
    if last:
        return words
    first = rest % n
    period = 1 + (n - first) // (3 + rest % 8)
    times = (n - first) // period + 1
    return words[:first] + (words[first : first + period] * times)[: n - first]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), _planted)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        milli,
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_order.languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_fingerprints": op1_minhash_fingerprints,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality_discriminant": op4_quality_discriminant,
    "op5_toxic_neighbours": op5_toxic_neighbours,
    "op6_rans_files": op6_rans_files,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_hmm_scoring": op8_hmm_scoring,
    "op9_bagminhash_dedup": op9_bagminhash_dedup,
    "op10_metric_range_join": op10_metric_range_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hilbert_negatives": op12_hilbert_negatives,
    "op13_rank_order_language": op13_rank_order_language,
}
