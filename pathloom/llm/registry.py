"""The queries of this package, each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, media, mixing, near_dedup, oracles, passages, pii, quality, secrets, shared, token_counts
from .shared import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(read(spark, sf_dir, "documents"), carry=["doc_id"])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ("lang",)
    counted = token_counts.token_lengths(read(spark, sf_dir, "documents"), carry=["lang"])
    return token_counts.suffix_sums(shared.cut(token_counts.histogram(counted, by)), by)


#: Production weights: names without one weigh 0.05 as languages and 1 elsewhere.
MIX = {
    "weights": {"domain": {"web": 0.6, "books": 0.4}, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}},
    "other": {"lang": 0.05},
    "part": 0.9,
    "epochs": 3,
    "seed": 3,
}


def domain_of(source: str = "source"):
    """Sources are told apart as web and books by a hash of their name."""
    return F.when(F.substring(F.md5(F.coalesce(F.col(source), F.lit(""))), 1, 1) < F.lit("8"), F.lit("web")).otherwise(F.lit("books"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared.cut(mixing.with_leaf(read(spark, sf_dir, "documents"), domain_of()))
    return mixing.mixed(base, **MIX)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(read(spark, sf_dir, "documents"), carry=["doc_id"]))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=["doc_id"])


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(read(spark, sf_dir, "documents"), carry=["doc_id"])


QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_source_mixing": op3_source_mixing,
    "op4_media_columns": op4_media_columns,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scans": op10_secret_scans,
}

#: DuckDB's SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_source_mixing": oracles.mixing(MIX),
    "op8_minhash_near_dedup": oracles.NEAR,
    "op9_decontamination": oracles.CONTAMINATION,
}
