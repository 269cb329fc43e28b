"""The corpus pipeline: each stage takes what its predecessor kept.

Language identification drops documents in no learned language, near-dedup keeps one
document of each group, decontamination drops what overlaps the benchmark, personal data
are masked, and the last stage mixes the sources: it gives the documents taken, with how
often each is taken whole (full_epochs) and how many tokens one more epoch takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontaminate, langid, mixing, near_dedup, pii, shared
from pathloom.llm.registry import MIX, domain_of


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null, empty and letterless texts go."""
    return langid.with_language(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return near_dedup.without_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows."""
    return decontaminate.without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by kind."""
    return pii.without_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with all their columns and what is taken of them. Columns of the documents that
    are named as a result (domain, n_tokens, full_epochs, prefix_tokens, taken_tokens) give way to it."""
    made = ["domain", "n_tokens", "full_epochs", "prefix_tokens", "taken_tokens"]
    names = [c for c in docs.columns if c.lower() not in ("doc_id", *made)]
    # Carried columns have names that no step uses, whatever the documents call them.
    held = {f"__column{i}": c for i, c in enumerate(names)}
    renamed = docs.select("*", *[F.col(f"`{c}`").alias(n) for n, c in held.items()])
    base = shared.cut(mixing.with_leaf(renamed, domain_of(), carry=list(held)))
    out = mixing.mixed(base, **MIX)
    return out.select("doc_id", *[F.col(n).alias(c) for n, c in held.items()], *made)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("source_mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, one after another; each one's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir))
    return docs
