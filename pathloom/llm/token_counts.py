"""Token counts: the exact histogram of encoded lengths and its suffix sums (operator 2).

Documents are encoded once and counted by length. Sums over all lengths from one on,
taken from the histogram alone, then answer for every context limit how many documents
and tokens lie above it, what cutting at the limit leaves, and which length a quantile
has. The histogram has as many rows as there are distinct lengths; its suffix sums are
taken within buckets of BUCKET lengths and over the buckets' totals, so no task sees all.

Defined results
---------------
Null and empty texts have length 0 and count as documents. Texts are encoded whole;
strings that look like special tokens are ordinary text. Null groups are a group.
Repeated rows count each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrowtext as at

RANKS, BUCKET = "/opt/tokenizers/byte_bpe_50k.tiktoken", 64
#: The pattern that splits text before merges, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def encoder(ranks: bytes):
    """The encoder of a rank file's bytes, kept in the process."""
    import tiktoken

    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def token_lengths(docs: DataFrame, text: str = "text", carry: list[str] | None = None, ranks: str = RANKS) -> DataFrame:
    """The carried columns with n_tokens. The driver reads the rank file and sends its bytes along."""
    with open(ranks, "rb") as file:
        table = file.read()

    def setup():
        encode = encoder(table).encode_ordinary

        def work(texts):
            return {"n_tokens": np.array([len(encode(t)) if t else 0 for t in texts.strings()], np.int64)}

        return work

    return at.map_text(docs, setup, "n_tokens long", text, carry)


def histogram(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_tokens, n_docs)"""
    return counted.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(lengths: DataFrame, by: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """For each length as a context limit: documents and tokens of that length or more, what all
    documents hold when cut at the limit, and the part of documents that fit."""
    own = lengths.withColumn("__b", F.floor(F.col("n_tokens") / bucket)).withColumn("__t", F.col("n_tokens") * F.col("n_docs"))
    totals = own.groupBy(*by, "__b").agg(F.sum("n_docs").alias("__bd"), F.sum("__t").alias("__bt"))
    after = W.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*by)
    totals = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__kb"),
        F.coalesce(F.sum("__bd").over(after), F.lit(0)).alias("__ad"), F.coalesce(F.sum("__bt").over(after), F.lit(0)).alias("__at"),
        F.sum("__bd").over(every).alias("__d"), F.sum("__bt").over(every).alias("__all"),
    )
    match = F.col("__b") == F.col("__kb")
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inside = W.partitionBy(*by, "__b").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumns({"__sd": F.sum("n_docs").over(inside), "__st": F.sum("__t").over(inside)}).join(totals, match)
    docs, tokens = F.col("__sd") + F.col("__ad"), F.col("__st") + F.col("__at")
    return own.select(
        *by, F.col("n_tokens").alias("limit_tokens"), "n_docs", docs.alias("docs_from"), tokens.alias("tokens_from"),
        (F.col("__all") - tokens + docs * F.col("n_tokens")).alias("truncated_total"),
        (F.col("__d") - docs + F.col("n_docs")).alias("docs_fitting"), F.col("__d").alias("docs_all"), F.col("__all").alias("tokens_all"),
    )


def quantiles(sums: DataFrame, parts: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., part, n_tokens): the smallest length that at least this part of the documents doesn't exceed."""
    asked = sums.withColumn("part", F.explode(F.array(*[F.lit(float(p)) for p in parts])))
    return asked.where(F.col("docs_fitting") >= F.col("part") * F.col("docs_all")).groupBy(*by, "part").agg(F.min("limit_tokens").alias("n_tokens"))


def truncated_totals(sums: DataFrame, limits: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., limit_tokens, tokens): what all documents hold when cut at any limit, a length or not."""
    asked = sums.withColumn("asked", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    # The shortest length from the limit on knows how many are cut; those below it fit whole.
    last = asked.groupBy(*by, "asked").agg(
        F.min(F.when(F.col("limit_tokens") >= F.col("asked"), F.struct("limit_tokens", "docs_from", "tokens_from"))).alias("x"), F.first("tokens_all").alias("all")
    )
    cut = F.coalesce(F.col("x.tokens_from") - F.col("x.docs_from") * F.col("asked"), F.lit(0))
    return last.select(*by, F.col("asked").alias("limit_tokens"), (F.col("all") - cut).alias("tokens"))
