"""Reproducible randomness: uniforms from hashed keys, and what is drawn with them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(*key) -> Column:
    """A number in [0, 1) from the md5 of the key's parts joined by bars."""
    parts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal_pair(*key) -> tuple[Column, Column]:
    """Two independent standard normal numbers, by Box and Muller's transform."""
    u, v = uniform(*key, "a"), uniform(*key, "b")
    radius = F.sqrt(-2 * F.log(1 - u))
    return radius * F.cos(2 * math.pi * v), radius * F.sin(2 * math.pi * v)


def with_cdf(df: DataFrame, by: list[str], weight: str, order: list[str]) -> DataFrame:
    """Adds cdf, the running sum of the weight by group in a stable order, and total."""
    group = W.partitionBy(*by)
    running = group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({"cdf": F.sum(weight).over(running), "total": F.sum(weight).over(group)})


def categorical(df: DataFrame, by: list[str], weight: str, order: list[str], draws: int, seed: int, purpose: str) -> DataFrame:
    """`draws` draws with replacement from each group's rows by weight: the rows drawn, with `draw`
    (0 to draws - 1). The first row whose running sum exceeds u times the total is drawn; groups
    of no weight give no rows."""
    running = with_cdf(df, by, weight, order).where((F.col("total") > 0) & (F.col(weight) > 0))
    low = (F.col("cdf") - F.col(weight)) / F.col("total")
    high = F.col("cdf") / F.col("total")
    asked = df.select(*by).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    asked = asked.withColumn("__u", uniform(seed, *[F.col(c) for c in by], purpose, F.col("draw")))
    met = asked.join(running.withColumns({"low": low, "high": high}), by)
    return met.where((F.col("__u") >= F.col("low")) & (F.col("__u") < F.col("high"))).drop("__u", "low", "high", "cdf", "total")
