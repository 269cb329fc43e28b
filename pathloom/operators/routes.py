"""Routes: simple paths of edges within a distance, by iterated joins with the network's adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.sources.network import EDGE

STEP = "struct<u: bigint, v: bigint, k: int>"


def starts_of(table: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes of one edge, at its end: what `expand` begins with."""
    step = F.struct(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("k").cast("int").alias("k"))
    rows = edges.select(*EDGE).distinct().join(table.select(*EDGE), EDGE)
    zero = F.lit(0.0)
    return rows.select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("k").alias("sk"), *EDGE, F.array(step).alias("path"), zero.alias("d_start"), zero.alias("d_end"), F.lit(1).alias("n_rows"), F.lit(True).alias("open"))


def expand(starts: DataFrame, table: DataFrame, d_max: float, cutoff: int, cut=DataFrame.persist, all_routes: bool = True) -> DataFrame:
    """All routes from the starts: (su, sv, sk, path, u, v, k, d_start, d_end, n_rows, open).

    A route grows by an edge out of its end while it is open, that is, has reached the end of
    its last edge within `d_max` and has fewer rows than `cutoff`. It takes no edge twice and
    no immediate U-turn. d_start is the distance at the start of its last edge, d_end where
    it stops. With `all_routes` every prefix is a route, otherwise only those that use up
    d_max. The loop is over the number of edges, not over rows; `cut` keeps each round.
    """
    next_ = table.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("k").alias("nk"), F.col("length").alias("nl"))
    level, out = starts, starts
    for _ in range(cutoff - 1):
        grown = level.where("open").join(next_, F.col("v") == F.col("nu"))
        step = F.struct(F.col("nu").cast("long").alias("u"), F.col("nv").cast("long").alias("v"), F.col("nk").cast("int").alias("k"))
        turn = (F.col("nv") == F.col("u")) & (F.col("nk") == F.col("k"))
        grown = grown.where(~turn & ~F.array_contains("path", step.cast(STEP)))
        n = F.col("n_rows") + 1
        level = grown.select(
            "su", "sv", "sk", F.col("nu").alias("u"), F.col("nv").alias("v"), F.col("nk").alias("k"), F.concat("path", F.array(step)).alias("path"),
            F.col("d_end").alias("d_start"), F.least(F.col("d_end") + F.col("nl"), F.lit(float(d_max))).alias("d_end"), n.alias("n_rows"),
            ((F.col("d_end") + F.col("nl") <= d_max) & (n < cutoff)).alias("open"),
        )
        level = cut(level)
        if not level.take(1):
            break
        out = out.union(level)
    return out if all_routes else out.where(F.col("d_end") >= d_max)


def route_id(path):
    """A name that orders routes by their content."""
    return F.array_join(F.transform(path, lambda s: F.concat_ws("-", s["u"], s["v"], s["k"])), ">")


def overshoot(positions: DataFrame, routes: DataFrame, table: DataFrame) -> DataFrame:
    """Routes beside positions (u, v, k, alpha): distances from the position, by the rest of its edge more."""
    lengths = table.select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("k").alias("sk"), F.col("length").alias("start_length"))
    named = positions.withColumnsRenamed({"u": "su", "v": "sv", "k": "sk"})
    rest = (1 - F.col("alpha")) * F.col("start_length")
    joined = named.join(lengths, ["su", "sv", "sk"]).join(routes, ["su", "sv", "sk"])
    return joined.withColumn("d_start", F.when(F.col("n_rows") > 1, F.col("d_start") + rest).otherwise(F.lit(0.0))).withColumn("d_end", F.col("d_end") + rest)


def extended(routes: DataFrame, table: DataFrame, more: float, d_max: float, cutoff: int, cut=DataFrame.persist) -> DataFrame:
    """Routes that used up d_max, carried on for `more` metres."""
    lengths = table.select(*EDGE, "length")
    joined = routes.where(F.col("d_end") >= d_max).join(lengths, EDGE)
    end = F.least(F.col("d_start") + F.col("length"), F.lit(float(d_max + more)))
    reopened = joined.withColumn("open", (F.col("d_start") + F.col("length") <= d_max + more) & (F.col("n_rows") < cutoff)).withColumn("d_end", end).select(routes.columns)
    return expand(reopened, table, d_max + more, cutoff, cut).dropDuplicates(["path"])
