"""Posterior summaries: weights, effective sizes, sufficient statistics, histograms and distances between samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normalised(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """The weights divided by their group's sum; a group of none keeps zeros and is marked as failed."""
    total = F.sum(weight).over(W.partitionBy(*by))
    return df.withColumn("failed", total <= 0).withColumn(weight, F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0)))


def effective_size(df: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """(by..., ess, all_equal, n, good, failed)"""
    good = F.count_if(F.col(weight) > 0)
    return df.groupBy(*by).agg(
        (1 / F.sum(F.col(weight) * F.col(weight))).alias("ess"), (F.min(weight) == F.max(weight)).alias("all_equal"),
        F.count("*").alias("n"), good.alias("good"), (F.sum(weight) <= 0).alias("failed"),
    )


def movements(particles: DataFrame) -> DataFrame:
    """Particles' observation rows with `line`, the straight way since the observation before, and `deviation` from d."""
    order = W.partitionBy("traj_id", "particle_id").orderBy("obs_idx")
    line = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    return particles.withColumn("line", line).withColumn("deviation", F.abs(F.col("line") - F.col("d")))


def sufficient(particles: DataFrame, obs: DataFrame) -> DataFrame:
    """By trajectory: count, distances, deviations and squared residuals, their sums, and the noise they give."""
    seen = obs.select("traj_id", "obs_idx", F.col("x").alias("ox"), F.col("y").alias("oy"))
    rows = movements(particles).join(seen, ["traj_id", "obs_idx"])
    square = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return rows.groupBy("traj_id").agg(
        F.count("line").alias("n_moves"), F.sum(F.when(F.col("line").isNotNull(), F.col("d"))).alias("sum_d"), F.sum("deviation").alias("sum_dev"),
        F.sum(square).alias("sum_sq"), F.greatest(F.lit(0.0), F.sqrt(F.avg(square) / 2)).alias("gps_sd"), F.avg(F.when(F.col("line").isNotNull(), F.when(F.col("d") < 1e-5, 1.0).otherwise(0.0))).alias("zero_part"),
    )


def extent(particles: DataFrame) -> DataFrame:
    """By trajectory: box of all places, and mean places of the first and the last observation."""
    last = F.max("obs_idx").over(W.partitionBy("traj_id"))
    rows = particles.withColumn("__last", last)
    at = lambda when, c: F.avg(F.when(when, F.col(c)))
    return rows.groupBy("traj_id").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        at(F.col("obs_idx") == 0, "x").alias("start_x"), at(F.col("obs_idx") == 0, "y").alias("start_y"),
        at(F.col("obs_idx") == F.col("__last"), "x").alias("end_x"), at(F.col("obs_idx") == F.col("__last"), "y").alias("end_y"),
    )


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by..., bin, n): equal bins from low to high, the last one closed; values beside them are left out."""
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"))
    return df.where(F.col(value).between(low, high)).withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def total_variation(one: DataFrame, two: DataFrame, by: list[str], value: str, width: float | None = 3.0) -> DataFrame:
    """(by..., tv): half the difference between two samples' shares. Without a width values are compared as
    they are; with one in bins over the first sample's range, and the second's mass beside it counts whole."""
    if width is None:
        a, b = one.select(*by, F.col(value).alias("bin")), two.select(*by, F.col(value).alias("bin"))
    else:
        box = one.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))

        def binned(df):
            place = F.floor((F.col(value) - F.col("low")) / width)
            last = F.ceil((F.col("high") - F.col("low")) / width)
            return df.join(box, by).select(*by, F.when(F.col(value) < F.col("low"), F.lit(-1)).otherwise(F.least(place, last)).alias("bin"))

        a, b = binned(one), binned(two)

    def shares(df, name):
        counts = df.groupBy(*by, "bin").agg(F.count("*").alias("n"))
        return counts.select(*by, "bin", (F.col("n") / F.sum("n").over(W.partitionBy(*by))).alias(name))

    both = shares(a, "p").join(shares(b, "q"), [*by, "bin"], "full")
    return both.groupBy(*by).agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tv"))


def interval_distances(particles: DataFrame, seconds: float = 60.0, speeds: bool = False) -> DataFrame:
    """(traj_id, particle_id, interval, travelled): distance within each interval (start, start + seconds]."""
    rows = particles.where(F.col("t") > 0).withColumn("interval", (F.ceil(F.col("t") / seconds) - 1).cast("int"))
    total = F.sum("d") / seconds if speeds else F.sum("d")
    return rows.groupBy("traj_id", "particle_id", "interval").agg(total.alias("travelled"))


def runtime_per_observation(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., seconds): the mean over repeats of (time / n_obs)."""
    return runs.groupBy(*by).agg(F.avg(F.col("time") / F.col("n_obs")).alias("seconds"))
