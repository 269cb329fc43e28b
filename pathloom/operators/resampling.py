"""Resampling, backward sampling and stitching as joins: the set-based forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import draws
from pathloom.functions.model import ZERO, MapMatchingModel
from pathloom.plans.engine import LEAST_PRIOR, OVERTAKE
from pathloom.sources.network import EDGE


def multinomial(particles: DataFrame, by: list[str], n: int, seed: int, weight: str = "weight", order: str = "particle_id") -> DataFrame:
    """n draws with replacement by weight from each group: (by..., draw, ancestor_id)."""
    drawn = draws.categorical(particles.select(*by, order, weight), by, weight, [order], n, seed, "resample")
    return drawn.select(*by, "draw", F.col(order).alias("ancestor_id"))


def gathered(particles: DataFrame, ancestors: DataFrame, by: list[str]) -> DataFrame:
    """The particles drawn, renumbered by draw."""
    old = particles.withColumnRenamed("particle_id", "ancestor_id")
    return ancestors.join(old, [*by, "ancestor_id"]).withColumnRenamed("draw", "particle_id")


def never_drawn(particles: DataFrame, ancestors: DataFrame, by: list[str]) -> DataFrame:
    return particles.join(ancestors.select(*by, F.col("ancestor_id").alias("particle_id")), [*by, "particle_id"], "left_anti")


def backward_weights(filtered: DataFrame, futures: DataFrame, table: DataFrame, model: MapMatchingModel, dt: float) -> DataFrame:
    """For each future path j (traj_id, j, u, v, k of its first edge, alpha0, d_next, same_edge, alpha_next, nx, ny)
    the filter's particles (traj_id, particle_id, u, v, k, alpha, x, y, weight, z) on that edge, with `bw`,
    normalised by j."""
    base = F.when((F.col("weight") > 0) & (F.col("z") > ZERO), F.col("weight") / F.col("z")).otherwise(F.lit(0.0))
    met = futures.join(filtered, ["traj_id", *EDGE]).join(table.select(*EDGE, "length"), EDGE)
    d = F.col("d_next") + F.round((F.col("alpha0") - F.col("alpha")) * F.col("length"), 5)
    met = met.withColumn("d", d).where((F.col("d") >= 0) & (~F.col("same_edge") | (F.col("alpha") <= F.col("alpha_next") + OVERTAKE)))
    value = base * model.distance_prior(F.col("d"), dt) * model.deviation_prior(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"), F.col("d"))
    from pathloom.operators.analytics import normalised

    return normalised(met.withColumn("bw", value), ["traj_id", "j"], "bw")


def stitch_weights(fixed: DataFrame, fresh: DataFrame, table: DataFrame, model: MapMatchingModel, dt: float, z_power: float = -1.0) -> DataFrame:
    """For each fixed particle j (traj_id, j, u, v, k, ja, jx, jy) the new paths k (traj_id, particle_id, u, v, k, alpha,
    x, y, weight, z, d_next, same_edge, alpha_next, nx, ny) that start on its edge, with `sw`, normalised by j."""
    prior = model.distance_prior(F.col("d_next"), dt) * model.deviation_prior(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"), F.col("d_next"))
    bottom = prior * F.pow(F.col("z"), F.lit(-z_power))
    new = fresh.withColumn("adjusted", F.when((bottom > LEAST_PRIOR) & (F.col("z") > LEAST_PRIOR), F.col("weight") / bottom).otherwise(F.lit(0.0)))
    met = fixed.join(new, ["traj_id", *EDGE]).join(table.select(*EDGE, "length"), EDGE)
    met = met.where(~F.col("same_edge") | (F.col("alpha_next") >= F.col("ja") - OVERTAKE))
    d = F.col("d_next") + F.round((F.col("alpha") - F.col("ja")) * F.col("length"), 5)
    met = met.withColumn("d", d).where(F.col("d") >= 0)
    value = F.col("adjusted") * model.distance_prior(F.col("d"), dt) * model.deviation_prior(F.col("jx"), F.col("jy"), F.col("nx"), F.col("ny"), F.col("d"))
    from pathloom.operators.analytics import normalised

    return normalised(met.withColumn("sw", value), ["traj_id", "j"], "sw")


def repaired(particles: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Failed particles (weight 0) replaced by random good ones: (by..., particle_id, source_id)."""
    good = particles.where(F.col("weight") > 0).select(*by, F.col("particle_id").alias("source_id"))
    counts = good.groupBy(*by).agg(F.array_sort(F.collect_list("source_id")).alias("sources"))
    bad = particles.where(F.col("weight") <= 0).select(*by, "particle_id").join(counts, by)
    u = draws.uniform(seed, *[F.col(c) for c in by], "repair", F.col("particle_id"))
    fixed = bad.select(*by, "particle_id", F.get("sources", F.floor(u * F.size("sources")).cast("int")).alias("source_id"))
    return good.select(*by, F.col("source_id").alias("particle_id"), "source_id").union(fixed)
