"""The optimal proposal: candidates of the next position, their weights, and draws among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import draws
from pathloom.functions.model import FLOOR, ZERO, MapMatchingModel
from pathloom.operators.routes import overshoot, route_id
from pathloom.sources.network import EDGE


def cutoff_of(dt: float) -> int:
    """How many rows a route may have in an interval."""
    return max(int(dt / 1.5), 10)


def candidates(particles: DataFrame, routes: DataFrame, table: DataFrame, grid: DataFrame, d_max: float, refine: float = 1.0) -> DataFrame:
    """Each particle's (traj_id, particle_id, u, v, k, grid_idx, alpha, x, y) candidates: every grid place on the
    last edge of each of its routes, with the route's distance `d` from it, no farther than d_max.

    On its own edge a particle doesn't go back: only places with alpha as large as its own, and
    the first of them counts as distance 0.
    """
    held = particles.select("traj_id", "particle_id", *EDGE, F.col("alpha").alias("pa"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = overshoot(held.withColumnRenamed("pa", "alpha"), routes, table).withColumnRenamed("alpha", "pa")
    places = grid.select(*EDGE, "grid_idx", "dist", "alpha", "x", "y")
    both = met.join(places, EDGE)
    own = F.col("n_rows") == 1
    at_or_past = F.col("alpha") >= F.col("pa") - 1e-12
    both = both.where(~own | at_or_past)
    # The first place at or past the particle, counted back from the edge's end as the grid is.
    rest = (1 - F.col("pa")) * F.col("start_length")
    step = F.col("start_length") - F.floor(rest / refine + 1e-9) * refine
    d = F.when(own, F.col("dist") - step).otherwise(F.col("d_start") + F.col("dist"))
    return both.withColumn("d", d).where(F.col("d") < d_max + ZERO).withColumn("route_id", route_id(F.col("path")))


def weighted(found: DataFrame, obs: DataFrame, model: MapMatchingModel, dt: float, gradients: bool = False) -> DataFrame:
    """Candidates with the prior, its gradients if asked for, and the likelihood of the next observation."""
    seen = obs.select("traj_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    gamma, dev = model.distance_prior(F.col("d"), dt), model.deviation_prior(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("d"))
    rows = found.join(seen, "traj_id").withColumns({"gamma": gamma, "dev": dev}).withColumn("prior", F.col("gamma") * F.col("dev"))
    rows = rows.withColumn("lik", model.likelihood(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    if gradients:
        for name, value in model.distance_prior_gradient(F.col("d"), dt).items():
            rows = rows.withColumn(f"d_{name}", value * F.col("dev"))
        rows = rows.withColumn("d_deviation_beta", -F.abs(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) - F.col("d")) * F.col("prior"))
    return rows


def totals(rows: DataFrame, d_max: float, gradients: bool = False, far: float = 0.9) -> DataFrame:
    """By particle: Z (sum of the prior over all candidates), the proposal's weight, the part of its mass
    beyond `far` of d_max, the longest distance, and sums of gradients; one aggregation for all."""
    mass = F.col("prior") * F.col("lik")
    aggs: list[Column] = [
        F.sum("prior").alias("z"), F.sum(mass).alias("mass"), F.sum(F.when(F.col("d") > far * d_max, mass).otherwise(F.lit(0.0))).alias("far_mass"),
        F.max("d").alias("max_d"), F.count("*").alias("n_candidates"),
    ]
    if gradients:
        aggs += [F.sum(c).alias(f"z_{c}") for c in rows.columns if c.startswith("d_") and c not in ("d_start", "d_end")]
    sums = rows.groupBy("traj_id", "particle_id").agg(*aggs)
    sums = sums.withColumn("weight", F.col("mass") / F.col("z"))
    return sums.withColumn("far_ratio", F.when(F.col("mass") > FLOOR, F.col("far_mass") / F.col("mass")).otherwise(F.lit(0.0)))


def retried(sums: DataFrame, d_max: float, mass: float = 0.1, far: float = 0.9) -> DataFrame:
    """Particles whose candidates crowd at d_max: to be proposed once more with a larger one."""
    return sums.where((F.col("far_ratio") > mass) & (F.col("max_d") > far * d_max))


def proposed(rows: DataFrame, seed: int) -> DataFrame:
    """One candidate drawn for each particle by prior times likelihood; places of no likelihood are left out first."""
    mass = rows.where(F.col("lik") > 0).withColumn("m", F.col("prior") * F.col("lik"))
    drawn = draws.categorical(mass, ["traj_id", "particle_id"], "m", ["route_id", "grid_idx"], 1, seed, "propose")
    return drawn.select("traj_id", "particle_id", *EDGE, "grid_idx", "alpha", "x", "y", "d", "route_id", "path")
