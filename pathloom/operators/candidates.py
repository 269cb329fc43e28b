"""Candidate positions: edges and grid places near an observation, and their weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import draws, geometry
from pathloom.functions.model import MapMatchingModel
from pathloom.sources.network import EDGE, segment_cells, segments

KEY = ["traj_id", "obs_idx"]


def edges_within(obs: DataFrame, table: DataFrame, reach: float, cell: float = 100.0) -> DataFrame:
    """(traj_id, obs_idx, x, y, u, v, k, distance_to_obs): edges nearer than `reach` to an observation.

    Both sides meet in cells of a grid, an equality join; each observation is in one cell,
    and a segment in all cells that it may be reached from.
    """
    spots = obs.select(*KEY, F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / cell).cast("int").alias("cx"), F.floor(F.col("y") / cell).cast("int").alias("cy"))
    near = spots.join(segment_cells(segments(table), cell, reach), ["cx", "cy"])
    near = near.withColumn("d", geometry.segment_distance(F.col("ox"), F.col("oy"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).where(F.col("d") < reach)
    return near.groupBy(*KEY, "ox", "oy", *EDGE).agg(F.min("d").alias("distance_to_obs"))


def places_within(obs: DataFrame, table: DataFrame, grid: DataFrame, reach: float, cell: float = 100.0) -> DataFrame:
    """Grid places nearer than `reach` to an observation, with that distance as `dist_to_obs`."""
    near = edges_within(obs, table, reach, cell).join(grid, EDGE)
    return near.withColumn("dist_to_obs", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).where(F.col("dist_to_obs") < reach)


def initial_weights(obs: DataFrame, table: DataFrame, grid: DataFrame, model: MapMatchingModel, reach: float | None = None) -> DataFrame:
    """Places that may have caused an observation, with their normalised likelihood as `weight`."""
    near = places_within(obs, table, grid, 5 * model.gps_sd if reach is None else reach)
    near = near.withColumn("lik", model.likelihood(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")))
    return near.withColumn("weight", F.col("lik") / F.sum("lik").over(W.partitionBy(*KEY)))


def initial_particles(weights: DataFrame, particles: int, seed: int) -> DataFrame:
    """`particles` draws for each observation: (traj_id, obs_idx, particle_id, u, v, k, grid_idx, alpha, x, y)."""
    drawn = draws.categorical(weights, KEY, "weight", [*EDGE, "grid_idx"], particles, seed, "init")
    return drawn.select(*KEY, F.col("draw").alias("particle_id"), *EDGE, "grid_idx", "alpha", "x", "y")


def random_positions(table: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, u, v, k, alpha): uniform over edges, then over the edge."""
    spark = table.sparkSession
    count = table.count()
    numbered = table.select(*EDGE).withColumn("i", F.row_number().over(W.orderBy(*EDGE)) - 1)
    asked = spark.range(n).select(F.col("id").alias("draw"))
    asked = asked.select("draw", F.floor(draws.uniform(seed, "edge", F.col("draw")) * count).cast("int").alias("i"), draws.uniform(seed, "alpha", F.col("draw")).alias("alpha"))
    return asked.join(numbered, "i").select("draw", *EDGE, "alpha")
