"""Trips and observations: CSV with JSON polylines, and trajectories made from a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POLYLINE = "array<array<double>>"


def read_trips(spark: SparkSession, path: str, rows: int | None = None, marker: str = "POLYLINE") -> DataFrame:
    """A CSV of trips; every column whose name has `marker` holds JSON points. `rows` limits what is read."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    raw = raw if rows is None else raw.limit(rows)
    return raw.select(*[F.from_json(f"`{c}`", POLYLINE).alias(c) if marker in c else F.col(f"`{c}`") for c in raw.columns])


def points_of(trips: DataFrame, traj_id: str, polyline: str = "POLYLINE", interval: float = 15.0) -> DataFrame:
    """(traj_id, obs_idx, t, x, y) of each trip's points, `interval` seconds apart."""
    each = trips.select(F.col(traj_id).alias("traj_id"), F.posexplode(polyline).alias("obs_idx", "p"))
    return each.select("traj_id", "obs_idx", (F.col("obs_idx") * interval).alias("t"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def of_length(trips: DataFrame, polyline: str = "POLYLINE", least: int = 20, most: int = 60) -> DataFrame:
    """Trips of so many points."""
    return trips.where(F.size(polyline).between(least, most))


def observations(events: DataFrame) -> DataFrame:
    """(traj_id, obs_idx, t, x, y): a lattice trajectory for each user, one observation an event, 15 s apart.

    It goes round a block of 1500 by 100 m: right along a row, up, left along the next one, which
    has ways left, and down again, 40 m an observation."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    i = F.row_number().over(order) - 1
    rows = events.select(F.col("user_id").alias("traj_id"), "event_id", i.alias("obs_idx"))
    far = (300 + 40 * F.col("obs_idx")) % 3200
    row = F.col("traj_id") % 15
    row = F.when(row % 4 == 2, row - 1).otherwise(row)
    x = F.when(far < 1500, 100 + far).when(far < 1600, 1600).when(far < 3100, 3200 - far).otherwise(100)
    y = 100 * row + F.when(far < 1500, 0).when(far < 1600, far - 1500).when(far < 3100, 100).otherwise(3200 - far)
    x, y = x + F.col("event_id") * 37 % 21 - 10, y + F.col("event_id") * 53 % 21 - 10
    return rows.select("traj_id", "obs_idx", (15.0 * F.col("obs_idx")).alias("t"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def intervals(obs: DataFrame, timestamps: float | list[float] | None = None) -> DataFrame:
    """Adds dt, the seconds since the observation before; null for the first.

    `timestamps` None: from column t. A number: that interval. A list: as many timestamps
    as observations of every trajectory, or one interval less; any other length fails.
    """
    group = W.partitionBy("traj_id")
    first = F.col("obs_idx") == 0
    if timestamps is None:
        return obs.withColumn("dt", F.col("t") - F.lag("t").over(group.orderBy("obs_idx")))
    if isinstance(timestamps, int | float):
        return obs.withColumn("dt", F.when(~first, F.lit(float(timestamps))))
    values = F.array(*[F.lit(float(v)) for v in timestamps])
    n, many = F.count("*").over(group), len(timestamps)
    wrong = F.raise_error(F.concat(F.lit(f"{many} timestamps or intervals do not fit a trajectory of "), n.cast("string"))).cast("double")
    at = lambda i: F.get(values, i)
    dt = F.when(n == many, at(F.col("obs_idx")) - at(F.col("obs_idx") - 1)).when(n == many + 1, at(F.col("obs_idx") - 1)).otherwise(wrong)
    return obs.withColumn("dt", F.when(~first, dt))
