"""Sinks: matched paths and traces as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_paths(paths: DataFrame, folder: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Parquet in one folder for each bucket of trajectories, so that a later run reads only the buckets it needs."""
    keyed = paths.withColumn("bucket", F.pmod(F.xxhash64("traj_id"), F.lit(buckets)).cast("int"))
    keyed.repartition("bucket").sortWithinPartitions("traj_id", "obs_idx").write.mode(mode).partitionBy("bucket").parquet(folder)


def read_paths(spark: SparkSession, folder: str, traj_ids: list[int] | None = None, buckets: int = 64) -> DataFrame:
    """The paths of all or some trajectories; only their buckets are read."""
    rows = spark.read.parquet(folder)
    if traj_ids is None:
        return rows.drop("bucket")
    wanted = [F.pmod(F.xxhash64(F.lit(int(t)).cast("long")), F.lit(buckets)).cast("int") for t in traj_ids]
    return rows.where(F.col("bucket").isin(wanted)).where(F.col("traj_id").isin(traj_ids)).drop("bucket")


def clear_caches(spark: SparkSession) -> None:
    """Forgets cached tables and the workers' route caches between timed runs."""
    spark.catalog.clearCache()
    from pathloom.plans import matching

    matching._NETWORKS.clear()
