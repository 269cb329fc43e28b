"""Operations on particle paths in long form: rows (traj_id, particle_id, seq, is_obs, t, u, v, k, alpha, x, y, d)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import geometry
from pathloom.sources.network import EDGE

KEY = ["traj_id", "particle_id"]


def observation_mask(t: Column, seq: Column) -> Column:
    """True for observation rows: those with a time, and the first."""
    return (t != 0) | (seq == 0)


def observation_rows(paths: DataFrame) -> DataFrame:
    return paths.where(observation_mask(F.col("t"), F.col("seq")))


def _ordered():
    return W.partitionBy(*KEY).orderBy("seq")


def without_repeats(paths: DataFrame) -> DataFrame:
    """Rows whose edge differs from the row's before."""
    edge = F.struct(*EDGE)
    return paths.withColumn("__before", F.lag(edge).over(_ordered())).where(~edge.eqNullSafe(F.col("__before"))).drop("__before")


def route_nodes(paths: DataFrame) -> DataFrame:
    """(traj_id, particle_id, nodes): start nodes of the edges travelled, and the last end node."""
    steps = without_repeats(paths).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "u", "v"))).alias("s"))
    return steps.select(*KEY, F.concat(F.transform("s", lambda x: x["u"]), F.array(F.element_at("s", -1)["v"])).alias("nodes"))


def multi_modal(nodes: DataFrame) -> DataFrame:
    """(traj_id, is_multi_modal): whether any particle's nodes differ from another's."""
    return nodes.groupBy("traj_id").agg((F.min("nodes") != F.max("nodes")).alias("is_multi_modal"))


def appended(paths: DataFrame, proposals: DataFrame, full: bool = True) -> DataFrame:
    """Particles (traj_id, particle_id, path) with the proposals' (route) added, whose last row gets
    the new time, place and distance; with full False only the last row of the old path stays."""
    kept = F.col("path") if full else F.slice("path", -1, 1)
    return paths.join(proposals, KEY).select(*KEY, F.concat(kept, "route").alias("path"))


def cartesian(paths: DataFrame, table: DataFrame, observations_only: bool = False) -> DataFrame:
    """The rows' points on their edges, as x and y."""
    rows = observation_rows(paths) if observations_only else paths
    joined = rows.select(*KEY, "seq", *EDGE, "alpha").join(table.select(*EDGE, "geom"), EDGE)
    return joined.withColumn("p", geometry.interpolate(F.col("geom"), F.col("alpha"))).select(*KEY, "seq", "p.x", "p.y")


def densified(paths: DataFrame, table: DataFrame, refine: float = 1.0, vertices: bool = False) -> DataFrame:
    """(traj_id, particle_id, seq, step, u, v, k, alpha): places every `refine` metres between a row and the one before.

    The first row itself is step -1; later rows are not told themselves, unless `vertices` asks for
    them. On one edge places begin `refine` metres after the row before, else at the edge's start.
    """
    order = _ordered()
    edge = F.struct(*EDGE)
    rows = paths.select(*KEY, "seq", *EDGE, "alpha").withColumns({"pe": F.lag(edge).over(order), "pa": F.lag("alpha").over(order)})
    rows = rows.join(table.select(*EDGE, "length"), EDGE)
    begin = F.when(edge.eqNullSafe(F.col("pe")), F.col("pa") * F.col("length") + refine).otherwise(F.lit(0.0))
    n = F.ceil((F.col("alpha") * F.col("length") - begin) / refine - 1e-9).cast("int")
    rows = rows.withColumns({"begin": begin, "n": n})
    later = rows.where(F.col("pa").isNotNull() & (F.col("n") > 0)).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    later = later.select(*KEY, "seq", "step", *EDGE, ((F.col("begin") + F.col("step") * refine) / F.col("length")).alias("alpha"))
    own = rows if vertices else rows.where(F.col("pa").isNull())
    return own.select(*KEY, "seq", F.lit(-1).alias("step"), *EDGE, "alpha").union(later)


def trimmed(paths: DataFrame, value: str = "d", keep: int = 3) -> DataFrame:
    """Observation rows without the zeros at the end, but for the first `keep` of them."""
    rows = observation_rows(paths)
    last = F.max(F.when(F.col(value) != 0, F.col("seq"))).over(W.partitionBy(*KEY))
    rows = rows.withColumn("__last", F.coalesce(last, F.lit(-1)))
    rows = rows.withColumn("__after", F.sum(F.when(F.col("seq") > F.col("__last"), 1).otherwise(0)).over(_ordered()))
    return rows.where(F.col("__after") <= keep).drop("__last", "__after")


def rebased(alpha_new: Column, alpha_old: Column, length: Column) -> Column:
    """What a distance gains when its path is attached at another place of the same edge."""
    return F.round((alpha_new - alpha_old) * length, 5)


def split_at(paths: DataFrame, obs_idx: int) -> tuple[DataFrame, DataFrame]:
    """The part fixed through an observation, and the part from it on; both hold its row."""
    return paths.where(F.col("obs_idx") <= obs_idx), paths.where(F.col("obs_idx") >= obs_idx)


def last_rows(paths: DataFrame) -> DataFrame:
    return paths.withColumn("__n", F.max("seq").over(W.partitionBy(*KEY))).where(F.col("seq") == F.col("__n")).drop("__n")
