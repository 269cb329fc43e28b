"""Matching of whole trajectories: many at once, one group a trajectory.

The engine runs inside a grouped map by traj_id. A network of up to NETWORK_EDGES edges
goes to every worker as a value; a larger one is joined to the trajectories first, by the
cells of a grid, so that each group only gets the edges it can reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.model import MapMatchingModel
from pathloom.plans import engine
from pathloom.sources.network import EDGE, EDGES_AT_MOST, collected

UPDATES = ("PF", "BSi")
NETWORK_EDGES = EDGES_AT_MOST

#: A row for each particle and observation: the position, the distance since the observation before
#: and the edges of the route from there. Failed trajectories have one row with their status.
PATHS = "traj_id long, particle_id int, obs_idx int, t double, u long, v long, k int, alpha double, x double, y double, d double, route array<struct<u: bigint, v: bigint, k: int>>, ess double, status string"
#: The same without the routes, which are most of what a match gives.
PLACES = PATHS.replace("route array<struct<u: bigint, v: bigint, k: int>>, ", "")


def _as_points(rows) -> list[list[tuple[float, float]]]:
    return [[(p["x"], p["y"]) for p in g] for g in rows]


_NETWORKS: dict[tuple, engine.Network] = {}


def network(edges, refine: float, key=None) -> engine.Network:
    """The network of a mapping or frame with columns u, v, k, geom; one with a key is built once in each worker."""
    key = (key, refine)
    if key[0] is None or key not in _NETWORKS:
        net = engine.Network(edges["u"], edges["v"], edges["k"], edges["geom"], refine)
        if key[0] is None:
            return net
        _NETWORKS.clear()
        _NETWORKS[key] = net
    return _NETWORKS[key]


def shipped(table: DataFrame, most: int = NETWORK_EDGES):
    """What gives the network to workers: a broadcast value of at most `most` edges, with the key of its content."""
    edges = collected(table, most)
    return table.sparkSession.sparkContext.broadcast(edges), hashlib.md5(repr(edges).encode()).hexdigest()


def per_trajectory(obs: DataFrame, table: DataFrame, work: Callable, schema: str, refine: float, model, most: int = NETWORK_EDGES) -> DataFrame:
    """`work(network, observations)` for each trajectory, as rows of `schema`."""
    if table.count() <= most:
        edges, key = shipped(table, most)

        def run(pdf):
            return work(network(edges.value, refine, key), pdf.sort_values("obs_idx"))

        # Observations are few bytes but much work: a stated number of partitions isn't coalesced by size. It must not be
        # that of shuffles, or Spark takes obs as partitioned already, by a shuffle that it does coalesce.
        parts = 4 * int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return obs.repartition(parts, "traj_id").groupBy("traj_id").applyInPandas(run, schema)
    # A copy without the history that both sides share: their columns must not be taken for one another.
    near = edges_near(obs, table, model)
    near = obs.sparkSession.createDataFrame([], near.schema).union(near).toDF("near_id", *near.columns[1:])

    def both(pdf, edges):
        if not len(pdf):
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
        return work(network(edges.assign(geom=_as_points(edges["geom"])), refine), pdf.sort_values("obs_idx"))

    return obs.groupBy("traj_id").cogroup(near.groupBy("near_id")).applyInPandas(both, schema)


def edges_near(obs: DataFrame, table: DataFrame, model) -> DataFrame:
    """(traj_id, u, v, k, geom): edges in the cells around each trajectory's observations that a route between
    two of them can touch."""
    gap = obs.select(F.max("dt")).first()[0] or 15.0
    reach = float(model.max_speed) * gap * 1.5
    cell = max(reach, 1.0)
    xs, ys = F.transform("geom", lambda p: p["x"]), F.transform("geom", lambda p: p["y"])

    def cells(values):
        return F.sequence(F.floor((F.array_min(values) - reach) / cell).cast("int"), F.floor((F.array_max(values) + reach) / cell).cast("int"))

    placed = table.select(*EDGE, "geom", F.explode(cells(xs)).alias("cx")).select(*EDGE, "geom", "cx", F.explode(cells(ys)).alias("cy"))
    seen = obs.select("traj_id", F.floor(F.col("x") / cell).cast("int").alias("cx"), F.floor(F.col("y") / cell).cast("int").alias("cy")).distinct()
    return seen.join(placed, ["cx", "cy"]).select("traj_id", *EDGE, "geom").dropDuplicates(["traj_id", *EDGE])


def rows_of(net: engine.Network, traj_id, steps: list[engine.Step], times, sizes, first_obs: int = 0, routes: bool = True) -> pd.DataFrame:
    many = [len(s.edge) for s in steps]
    each = lambda values: np.repeat(np.asarray(values), many)
    joined = lambda name: np.concatenate([getattr(s, name) for s in steps])
    e = net.ends[joined("edge")]
    out = {
        "traj_id": traj_id, "particle_id": np.concatenate([np.arange(n) for n in many]), "obs_idx": each(np.arange(len(steps)) + first_obs), "t": each(times[: len(steps)]), "u": e[:, 0], "v": e[:, 1], "k": e[:, 2],
        "alpha": joined("alpha"), "x": joined("x"), "y": joined("y"), "d": joined("d"),
    }
    if routes:
        out["route"] = [[dict(zip(EDGE, net.edges[j])) for j in r] for s in steps for r in s.route]
    return pd.DataFrame(out | {"ess": each(sizes[: len(steps)]), "status": "OK"})


def failed(traj_id, status: str, routes: bool = True) -> pd.DataFrame:
    row = {c.split()[0]: None for c in PATHS.split(", ")[:11]} | ({"route": None} if routes else {}) | {"ess": None}
    return pd.DataFrame([row | {"traj_id": traj_id, "status": status}])


def smooth(net, model, pdf, particles: int, seed, threshold: float, reach=None, **how) -> tuple[list[engine.Step], list[engine.Step], list[float]]:
    """Filter and backward simulation of one trajectory: smoothed steps, the filter's steps, effective sizes."""
    rows = list(zip(pdf["x"], pdf["y"], pdf["dt"]))
    traj = pdf["traj_id"].iloc[0]
    rng = engine.generator(seed, traj, "filter")
    steps, sizes = [engine.initiate(net, model, *rows[0][:2], particles, rng, reach)], [float(particles)]
    for x, y, dt in rows[1:]:
        new, size = engine.advance(net, model, steps[-1], x, y, float(dt), rng, threshold, **how)
        steps.append(new)
        sizes.append(size)
    return engine.backward(net, model, steps, engine.generator(seed, traj, "backward")), steps, sizes


def offline_map_match(obs: DataFrame, table: DataFrame, model: MapMatchingModel, particles: int = 100, seed: int = 0, refine: float = 1.0, threshold: float = 1.0, reach: float | None = None, most: int = NETWORK_EDGES, proposal: Callable = engine.propose, routes: bool = True) -> DataFrame:
    """Smoothed particles of every trajectory in obs (traj_id, obs_idx, t, dt, x, y), with their routes unless `routes` is False.
    `proposal` as in `engine.advance`."""

    def work(net, pdf):
        try:
            drawn, _, sizes = smooth(net, model, pdf, particles, seed, threshold, reach, proposal=proposal)
        except engine.MatchFailed as why:
            return failed(pdf["traj_id"].iloc[0], str(why), routes)
        return rows_of(net, pdf["traj_id"].iloc[0], drawn, pdf["t"].tolist(), sizes, routes=routes)

    return per_trajectory(obs, table, work, PATHS if routes else PLACES, refine, model, most)


def online_replay(obs: DataFrame, table: DataFrame, model: MapMatchingModel, particles: int = 100, update: str = "BSi", lag: int | None = 3, seed: int = 0, refine: float = 1.0, reach: float | None = None, proposal: Callable = engine.propose, routes: bool = True) -> DataFrame:
    """The online algorithm over whole trajectories, with the same draws as the stream, and routes unless `routes` is False."""
    if update not in UPDATES:
        raise ValueError(f"update must be one of {UPDATES}, not {update}")

    def work(net, pdf):
        traj = pdf["traj_id"].iloc[0]
        try:
            state, sizes, past = None, [], [] if lag else None
            for i, (x, y, dt) in enumerate(zip(pdf["x"], pdf["y"], pdf["dt"])):
                rng = engine.generator(seed, traj, "online", i)
                state = engine.start_online(net, model, x, y, particles, rng, reach) if state is None else engine.update(net, model, state, x, y, float(dt), rng, update, lag, proposal=proposal, past=past)
                sizes.append(state.last_ess)
        except engine.MatchFailed as why:
            return failed(traj, str(why), routes)
        return rows_of(net, traj, engine.whole(state, past) if past else state.track, pdf["t"].tolist(), sizes, routes=routes)

    return per_trajectory(obs, table, work, PATHS if routes else PLACES, refine, model)
