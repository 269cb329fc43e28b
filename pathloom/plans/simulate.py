"""Simulated trajectories: routes drawn from the prior, with noisy observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pathloom.functions.model import ExponentialMapMatchingModel
from pathloom.plans import engine
from pathloom.plans.matching import network, shipped
from pathloom.sources.network import EDGE

ROUTES = "traj_id long, obs_idx int, t double, dt double, u long, v long, k int, alpha double, true_x double, true_y double, d double, route array<struct<u: bigint, v: bigint, k: int>>, x double, y double"


def sampled_routes(table: DataFrame, trajectories: int, observations: int, model: ExponentialMapMatchingModel, timestamps: float | list[float] = 15.0, seed: int = 0, refine: float = 1.0, starts: dict[int, tuple[int, int, int, float]] | None = None, cutoff: int | None = None) -> DataFrame:
    """A row for each trajectory and observation: the true position and route, and the observation x, y.

    `timestamps` is one interval, as many timestamps as observations, or one interval less.
    A start is uniform over edges and then over the edge, or given by trajectory; it is put on the
    first grid place at or past it.
    """
    if isinstance(timestamps, int | float):
        gaps = [float(timestamps)] * (observations - 1)
    elif len(timestamps) == observations:
        gaps = np.diff(np.asarray(timestamps, float)).tolist()
    elif len(timestamps) == observations - 1:
        gaps = [float(x) for x in timestamps]
    else:
        raise ValueError(f"{len(timestamps)} timestamps or intervals do not fit {observations} observations")
    edges, key = shipped(table)

    def one(pdf):
        net, traj = network(edges.value, refine, key), int(pdf["traj_id"].iloc[0])
        rng = engine.generator(seed, traj, "sample")
        if starts and traj in starts:
            e, alpha = net.number[starts[traj][:3]], starts[traj][3]
        else:
            e, alpha = int(rng.integers(len(net.edges))), float(rng.random())
        ga, gx, gy, _ = net.grid(e)
        i = max(0, int((ga >= alpha - 1e-12).sum()) - 1)
        place, out, t = (e, ga[i], gx[i], gy[i]), [], 0.0
        for n in range(observations):
            d, route, dt = 0.0, (place[0],), None
            if n:
                dt = gaps[n - 1]
                t += dt
                routes, number, edge, a, x, y, dist = net.candidates(place[0], place[1], model.max_speed * dt, cutoff or max(int(dt / 1.5), 10))
                c = engine.draw(rng, model.prior_values(dist, dt) * model.deviation_values(place[2], place[3], x, y, dist), 1)[0]
                d, route, place = float(dist[c]), routes[number[c]], (int(edge[c]), a[c], x[c], y[c])
            noise = rng.normal(0.0, model.gps_sd, 2)
            u, v, k = net.edges[place[0]]
            out.append((traj, n, t, dt, u, v, k, place[1], place[2], place[3], d, [dict(zip(EDGE, net.edges[j])) for j in route], place[2] + noise[0], place[3] + noise[1]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ("traj_id l, obs_idx i, t d, dt d, u l, v l, k i, alpha d, true_x d, true_y d, d d, route a, x d, y d").split(", ")])

    return table.sparkSession.range(trajectories).withColumnRenamed("id", "traj_id").groupBy("traj_id").applyInPandas(one, ROUTES)
