"""The optimal proposal of many particles at once, by position.

`operators.proposal` says the same in rows: one for each particle and candidate. Here particles come sorted by
position, and those in one position share its candidates as arrays. The draws are the same: each from one
hashed uniform, by the running sum of the mass in the order of route_id and grid_idx.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions import draws
from pathloom.functions.model import MapMatchingModel
from pathloom.operators import proposal, routes
from pathloom.plans import engine, matching
from pathloom.sources.network import EDGE

SCHEMA = "traj_id long, particle_id int, u long, v long, k int, grid_idx int, alpha double, x double, y double, d double, route_id string"
#: Masses that are calculated at once.
CELLS = 1 << 20
#: Noise deviations within which candidates are looked at first, and the part of a particle's mass that the others must
#: stay under, all together, to be left out: too little to change a double. Otherwise all candidates are looked at.
NEAR, NOTHING = 12.0, 1e-18


class Starts:
    """An edge's candidates in the order of route_id and grid_idx, but for what depends on the place on it."""

    def __init__(self, net: engine.Network, e: int, d_max: float, cutoff: int):
        found = [(p, s) for p, s in net.routes(e, d_max, cutoff) if len(net.grid(p[-1])[0])]
        name = lambda p: ">".join("-".join(map(str, net.edges[j])) for j in p)
        named = sorted((name(p), p, s) for p, s in found)
        self.names = [n for n, _, _ in named]
        parts = [net.grid(p[-1]) for _, p, _ in named]
        sizes = [len(g[0]) for g in parts]
        self.alpha, self.x, self.y, self.dist = (np.concatenate([g[c] for g in parts]) if parts else np.zeros(0) for c in range(4))
        self.start = np.repeat([s for _, _, s in named], sizes)
        self.own = np.repeat(np.array([len(p) == 1 for _, p, _ in named], bool), sizes)
        self.edge = np.repeat(np.array([p[-1] for _, p, _ in named], int), sizes)
        self.route = np.repeat(np.arange(len(named)), sizes)
        self.place = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, int)
        self.bytes = 72 * len(self.alpha) + sum(60 + len(n) for n in self.names)


def _mass(model, prior, x, y, ox, oy):
    return prior * model.likelihood_values(x, y, ox[:, None], oy[:, None])


def _drawn(mass: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row the first column whose share of the running sum exceeds the uniform number, and the sum."""
    cdf = np.cumsum(mass, 1)
    total = cdf[:, -1]
    share = cdf / np.where(total > 0, total, 1.0)[:, None]
    return (share <= uniform[:, None]).sum(1), total


def draw_position(model, s: Starts, alpha: float, length: float, px: float, py: float, ox, oy, uniform, dt: float, d_max: float, refine: float):
    """For the particles of one position, with an observation and a uniform number each, the candidate drawn (-1: none has mass) and all distances."""
    rest = (1 - alpha) * length
    first = length - math.floor(rest / refine + 1e-9) * refine
    d = np.where(s.own, s.dist - first, s.start + rest + s.dist)
    keep = np.flatnonzero((~s.own | (s.alpha >= alpha - 1e-12)) & (d < d_max + engine.ZERO))
    out = np.full(len(ox), -1)
    if not len(keep):
        return out, d
    x, y, at = s.x[keep], s.y[keep], d[keep]
    prior = model.prior_values(at, dt) * model.deviation_values(px, py, x, y, at)
    reach = NEAR * model.gps_sd
    close = np.flatnonzero((x >= ox.min() - reach) & (x <= ox.max() + reach) & (y >= oy.min() - reach) & (y <= oy.max() + reach))
    left_out = prior.sum() * math.exp(-0.5 * NEAR**2)

    def fill(rows, columns, all_of_them):
        """Draws for the rows among the columns; those that need all columns are given back."""
        again = []
        step = max(1, CELLS // max(1, len(columns)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            c, total = _drawn(_mass(model, prior[columns], x[columns], y[columns], ox[part], oy[part]), uniform[part])
            good = total > 0 if all_of_them else (total * NOTHING > left_out) & (uniform[part] > 0)
            out[part[good]] = keep[columns[c[good]]]
            again.append(part[~good])
        return np.concatenate(again)

    rows = np.arange(len(ox))
    if len(close):
        rows = fill(rows, close, False)
    if len(rows):
        fill(rows, np.arange(len(keep)), True)
    return out, d


def proposed(particles: DataFrame, obs: DataFrame, table: DataFrame, grid: DataFrame, model: MapMatchingModel, dt: float, d_max: float, refine: float, seed: int, most: int = matching.NETWORK_EDGES) -> DataFrame:
    """One candidate drawn for each particle (traj_id, particle_id, u, v, k, alpha, x, y) by prior times likelihood of its
    traj_id's next observation in obs. Networks of more than `most` edges are joined, with a row for each candidate."""
    cutoff = proposal.cutoff_of(dt)
    if table.count() > most:
        found = proposal.candidates(particles, routes.expand(routes.starts_of(table, particles), table, d_max, cutoff), table, grid, d_max, refine)
        return proposal.proposed(proposal.weighted(found, obs, model, dt), seed).drop("path")
    edges, key = matching.shipped(table, most)
    seen = obs.select("traj_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    held = particles.select("traj_id", "particle_id", *EDGE, "alpha", "x", "y").join(seen, "traj_id")
    held = held.withColumn("chance", draws.uniform(seed, F.col("traj_id"), F.col("particle_id"), "propose", F.lit(0)))
    # The sort brings the particles of a position together; a stated number of partitions isn't coalesced by size.
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.repartition(parts, *EDGE, "alpha").sortWithinPartitions(*EDGE, "alpha")

    def run(batches):
        net = matching.network(edges.value, refine, key)
        all_ends = np.array(net.edges)
        known: dict[int, Starts] = {}
        cached = 0
        for batch in batches:
            traj, particle, u, v, k, alpha, x, y, ox, oy, chance = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(11))
            if not len(traj):
                continue
            new = np.flatnonzero((u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (k[1:] != k[:-1]) | (alpha[1:] != alpha[:-1])) + 1
            rows, numbers, places, names = [], [], [], []
            for a, b in zip([0, *new], [*new, len(traj)]):
                e = net.number[(int(u[a]), int(v[a]), int(k[a]))]
                if e not in known:
                    made = Starts(net, e, d_max, cutoff)
                    if cached + made.bytes > net.CACHE:
                        known.clear()
                        cached = 0
                    cached += made.bytes
                    known[e] = made
                s = known[e]
                c, d = draw_position(model, s, alpha[a], net.length[e], x[a], y[a], ox[a:b], oy[a:b], chance[a:b], dt, d_max, refine)
                good = c >= 0
                c = c[good]
                rows.append(np.flatnonzero(good) + a)
                numbers.append(np.stack([s.edge[c], s.place[c]]))
                names.extend([s.names[r] for r in s.route[c].tolist()])
                places.append(np.stack([s.alpha[c], s.x[c], s.y[c], d[c]]))
            row, (edge, place), (to, px, py, d) = np.concatenate(rows), np.concatenate(numbers, 1), np.concatenate(places, 1)
            ends = all_ends[edge]
            yield pa.RecordBatch.from_arrays([
                pa.array(traj[row]), pa.array(particle[row], pa.int32()), pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(ends[:, 2], pa.int32()), pa.array(place, pa.int32()),
                pa.array(to), pa.array(px), pa.array(py), pa.array(d), pa.array(names, pa.string()),
            ], [f.split()[0] for f in SCHEMA.split(", ")])

    return held.mapInArrow(run, SCHEMA)
