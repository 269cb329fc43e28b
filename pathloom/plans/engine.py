"""One trajectory's inference in numpy: the grouped-map execution of the proposal, the filter,
backward simulation and fixed-lag stitching.

Positions are edge numbers with a proportion of the edge; all candidates of a position are
arrays. Particles in one position share its candidates. Draws come from a generator seeded
by the trajectory and the observation, so a rerun of a lost task gives the same rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pathloom.functions.model import FLOOR, ZERO, MapMatchingModel

#: The slack for overtaking, and the least prior that a stitch divides by.
OVERTAKE, LEAST_PRIOR = 1e-6, 1e-5
#: Noise deviations within which candidates are looked at first, and the part of a position's mass that the others must
#: stay under, all together, to be left out: too little to change a double. Otherwise all candidates are looked at.
NEAR, NOTHING = 12.0, 1e-18


class MatchFailed(Exception):
    """No particle has weight; the message is the trajectory's status."""


def generator(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5("|".join(map(str, key)).encode()).digest()[:8], "big"))


def _equal(a, b) -> bool:
    try:
        return type(a) is type(b) and vars(a) == vars(b)
    except ValueError:  # settings that are arrays
        return False


class Network:
    """Edges, each with its points (x, y), with grids, followers and cached routes."""

    #: Bytes of candidates that are cached at once.
    CACHE = 256 << 20
    CELL = 100.0
    #: Positions whose sums are cached at once.
    SUMS = 200_000

    def __init__(self, u, v, k, geoms, refine: float = 1.0):
        order = sorted(range(len(u)), key=lambda i: (int(u[i]), int(v[i]), int(k[i])))
        self.edges = [(int(u[i]), int(v[i]), int(k[i])) for i in order]
        self.points = [np.array(geoms[i], float).reshape(-1, 2) for i in order]
        self.number = {e: i for i, e in enumerate(self.edges)}
        steps = [np.hypot(*np.diff(p, axis=0).T) for p in self.points]
        self.along = [np.concatenate([[0.0], np.cumsum(s)]) for s in steps]
        self.length = np.array([a[-1] for a in self.along])
        self.refine = refine
        leaving: dict[int, list[int]] = {}
        for i, e in enumerate(self.edges):
            leaving.setdefault(e[0], []).append(i)
        self.follow = [[j for j in leaving.get(v, []) if not (self.edges[j][1] == u and self.edges[j][2] == k)] for u, v, k in self.edges]
        self._grids: dict[int, tuple] = {}
        self._fans: dict[tuple, tuple] = {}
        self._cached = 0
        self._sums: dict[tuple, tuple] = {}
        self._sums_of = None
        self.ends = np.array(self.edges).reshape(-1, 3)
        self._cells: dict[tuple[int, int], list[int]] = {}
        for i, p in enumerate(self.points):
            lo, hi = np.floor(p.min(0) / self.CELL).astype(int), np.floor(p.max(0) / self.CELL).astype(int)
            for cx in range(lo[0], hi[0] + 1):
                for cy in range(lo[1], hi[1] + 1):
                    self._cells.setdefault((cx, cy), []).append(i)

    def grid(self, e: int):
        """alpha, x, y, dist of the places on an edge, from its end backwards."""
        if e not in self._grids:
            length = self.length[e]
            n = max(0, math.ceil((length - self.refine / 10) / self.refine))
            dist = length - np.arange(n) * self.refine
            x, y = (np.interp(dist, self.along[e], self.points[e][:, c]) for c in (0, 1))
            self._grids[e] = (dist / length if length else dist, x, y, dist)
        return self._grids[e]

    def routes(self, e: int, d_max: float, cutoff: int) -> list[tuple[tuple[int, ...], float]]:
        """(edges, distance from the end of e at the start of the last one) of every simple route."""
        out, stack = [], [((e,), 0.0, 0.0)]
        while stack:
            path, start, end = stack.pop()
            out.append((path, start))
            if end <= d_max and len(path) < cutoff:
                for j in self.follow[path[-1]]:
                    if j not in path:
                        stack.append(((*path, j), end, end + self.length[j]))
        return sorted(out)

    def fan(self, e: int, d_max: float, cutoff: int):
        """Candidates off edge e: routes, and arrays of route number, edge, alpha, x, y, distance from e's end."""
        key = (e, d_max, cutoff)
        if key not in self._fans:
            routes = [(p, s) for p, s in self.routes(e, d_max, cutoff) if len(p) > 1 and len(self.grid(p[-1])[0])]
            parts = [self.grid(p[-1]) for p, _ in routes]
            sizes = [len(g[0]) for g in parts]
            flat = [np.concatenate([g[c] for g in parts]) if parts else np.zeros(0) for c in range(4)]
            number = np.repeat(np.arange(len(routes)), sizes)
            edge = np.repeat(np.array([p[-1] for p, _ in routes], int), sizes)
            fan = ([p for p, _ in routes], number, edge, flat[0], flat[1], flat[2], flat[3] + np.repeat([s for _, s in routes], sizes))
            size = 48 * len(number) + sum(200 + 8 * len(p) for p in fan[0])
            if self._cached + size > self.CACHE:
                self._fans.clear()
                self._cached = 0
            self._cached += size
            self._fans[key] = fan
        return self._fans[key]

    def candidates(self, e: int, alpha: float, d_max: float, cutoff: int):
        """Routes and arrays (route number, edge, alpha, x, y, d) from a position; route 0 stays on the edge."""
        ga, gx, gy, gd = self.grid(e)
        ahead = ga >= alpha - 1e-12
        own = (ga[ahead], gx[ahead], gy[ahead], gd[ahead] - (gd[ahead][-1] if ahead.any() else 0.0))
        rest = (1 - alpha) * self.length[e]
        if rest > d_max:
            routes, number, edge, a, x, y, d = [], *[np.zeros(0)] * 6
        else:
            routes, number, edge, a, x, y, d = self.fan(e, d_max, cutoff)
        n = len(own[0])
        number = np.concatenate([np.zeros(n, int), number.astype(int) + 1])
        edge = np.concatenate([np.full(n, e), edge.astype(int)])
        a, x, y = (np.concatenate([o, f]) for o, f in zip(own[:3], (a, x, y)))
        d = np.concatenate([own[3], d + rest])
        near = d < d_max + ZERO
        return [(e,), *routes], number[near], edge[near], a[near], x[near], y[near], d[near]

    def sums(self, model, e: int, alpha: float, px: float, py: float, dt: float, d_max: float, cutoff: int, gradients: bool):
        """The prior's sum over the candidates of a position, and those of its gradients if asked for; kept for one model."""
        if self._sums_of is not model or len(self._sums) >= self.SUMS:
            # Each task has a copy of the model; equal ones have the same sums.
            if len(self._sums) >= self.SUMS or not _equal(self._sums_of, model):
                self._sums.clear()
            self._sums_of = model
        key = (e, alpha, px, py, dt, d_max, cutoff, gradients)
        if key not in self._sums:
            self._sums[key] = _sums(model, px, py, self.candidates(e, alpha, d_max, cutoff), dt, gradients)
        return self._sums[key]

    def near(self, ox: float, oy: float, reach: float):
        """Grid places nearer than `reach`: edge, alpha, x, y, distance."""
        parts = []
        span = [range(math.floor((o - reach) / self.CELL), math.floor((o + reach) / self.CELL) + 1) for o in (ox, oy)]
        for e in sorted({e for cx in span[0] for cy in span[1] for e in self._cells.get((cx, cy), ())}):
            p = self.points[e]
            if p[:, 0].min() - reach > ox or p[:, 0].max() + reach < ox or p[:, 1].min() - reach > oy or p[:, 1].max() + reach < oy:
                continue
            a, x, y, _ = self.grid(e)
            dist = np.hypot(x - ox, y - oy)
            ok = dist < reach
            parts.append((np.full(ok.sum(), e), a[ok], x[ok], y[ok], dist[ok]))
        return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, int), *[np.zeros(0)] * 4]


@dataclass
class Step:
    """All particles at one observation: where they are, and how they came from the one before."""

    edge: np.ndarray
    alpha: np.ndarray
    x: np.ndarray
    y: np.ndarray
    d: np.ndarray
    route: np.ndarray  # tuples of edge numbers, from the edge before to this one
    dt: float = 0.0
    weight: np.ndarray | None = None
    z: np.ndarray | None = None  # the prior's sum over candidates of the next step, once known
    slopes: np.ndarray | None = None  # the same for the prior's gradients

    def take(self, idx) -> Step:
        pick = lambda a: None if a is None else a[idx]
        return Step(*[pick(a) for a in (self.edge, self.alpha, self.x, self.y, self.d, self.route)], self.dt, pick(self.weight), pick(self.z), pick(self.slopes))


def _routes(items) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out


def draw(rng, weights: np.ndarray, n: int) -> np.ndarray:
    """n draws with replacement by weight."""
    cdf = np.cumsum(weights)
    return np.minimum(np.searchsorted(cdf, rng.random(n) * cdf[-1], "right"), len(weights) - 1)


def _draw_rows(weights: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A draw from each row of weights by one uniform number, and whether the row has any weight."""
    cdf = np.cumsum(weights, 1)
    drawn = (cdf <= uniform[:, None] * cdf[:, -1:]).sum(1)
    return np.minimum(drawn, weights.shape[1] - 1), cdf[:, -1] > 0


def ess(weights: np.ndarray) -> float:
    return 1.0 / float((weights**2).sum())


def initiate(net: Network, model, ox: float, oy: float, n: int, rng, reach: float | None = None) -> Step:
    edge, alpha, x, y, dist = net.near(ox, oy, 5 * model.gps_sd if reach is None else reach)
    if not len(edge):
        raise MatchFailed("FAILED_NO_EDGES")
    i = draw(rng, np.exp(-0.5 * dist**2 / model.gps_sd**2), n)
    return Step(edge[i], alpha[i], x[i], y[i], np.zeros(n), _routes([(int(e),) for e in edge[i]]), 0.0, np.full(n, 1.0 / n))


def _limits(model, dt: float, d_max, cutoff) -> tuple[float, int]:
    return model.max_speed * dt if d_max is None else d_max, max(int(dt / 1.5), 10) if cutoff is None else cutoff


def _positions(step: Step, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ordered by position, and where each position begins among them."""
    order = rows[np.lexsort((step.alpha[rows], step.edge[rows]))]
    e, a = step.edge[order], step.alpha[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(order), 1), bool), (e[1:] != e[:-1]) | (a[1:] != a[:-1])]))


def _sums(model, px: float, py: float, found, dt: float, gradients: bool):
    """The prior's sum over a position's candidates, and those of its gradients if asked for."""
    _, _, _, _, x, y, d = found
    dev = model.deviation_values(px, py, x, y, d)
    prior = model.prior_values(d, dt) * dev
    if not gradients:
        return prior.sum(), None
    slope = model.prior_slopes(d, dt) * dev
    return prior.sum(), [slope[0].sum(), slope[1].sum(), -(np.abs(np.hypot(x - px, y - py) - d) * prior).sum()]


def _set_sums(net: Network, model, step: Step, order: np.ndarray, begin: np.ndarray, dt: float, d_max: float, cutoff: int, gradients: bool) -> np.ndarray:
    """Sets step.z, and step.slopes if asked for, of the rows in the positions; z by position is returned."""
    heads = order[begin]
    found = [net.sums(model, *at, dt, d_max, cutoff, gradients) for at in zip(*(c[heads].tolist() for c in (step.edge, step.alpha, step.x, step.y)))]
    z = np.array([f[0] for f in found])
    which = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    step.z[order] = z[which]
    if gradients:
        step.slopes[order] = np.array([f[1] for f in found])[which]
    return z


def _near(net: Network, model, e: int, alpha, px, py, ox: float, oy: float, dt: float, d_max: float, cutoff: int):
    """For positions on one edge the candidates near an observation, and their distances and masses by position:
    (routes, route number, edge, alpha, x, y, d, mass). Route 0 stays on the edge; what a position hasn't has no mass."""
    reach = NEAR * model.gps_sd
    ga, gx, gy, gd = net.grid(e)
    routes, number, edge, fa, fx, fy, fd = net.fan(e, d_max, cutoff)
    own = np.flatnonzero((np.abs(gx - ox) <= reach) & (np.abs(gy - oy) <= reach))
    off = np.flatnonzero((np.abs(fx - ox) <= reach) & (np.abs(fy - oy) <= reach))
    ahead = (ga >= alpha[:, None] - 1e-12).sum(1)
    first = np.where(ahead > 0, gd[ahead - 1], 0.0) if len(gd) else np.zeros(len(alpha))
    rest = (1 - alpha) * net.length[e]
    d = np.concatenate([gd[own] - first[:, None], fd[off] + rest[:, None]], 1)
    has = np.concatenate([own < ahead[:, None], np.broadcast_to((rest <= d_max)[:, None], (len(alpha), len(off)))], 1) & (d < d_max + ZERO)
    d = np.where(has, d, 0.0)
    x, y = np.concatenate([gx[own], fx[off]]), np.concatenate([gy[own], fy[off]])
    mass = np.where(has, model.prior_values(d, dt) * model.deviation_values(px[:, None], py[:, None], x, y, d) * model.likelihood_values(x, y, ox, oy), 0.0)
    none = np.zeros(len(own), int)
    return routes, np.concatenate([none, number[off].astype(int) + 1]), np.concatenate([none + e, edge[off].astype(int)]), np.concatenate([ga[own], fa[off]]), x, y, d, mass


def _crowds(mass, d, total, far: float, crowded):
    return (mass * (d > crowded[0] * far)).sum(-1) > crowded[1] * total


def propose(net: Network, model, step: Step, ox: float, oy: float, dt: float, rng, d_max=None, cutoff=None, multiplier: float = 1.5, crowded=(0.9, 0.1), gradients: bool = False) -> Step:
    """The optimal proposal for all particles; weight is p(observation | particle), 0 if none fits.
    Sets step.z, and step.slopes if gradients are asked for."""
    n = len(step.edge)
    d_max, cutoff = _limits(model, dt, d_max, cutoff)
    new = Step(np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.empty(n, object), dt, np.zeros(n))
    step.z, step.slopes = np.zeros(n), np.zeros((n, 3)) if gradients else None
    order, begin = _positions(step, np.arange(n))
    z = _set_sums(net, model, step, order, begin, dt, d_max, cutoff, gradients)
    end = np.append(begin[1:], n)
    heads = order[begin]
    edges = step.edge[heads]
    # The bound on what is left out holds for the Gaussian noise only.
    gaussian = type(model).likelihood_values is MapMatchingModel.likelihood_values
    runs = np.flatnonzero(np.concatenate([[True], edges[1:] != edges[:-1]]))
    for lo, hi in zip(runs.tolist(), np.append(runs[1:], len(edges)).tolist()):
        e, at = int(edges[lo]), heads[lo:hi]
        alpha, px, py = step.alpha[at], step.x[at], step.y[at]
        whole = {}  # positions that need all candidates, with the second look of those that crowd at d_max
        if gaussian:
            routes, number, edge, to, x, y, d, mass = _near(net, model, e, alpha, px, py, ox, oy, dt, d_max, cutoff)
            total = mass.sum(1)
            few = ~(total * NOTHING > z[lo:hi] * math.exp(-0.5 * NEAR**2)) | _crowds(mass, d, total, d_max, crowded)
        else:
            total, few = np.zeros(hi - lo), np.ones(hi - lo, bool)
        share = total / np.where(z[lo:hi] > 0, z[lo:hi], 1.0)
        for i in np.flatnonzero(few).tolist():
            whole[i] = _all_candidates(net, model, e, float(alpha[i]), px[i], py[i], ox, oy, dt, d_max, cutoff, multiplier, crowded)
            total[i], share[i] = whole[i][-2:]
        fits = total > FLOOR
        rows = order[begin[lo] : end[hi - 1]]
        which = np.repeat(np.arange(hi - lo), end[lo:hi] - begin[lo:hi])
        lost = ~fits[which]
        if lost.any():
            r = rows[lost]
            new.route[r], new.edge[r], new.alpha[r], new.x[r], new.y[r] = _routes([(e,)] * len(r)), e, alpha[which[lost]], px[which[lost]], py[which[lost]]
            rows, which = rows[~lost], which[~lost]
        chance = rng.random(len(rows))
        fast = ~few[which]
        if fast.any():
            r, w = rows[fast], which[fast]
            cdf = np.cumsum(mass, 1)[w]
            c = np.minimum((cdf <= (chance[fast] * cdf[:, -1])[:, None]).sum(1), mass.shape[1] - 1)
            new.edge[r], new.alpha[r], new.x[r], new.y[r], new.d[r] = edge[c], to[c], x[c], y[c], d[w, c]
            new.route[r] = _routes([routes[k - 1] if k else (e,) for k in number[c].tolist()])
        for i in np.unique(which[~fast]).tolist():
            r = rows[which == i]
            (paths, number1, edge1, to1, x1, y1, d1), mass1, _, _ = whole[i]
            cdf = np.cumsum(mass1)
            c = np.minimum(np.searchsorted(cdf, chance[which == i] * cdf[-1], "right"), len(mass1) - 1)
            new.edge[r], new.alpha[r], new.x[r], new.y[r], new.d[r] = edge1[c], to1[c], x1[c], y1[c], d1[c]
            new.route[r] = _routes([paths[k] for k in number1[c]])
        new.weight[rows] = share[which]
    return new


def _all_candidates(net, model, e, alpha, px, py, ox, oy, dt, d_max, cutoff, multiplier, crowded):
    """(candidates, masses, their sum, and its part of the prior's sum) of a position, once more with a larger d_max if they crowd there."""
    far = d_max
    for again in (False, True):
        found = net.candidates(e, alpha, far, cutoff)
        x, y, d = found[4:]
        prior = model.prior_values(d, dt) * model.deviation_values(px, py, x, y, d)
        mass = prior * model.likelihood_values(x, y, ox, oy)
        total = mass.sum()
        if again or total <= FLOOR or not (_crowds(mass, d, total, far, crowded) and d.max() > crowded[0] * far):
            break
        far = d_max * multiplier
    return found, mass, total, total / prior.sum() if total > FLOOR else 0.0


def normalise(net, model, step: Step, rows: np.ndarray, dt: float, d_max=None, cutoff=None, gradients: bool = False, **_) -> None:
    """Sets step.z, and step.slopes if gradients are asked for, of the rows."""
    n = len(step.edge)
    step.z = np.zeros(n) if step.z is None else step.z
    step.slopes = np.zeros((n, 3)) if gradients and step.slopes is None else step.slopes
    d_max, cutoff = _limits(model, dt, d_max, cutoff)
    if len(rows):
        _set_sums(net, model, step, *_positions(step, rows), dt, d_max, cutoff, gradients)


def proposed(net, model, step: Step, ox, oy, dt, rng, proposal: Callable, how: dict) -> Step:
    """What the proposal gives; normalisers that it doesn't set itself are added."""
    new = proposal(net, model, step, ox, oy, dt, rng, **how)
    if step.z is None or (how.get("gradients") and step.slopes is None):
        normalise(net, model, step, np.arange(len(step.edge)), dt, **how)
    return new


def advance(net, model, step: Step, ox, oy, dt, rng, threshold: float = 1.0, proposal: Callable = propose, **how) -> tuple[Step, float]:
    """One step of the filter: resample if the effective size is under threshold * n, propose, weigh. The step
    given stays as it was but for its z. Failing particles keep weight 0; all failing ends the match.

    A `proposal` of one's own takes what `propose` takes and gives the particles' next places, each with the weight
    prior * likelihood / proposal's density; it may set step.z, the prior's sums, if it has them anyway.
    """
    n = len(step.edge)
    if ess(step.weight) < threshold * n - 1e-9:
        parents = draw(rng, step.weight, n)
        base = step.take(parents)
        probe = proposed(net, model, base, ox, oy, dt, rng, proposal, how)
        step.z, step.slopes = np.zeros(n), None if base.slopes is None else np.zeros((n, 3))
        step.z[parents] = base.z
        if base.slopes is not None:
            step.slopes[parents] = base.slopes
        # Ancestors that weren't drawn need their normalisers as well.
        left = np.ones(n, bool)
        left[parents] = False
        normalise(net, model, step, np.flatnonzero(left), dt, **how)
        weight = probe.weight
    else:
        probe = proposed(net, model, step, ox, oy, dt, rng, proposal, how)
        weight = probe.weight * step.weight
    if not weight.sum() > 0:
        raise MatchFailed("FAILED_ZERO_WEIGHT")
    probe.weight = weight / weight.sum()
    return probe, ess(probe.weight)


def backward(net, model, steps: list[Step], rng) -> list[Step]:
    """Backward simulation: trajectories drawn from the filter's steps, as unweighted steps."""
    n = len(steps[-1].edge)
    last = steps[-1].take(draw(rng, steps[-1].weight, n))
    out = [last]
    for t in range(len(steps) - 2, -1, -1):
        now, nxt = steps[t], out[0]
        base = np.where(now.z > ZERO, now.weight / np.maximum(now.z, FLOOR), 0.0)
        chosen = np.zeros(n, int)
        d_new = np.zeros(n)
        ok = np.zeros(n, bool)
        starts = np.array([r[0] for r in nxt.route])
        single = np.array([len(r) == 1 for r in nxt.route])
        alpha0 = np.array([_start_alpha(net, nxt, j) for j in range(n)])
        uniform = rng.random(n)
        for e in np.unique(starts).tolist():
            k = np.flatnonzero((now.edge == e) & (base > 0))
            if not len(k):
                continue
            own = np.flatnonzero(starts == e)
            d = nxt.d[own, None] + np.round((alpha0[own, None] - now.alpha[None, k]) * net.length[e], 5)
            fits = (d >= -ZERO) & (~single[own, None] | (now.alpha[None, k] <= nxt.alpha[own, None] + OVERTAKE))
            d = np.maximum(d, 0.0)
            w = base[None, k] * model.prior_values(d, nxt.dt) * model.deviation_values(now.x[None, k], now.y[None, k], nxt.x[own, None], nxt.y[own, None], d)
            c, good = _draw_rows(np.where(fits, w, 0.0), uniform[own])
            chosen[own], d_new[own], ok[own] = k[c], d[np.arange(len(own)), c], good
        if not ok.any():
            raise MatchFailed("FAILED_BACKWARD")
        if not ok.all():  # a failed trajectory becomes a copy of a good one
            good = np.flatnonzero(ok)
            source = good[draw(rng, np.ones(len(good)), int((~ok).sum()))]
            idx = np.arange(n)
            idx[~ok] = source
            out = [s.take(idx) for s in out]
            chosen, d_new, nxt = chosen[idx], d_new[idx], out[0]
        out[0].d = d_new
        out.insert(0, now.take(chosen))
    for s in out:
        s.weight = np.full(n, 1.0 / n)
    return out


def _start_alpha(net, step: Step, j: int) -> float:
    """Where on its first edge a particle's last route began."""
    route, d = step.route[j], step.d[j]
    if len(route) == 1:
        return step.alpha[j] - d / net.length[route[0]]
    passed = (net.length[list(route[1:-1])].sum() if len(route) > 2 else 0.0) + step.alpha[j] * net.length[route[-1]]
    return 1 - (d - passed) / net.length[route[0]]


def stitch(net, model, fixed: Step, new: list[Step], weights: np.ndarray, rng, z_power: float = -1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fixed particle a new trajectory that starts on its edge: (rows of fixed, rows of new, first distances).

    new[0] holds where new trajectories start and new[1] the step after. A trajectory's own first
    step is divided out of its weight; z_power is the normaliser's exponent beside it.
    """
    n = len(fixed.edge)
    first, after = new[0], new[1]
    own = model.prior_values(after.d, after.dt) * model.deviation_values(first.x, first.y, after.x, after.y, after.d)
    z = first.z if first.z is not None else np.ones(len(weights))
    bottom = own * np.power(np.maximum(z, FLOOR), -z_power)
    adjusted = np.where((bottom > LEAST_PRIOR) & (z > LEAST_PRIOR), weights / np.maximum(bottom, FLOOR), 0.0)
    adjusted = adjusted / adjusted.sum() if adjusted.sum() > 0 else adjusted
    pick, dist, ok = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
    single = np.array([len(r) == 1 for r in after.route])
    uniform = rng.random(n)
    for e in np.unique(fixed.edge).tolist():
        k = np.flatnonzero(first.edge == e)
        if not len(k):
            continue
        own = np.flatnonzero(fixed.edge == e)
        d = after.d[None, k] + np.round((first.alpha[None, k] - fixed.alpha[own, None]) * net.length[e], 5)
        fits = (d >= -ZERO) & (~single[None, k] | (after.alpha[None, k] >= fixed.alpha[own, None] - OVERTAKE))
        d = np.maximum(d, 0.0)
        # Where no path that fits has a weight of its own, all of them count alike.
        weight = np.where(fits, adjusted[None, k], 0.0)
        weight = np.where(weight.sum(1, keepdims=True) > 0, weight, fits)
        w = weight * model.prior_values(d, after.dt) * model.deviation_values(fixed.x[own, None], fixed.y[own, None], after.x[None, k], after.y[None, k], d)
        c, good = _draw_rows(w, uniform[own])
        pick[own], dist[own], ok[own] = k[c], d[np.arange(len(own)), c], good
    idx = np.arange(n)
    if not ok.any():
        raise MatchFailed("FAILED_STITCH")
    if not ok.all():
        good = np.flatnonzero(ok)
        idx[~ok] = good[draw(rng, np.ones(len(good)), int((~ok).sum()))]
    return idx, pick[idx], dist[idx]


@dataclass
class Online:
    """What online matching keeps of a trajectory: the trajectories' steps of the last lag, the filter's
    steps of the window, and how many observations came."""

    track: list[Step]
    window: list[Step]
    seen: int = 1
    last_ess: float = 0.0


def start_online(net, model, ox, oy, n, rng, reach=None) -> Online:
    step = initiate(net, model, ox, oy, n, rng, reach)
    return Online([step], [step], 1, float(n))


def update(net, model, state: Online, ox, oy, dt, rng, mode: str = "BSi", lag: int | None = 3, threshold: float = 1.0, keep: bool = True, proposal: Callable = propose, past: list | None = None, **how) -> Online:
    """One observation more. `PF`, or lag 0, stitches the filter's own trajectories, `BSi` those of backward
    simulation over the last lag + 1 observations. With keep False steps before the lag are let go;
    a list `past` is told what goes, for `whole` to give all steps without taking each of them again by every observation."""
    if mode not in ("PF", "BSi"):
        raise ValueError(f"update must be PF or BSi, not {mode}")
    if mode == "PF" or lag == 0:
        return _update_filter(net, model, state, ox, oy, dt, rng, lag, keep, proposal, past, how)
    new, size = advance(net, model, state.window[-1], ox, oy, dt, rng, threshold, proposal, **how)
    window = [*state.window, new][-(lag + 1) :]
    drawn = backward(net, model, window, rng)
    seen = state.seen + 1
    if seen <= lag + 1:
        return Online(drawn, window, seen, size)
    # The trajectories up to the window's first observation are fixed; what follows is drawn anew.
    fixed = state.track[: len(state.track) - lag + 1]
    idx, pick, dist = stitch(net, model, fixed[-1], drawn, np.full(len(new.edge), 1.0 / len(new.edge)), rng)
    return Online(_joined(fixed, drawn, idx, pick, dist, lag, keep, past), window, seen, size)


def _joined(fixed, drawn, idx, pick, dist, lag, keep, past) -> list[Step]:
    tail = [s.take(pick) for s in drawn[1:]]
    if tail:
        tail[0].d = dist
        starts = fixed[-1].take(idx)
        head = [s.take(idx) for s in fixed[:-1]] + [starts]
    else:
        head = [s.take(idx) for s in fixed]
    track = head + tail
    if past is not None:
        past.append((track[: -(lag + 1)], idx))
    return track if keep and past is None else track[-(lag + 1) :]


def whole(state: Online, past: list) -> list[Step]:
    """All steps of trajectories whose steps before the lag went to `past`, each with the rows that were taken since."""
    rows, out = np.arange(len(state.track[-1].edge)), []
    for gone, idx in reversed(past):
        out = [s.take(rows) for s in gone] + out
        rows = idx[rows]
    return out + state.track


def _update_filter(net, model, state: Online, ox, oy, dt, rng, lag, keep, proposal, past, how) -> Online:
    last = state.track[-1]
    new = proposed(net, model, last, ox, oy, dt, rng, proposal, how)
    if not new.weight.sum() > 0:
        raise MatchFailed("FAILED_ZERO_WEIGHT")
    weight = new.weight / new.weight.sum()
    new.weight = np.full(len(weight), 1.0 / len(weight))
    track, seen = [*state.track, new], state.seen + 1
    if lag is None or seen <= lag + 1 or lag == 0:
        i = draw(rng, weight, len(weight))
        return Online([s.take(i) for s in track], [new], seen, ess(weight))
    cut = len(track) - lag - 1
    fixed, fresh = track[: cut + 1], track[cut:]
    idx, pick, dist = stitch(net, model, fixed[-1], fresh, weight, rng)
    return Online(_joined(fixed, fresh, idx, pick, dist, lag, keep, past), [new], seen, ess(weight))
