"""The numpy engine against exact smoothing on a small lattice, and its invariants."""

from dataclasses import dataclass

import numpy as np
import pytest

from pathloom.functions.model import ZERO, ExponentialMapMatchingModel
from pathloom.plans import engine

MODEL = ExponentialMapMatchingModel(gps_sd=15.0, max_speed=12.0)
OBS, DT, REACH = [(20, 5), (75, -4), (110, 40), (95, 90)], 15.0, 75.0


def lattice(size=3):
    at = lambda i: (100.0 * (i % size), 100.0 * (i // size))
    out = []
    for i in range(size * size):
        r, c = divmod(i, size)
        if c < size - 1:
            out += [(i, i + 1, 0, [at(i), at(i + 1)]), (i + 1, i, 0, [at(i + 1), at(i)])]
            if (r + c) % 7 == 0:
                out.append((i, i + 1, 1, [at(i), (at(i)[0] + 50, at(i)[1] + 20), at(i + 1)]))
        if r < size - 1:
            out += [(i, i + size, 0, [at(i), at(i + size)]), (i + size, i, 0, [at(i + size), at(i)])]
    return engine.Network(*zip(*out), refine=20.0)


@pytest.fixture(scope="module")
def exact():
    return exact_for(MODEL)


def exact_for(model):
    """Marginals of edges at each observation, by the forward and backward sums over all places."""
    net = lattice()
    states = [(e, a, x, y) for e in range(len(net.edges)) for a, x, y in zip(*net.grid(e)[:3])]
    index = {(e, round(a, 9)): i for i, (e, a, _, _) in enumerate(states)}
    move = np.zeros((len(states),) * 2)
    for i, (e, a, x, y) in enumerate(states):
        _, _, edge, alpha, xx, yy, d = net.candidates(e, a, model.max_speed * DT, 10)
        prior = model.prior_values(d, DT) * model.deviation_values(x, y, xx, yy, d)
        for e2, a2, p in zip(edge, alpha, prior / prior.sum()):
            move[i, index[e2, round(a2, 9)]] += p
    like = [np.array([float(model.likelihood_values(x, y, *o)) for _, _, x, y in states]) for o in OBS]
    near = np.array([np.hypot(x - OBS[0][0], y - OBS[0][1]) < REACH for _, _, x, y in states])
    ahead = [like[0] * near]
    for lk in like[1:]:
        ahead.append((ahead[-1] / ahead[-1].sum()) @ move * lk)
    back = [np.ones(len(states))]
    for lk in like[:0:-1]:
        back.insert(0, move @ (lk * back[0]))
    edges = np.array([s[0] for s in states])
    both = [a * b / (a * b).sum() for a, b in zip(ahead, back)]
    return net, [np.bincount(edges, p, len(net.edges)) for p in both]


def distance(runs, exact_shares, net):
    """The largest total variation over observations between edges drawn and their exact shares."""
    worst = 0.0
    for t, want in enumerate(exact_shares):
        got = sum(np.bincount(track[t].edge, minlength=len(net.edges)) for track in runs)
        worst = max(worst, 0.5 * np.abs(got / got.sum() - want).sum())
    return worst


def test_offline_smoothing_is_the_posterior(exact):
    net, want = exact
    runs = []
    for rep in range(40):
        rng = engine.generator("offline", rep)
        steps = [engine.initiate(net, MODEL, *OBS[0], 300, rng, REACH)]
        for o in OBS[1:]:
            steps.append(engine.advance(net, MODEL, steps[-1], *o, DT, rng)[0])
        runs.append(engine.backward(net, MODEL, steps, rng))
    assert distance(runs, want, net) < 0.06


@pytest.mark.parametrize(("mode", "lag", "most"), [("BSi", 3, 0.06), ("PF", 3, 0.06), ("PF", None, 0.06), ("PF", 0, 0.08), ("BSi", 2, 0.15)])
def test_online_smoothing_is_near_the_posterior(exact, mode, lag, most):
    net, want = exact
    runs = []
    for rep in range(40):
        rng = engine.generator(mode, lag, rep)
        state = engine.start_online(net, MODEL, *OBS[0], 300, rng, REACH)
        for o in OBS[1:]:
            state = engine.update(net, MODEL, state, *o, DT, rng, mode, lag)
        runs.append(state.track)
    assert distance(runs, want, net) < most


def test_paths_hold_together():
    net = lattice()
    rng = engine.generator("paths")
    state = engine.start_online(net, MODEL, *OBS[0], 50, rng, REACH)
    for o in OBS[1:]:
        state = engine.update(net, MODEL, state, *o, DT, rng, "BSi", 2)
    for before, now in zip(state.track[:-1], state.track[1:]):
        for j in range(50):
            route = now.route[j]
            assert route[0] == before.edge[j] and route[-1] == now.edge[j]
            assert len(set(route)) == len(route)
            assert all(net.edges[a][1] == net.edges[b][0] for a, b in zip(route, route[1:]))
            passed = net.length[list(route[1:-1])].sum()
            d = (now.alpha[j] - before.alpha[j]) * net.length[route[0]] if len(route) == 1 else (1 - before.alpha[j]) * net.length[route[0]] + passed + now.alpha[j] * net.length[route[-1]]
            assert now.d[j] == pytest.approx(d, abs=1e-3)


def test_draws_follow_the_weights():
    weights = np.arange(1, 11) / 55
    got = np.bincount(engine.draw(engine.generator(1), weights, 100_000), minlength=10) / 100_000
    assert np.abs(got - weights).max() < 0.01
    assert set(engine.draw(engine.generator(2), np.eye(10)[3], 50)) == {3}


def test_failures_have_a_status():
    net = lattice()
    with pytest.raises(engine.MatchFailed, match="FAILED_NO_EDGES"):
        engine.initiate(net, MODEL, 9e9, 0, 5, engine.generator(0))
    step = engine.initiate(net, MODEL, *OBS[0], 5, engine.generator(0), REACH)
    with pytest.raises(engine.MatchFailed, match="FAILED_ZERO_WEIGHT"):
        engine.advance(net, MODEL, step, 9e9, 0, DT, engine.generator(0))
    with pytest.raises(ValueError):
        engine.update(net, MODEL, engine.Online([step], [step]), 0, 0, DT, engine.generator(0), "other")


@dataclass(frozen=True)
class SteadySpeed(ExponentialMapMatchingModel):
    """Another law: speeds are near five metres a second."""

    def prior_values(self, d, dt):
        return np.where(d > ZERO, np.exp(-0.5 * (d / dt - 5.0) ** 2), 1e-3)


def smoothed(net, model, name, **how):
    runs = []
    for rep in range(40):
        rng = engine.generator(name, rep)
        steps = [engine.initiate(net, model, *OBS[0], 300, rng, REACH)]
        for o in OBS[1:]:
            steps.append(engine.advance(net, model, steps[-1], *o, DT, rng, **how)[0])
        runs.append(engine.backward(net, model, steps, rng))
    return runs


def test_a_models_own_law_decides_the_posterior(exact):
    model = SteadySpeed(gps_sd=60.0, max_speed=12.0)
    net, want = exact_for(model)
    runs = smoothed(net, model, "law")
    assert distance(runs, want, net) < 0.06
    assert distance(runs, exact_for(ExponentialMapMatchingModel(gps_sd=60.0, max_speed=12.0))[1], net) > 0.1


def bootstrap(net, model, step, ox, oy, dt, rng, **how):
    """Draws from the prior alone and weighs by the likelihood; sets no normalisers."""
    n = len(step.edge)
    places, routes, weight = np.zeros((n, 5)), np.empty(n, object), np.zeros(n)
    for i in range(n):
        all_routes, number, edge, alpha, x, y, d = net.candidates(int(step.edge[i]), step.alpha[i], model.max_speed * dt, 10)
        c = engine.draw(rng, model.prior_values(d, dt) * model.deviation_values(step.x[i], step.y[i], x, y, d), 1)[0]
        places[i], routes[i], weight[i] = (edge[c], alpha[c], x[c], y[c], d[c]), all_routes[number[c]], model.likelihood_values(x[c], y[c], ox, oy)
    return engine.Step(places[:, 0].astype(int), *places[:, 1:].T, routes, dt, weight)


def test_a_proposal_of_ones_own_gives_the_same_posterior():
    model = ExponentialMapMatchingModel(gps_sd=40.0, max_speed=12.0)
    net, want = exact_for(model)
    runs = smoothed(net, model, "bootstrap", proposal=bootstrap)
    assert distance(runs, want, net) < 0.1


def test_online_takes_a_proposal_of_ones_own():
    net, calls = lattice(), []

    def counted(*args, **how):
        calls.append(1)
        return engine.propose(*args, **how)

    for mode in ("PF", "BSi"):
        states = []
        for proposal in (engine.propose, counted):
            rng = engine.generator(mode)
            state = engine.start_online(net, MODEL, *OBS[0], 50, rng, REACH)
            for o in OBS[1:]:
                state = engine.update(net, MODEL, state, *o, DT, rng, mode, 2, proposal=proposal)
            states.append(state)
        assert all((a.edge == b.edge).all() and (a.alpha == b.alpha).all() for a, b in zip(states[0].track, states[1].track))
    assert len(calls) == 2 * (len(OBS) - 1)
