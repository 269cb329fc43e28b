"""Matches must use all cores, and take each step a bounded number of times."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pathloom.plans import catalog, engine, fixtures, matching
from pathloom.sources import network

SF = "/root/testdata/sf0.001"


def test_trajectories_are_spread(spark):
    f = fixtures.fixture(spark, SF)
    out = matching.per_trajectory(catalog.timed(f), f.table, lambda net, pdf: pd.DataFrame({"traj_id": pdf["traj_id"].iloc[:1]}), "traj_id long", fixtures.REFINE, fixtures.MODEL)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def _track(net, update, past):
    taken, take = [0], engine.Step.take

    def counted(step, idx):
        taken[0] += 1
        return take(step, idx)

    engine.Step.take = counted
    try:
        state = None
        for i in range(60):
            rng = engine.generator(1, i)
            x, y = 100.0 + 20 * i, 3.0
            state = engine.start_online(net, fixtures.MODEL, x, y, 10, rng) if state is None else engine.update(net, fixtures.MODEL, state, x, y, 15.0, rng, update, 2, past=past)
        return (engine.whole(state, past) if past is not None else state.track), taken[0]
    finally:
        engine.Step.take = take


def test_steps_before_the_lag_are_taken_once(spark):
    edges = network.collected(fixtures.fixture(spark, SF).table)
    net = engine.Network(edges["u"], edges["v"], edges["k"], edges["geom"], fixtures.REFINE)
    for update in ("PF", "BSi"):
        (every, many), (lean, few) = _track(net, update, None), _track(net, update, [])
        assert len(every) == len(lean) == 60
        for a, b in zip(every, lean):
            assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("edge", "alpha", "x", "y", "d")) and a.route.tolist() == b.route.tolist()
        assert few < 60 * 14 < many


def test_near_candidates_give_the_same_as_all(spark, monkeypatch):
    edges = network.collected(fixtures.fixture(spark, SF).table)
    net = engine.Network(edges["u"], edges["v"], edges["k"], edges["geom"], fixtures.REFINE)
    found = []
    for nothing in (1e-18, 0.0):  # the second looks at all candidates of every position
        monkeypatch.setattr(engine, "NOTHING", nothing)
        step, rng = engine.initiate(net, fixtures.MODEL, 150.0, 103.0, 40, engine.generator(2)), engine.generator(3)
        steps = [step]
        for x in range(190, 900, 40):
            step, _ = engine.advance(net, fixtures.MODEL, step, float(x), 98.0, 15.0, rng)
            steps.append(step)
        found.append(steps)
    for a, b in zip(*found):
        assert a.edge.tolist() == b.edge.tolist() and a.route.tolist() == b.route.tolist()
        assert np.allclose(a.d, b.d) and np.allclose(a.weight, b.weight, rtol=1e-12)
