"""The proposal by position: the same draws as rows of candidates, without a row for each of them."""

import numpy as np
import pytest

from pathloom.operators import proposal
from pathloom.plans import catalog, engine, fixtures, proposing
from pathloom.sources import network

SF = "/root/testdata/sf0.001"
COLUMNS = ["traj_id", "particle_id", "u", "v", "k", "grid_idx", "route_id"]


@pytest.fixture(scope="module")
def by_rows(spark):
    f = fixtures.fixture(spark, SF)
    rows = proposal.proposed(catalog.proposal_rows(f), 17)
    return sorted(tuple(r) for r in rows.select(*COLUMNS).collect())


def test_draws_equal_those_among_rows(spark, by_rows):
    f = fixtures.fixture(spark, SF)
    particles, later = catalog.steps_held(f)
    got = proposing.proposed(particles, later, f.table, f.grid, fixtures.MODEL, catalog.DT, 300.0, fixtures.REFINE, 17)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == by_rows
    assert len(by_rows) > 2000


def test_nothing_is_left_out(spark, monkeypatch):
    # Near candidates first, as always; all of them; and so few near ones that most draws need all.
    edges = network.collected(fixtures.fixture(spark, SF).table)
    net = engine.Network(edges["u"], edges["v"], edges["k"], edges["geom"], fixtures.REFINE)
    rng = np.random.default_rng(3)
    for e in (0, 700, 1400):
        s = proposing.Starts(net, e, 300.0, 10)
        spot = s.own & (s.place == 7)
        alpha, px, py = s.alpha[spot][0], s.x[spot][0], s.y[spot][0]
        ox, oy, chance = px + rng.normal(0, 80, 300), py + rng.normal(0, 80, 300), rng.random(300)
        chance[:3] = 0.0
        drawn = []
        for near, nothing, cells in ((12.0, 1e-18, 1 << 20), (12.0, 0.0, 50), (1.0, 1e-18, 1 << 20)):
            for name, value in (("NEAR", near), ("NOTHING", nothing), ("CELLS", cells)):
                monkeypatch.setattr(proposing, name, value)
            drawn.append(proposing.draw_position(fixtures.MODEL, s, alpha, net.length[e], px, py, ox, oy, chance, 15.0, 300.0, fixtures.REFINE)[0].tolist())
        assert drawn[0] == drawn[1] == drawn[2]
        assert len(set(drawn[0])) > 50


def test_large_networks_are_joined(spark, by_rows):
    f = fixtures.fixture(spark, SF)
    particles, later = catalog.steps_held(f)
    got = proposing.proposed(particles, later, f.table, f.grid, fixtures.MODEL, catalog.DT, 300.0, fixtures.REFINE, 17, most=10)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == by_rows


def test_no_row_for_each_candidate(spark):
    plan = catalog.QUERIES["g6_proposed_particles"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert "route_id" not in plan.split("MapInArrow")[1].split("\n", 1)[1]


def test_mass_far_away_counts_where_nothing_is_near():
    # One place 300 m from the observation's: its likelihood is the only one, and it is drawn.
    class Law:
        gps_sd = 10.0
        prior_values = staticmethod(lambda d, dt: np.ones(len(d)))
        deviation_values = staticmethod(lambda px, py, x, y, d: np.ones(len(d)))
        likelihood_values = staticmethod(lambda x, y, ox, oy: np.exp(-0.5 * ((x - ox) ** 2 + (y - oy) ** 2) / 100))

    s = proposing.Starts.__new__(proposing.Starts)
    s.alpha, s.x, s.y, s.dist = np.array([1.0, 0.5]), np.array([100.0, 50.0]), np.zeros(2), np.array([100.0, 50.0])
    s.start, s.own = np.zeros(2), np.array([True, True])
    c, _ = proposing.draw_position(Law, s, 0.5, 100.0, 50.0, 0.0, np.array([400.0, 100.0]), np.zeros(2), np.array([0.5, 0.0]), 15.0, 300.0, 50.0)
    assert c.tolist() == [0, 0]
