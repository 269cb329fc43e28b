"""Queries that start from all edges, against plain Python on a small lattice and against the edges of the network."""

from collections import Counter
from types import SimpleNamespace

import pytest

from pathloom.plans import catalog
from pathloom.sources import network

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    nodes = network.lattice_nodes(spark).where("node_id in (0, 1, 2, 20, 21, 22, 40, 41, 42)")
    edges = network.lattice_edges(spark).where("u in (0, 1, 2, 20, 21, 22, 40, 41, 42) and v in (0, 1, 2, 20, 21, 22, 40, 41, 42)")
    return SimpleNamespace(table=network.edge_table(nodes, edges), edges=edges)


def brute(f, d_max, cutoff=10):
    """All routes as (edges, d_start, d_end)."""
    length = {(r.u, r.v, r.k): r.length for r in f.table.collect()}
    out, todo = [], [((e,), 0.0, 0.0, True) for e in length]
    while todo:
        path, start, end, is_open = todo.pop()
        out.append((path, round(start, 6), round(end, 6)))
        if is_open:
            u, v, k = path[-1]
            for e, add in length.items():
                if e[0] == v and not (e[1] == u and e[2] == k) and e not in path:
                    todo.append(((*path, e), end, min(end + add, d_max), end + add <= d_max and len(path) + 1 < cutoff))
    return out


def name(path):
    return ">".join("-".join(map(str, e)) for e in path)


def test_routes_from_all_edges(small):
    want = brute(small, 300.0)
    got = catalog.told(catalog.route_table(small, small.edges, 300.0)).collect()
    assert sorted((r.path, r.d_start, r.d_end) for r in got) == sorted((name(p), a, b) for p, a, b in want)
    full = Counter(p[0] for p, _, b in want if b >= 300)
    assert {(r.su, r.sv, r.sk): r.n for r in catalog.full_length(small, 300.0).collect()} == full
    firsts = {p for p, _, b in want if b >= 300}
    more = [(name(p), a, b) for p, a, b in brute(small, 400.0) if any(p[:n] in firsts for n in range(1, len(p) + 1))]
    assert sorted((r.path, r.d_start, r.d_end) for r in catalog.longer(small, 300.0, 100.0).collect()) == sorted(more)


def test_queries_start_from_every_edge(spark):
    edges = {(r.u, r.v, r.k) for r in network.lattice_edges(spark).collect()}
    assert {(r.u, r.v, r.k) for r in catalog.QUERIES["s2_edge_geometry"](spark, SF).collect()} == edges
    whole = catalog.QUERIES["g1_possible_routes"](spark, SF).select("su", "sv", "sk", "d_end").collect()
    assert {(r.su, r.sv, r.sk) for r in whole} == edges
    full = catalog.QUERIES["g1_full_length_routes"](spark, SF).collect()
    assert {(r.su, r.sv, r.sk): r.n for r in full} == Counter((r.su, r.sv, r.sk) for r in whole if r.d_end >= 300)
