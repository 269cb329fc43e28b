"""Every query of the catalog that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from pathloom.plans import catalog

SF = "/root/testdata/sf0.001"
#: The rest is compared by the driver; these cover each module once in the test suite.
NAMES = ("s1_edge_table", "p3_edge_grid", "p15_distance_prior", "s8_observations", "p16_distance_prior_gradient", "j3_edges_within_radius", "g7_initial_weights", "g7_initial_particles", "g1_possible_routes", "g5_proposal_totals", "g4_extended_routes", "g6_proposed_particles", "a4_far_mass", "a5_gradient_totals", "q_retried_particles", "j9_resampled_particles", "j10_never_resampled", "p4_utm", "s2_edge_geometry", "g8_multinomial", "g9_backward_weights", "g12_stitch_weights", "p7_route_nodes", "p9_densified_paths", "a15_total_variation", "a16_interval_total_variation")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("events", "supplier"):
        connection.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    relation = duck.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    want = sorted(map(repr, relation.project(",".join(f'"{c}"' for c in columns)).fetchall()))
    assert got == want
    assert got
