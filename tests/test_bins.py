"""Places must equal SQL's to the last bit, as bins are cut where places lie."""

import duckdb

from pathloom.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def test_grid_equals_sql_bit_by_bit(spark):
    columns = ["u", "v", "k", "grid_idx", "dist", "alpha", "x", "y"]
    got = sorted(tuple(r) for r in fixtures.fixture(spark, SF).grid.select(*columns).collect())
    connection = duckdb.connect()
    connection.sql(f"create view events as select * from '{SF}/events.parquet'")
    want = sorted(connection.sql(f"WITH {fixtures.SQL} SELECT {', '.join(columns)} FROM grid").fetchall())
    assert got == want


def test_total_variation_of_places_on_bent_edges(spark, tmp_path):
    # A first sample whose lowest place is the end of a bent edge; 15 m further on lies a place on a bin's border.
    users = 1500
    copies = f"select * replace (user_id + i * {users} as user_id, event_id + i * 100000 as event_id) from '/root/testdata/sf0.1/events.parquet', range(6) r(i) where user_id + i * {users} in (3629, 4873, 6373, 8923)"
    connection = duckdb.connect()
    connection.sql(f"copy ({copies}) to '{tmp_path}/events.parquet'")
    connection.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["a15_total_variation"](spark, str(tmp_path)).select("traj_id", "tv").collect())
    assert got == sorted(connection.sql(catalog.ORACLES["a15_total_variation"]).project("traj_id, tv").fetchall())
    assert len(got) == 4
