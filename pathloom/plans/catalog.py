"""The queries of the map-matching operators, and their equivalents in DuckDB's SQL.

Every query runs over all events (or the whole network), and those that propose particles over
every transition of every trajectory. Doubles are compared at six decimals, as engines add in
different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import draws, geometry
from pathloom.operators import analytics, candidates, paths, proposal, resampling, routes
from pathloom.plans import fixtures, matching, proposing
from pathloom.plans.fixtures import MODEL, SQL, SQL_NEAR, fixture
from pathloom.sources import network, trips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EDGE = network.EDGE


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def plain(table: DataFrame) -> DataFrame:
    """Edges with first and last points in place of the geometry."""
    first, last = F.col("geom")[0], F.element_at("geom", -1)
    return table.select(*EDGE, r6("length").alias("length"), F.size("geom").alias("n_points"), r6(first["x"]).alias("x0"), r6(first["y"]).alias("y0"), r6(last["x"]).alias("x1"), r6(last["y"]).alias("y1"))


PLAIN_SQL = "SELECT u, v, k, round(length, 6) + 0.0::DOUBLE AS length, CASE WHEN bent THEN 3 ELSE 2 END AS n_points, ux AS x0, uy AS y0, vx AS x1, vy AS y1 FROM et"


def w(sql: str, near: bool = False) -> str:
    return f"WITH {SQL_NEAR if near else SQL} {sql}"


# Sources and joins on the network ---------------------------------------------------------------------------------


@query("s1_edge_table", w(PLAIN_SQL))
def s1(spark, sf_dir):
    return plain(fixture(spark, sf_dir).table)


@query("s2_edge_geometry", w(PLAIN_SQL))
def s2(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return plain(network.edge_geometry(f.table, f.edges.select(*EDGE)))


@query("s3_edge_lengths_of_candidates", w("SELECT u, v, k, count(*) AS n, round(sum(length), 6) AS total FROM near_edge_ok JOIN et USING (u, v, k) GROUP BY ALL", True))
def s3(spark, sf_dir):
    f = fixture(spark, sf_dir)
    near = candidates.edges_within(f.obs, f.table, 5 * MODEL.gps_sd)
    return near.join(f.table.select(*EDGE, "length"), EDGE).groupBy(*EDGE).agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("total"))


@query("s4_adjacency", w("SELECT a.u, a.v, a.k, b.u AS nu, b.v AS nv, b.k AS nk FROM links a JOIN links b ON a.v = b.u"))
def s4(spark, sf_dir):
    return network.adjacency(fixture(spark, sf_dir).table)


@query("s8_observations", w("SELECT traj_id, obs_idx, t, x, y FROM obs"))
def s8(spark, sf_dir):
    return fixture(spark, sf_dir).obs


_POSITIONS = "SELECT i AS draw, CAST(floor(CAST(('0x' || substr(md5(concat_ws('|', '5', 'edge', i)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) * 1481) AS INT) AS e, CAST(('0x' || substr(md5(concat_ws('|', '5', 'alpha', i)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS alpha FROM range(500) q(i)"


@query("s9_random_positions", w(f"SELECT draw, u, v, k, round(alpha, 6) AS alpha FROM ({_POSITIONS}) p JOIN (SELECT u, v, k, row_number() OVER (ORDER BY u, v, k) - 1 AS e FROM links) n USING (e)"))
def s9(spark, sf_dir):
    return rounded(candidates.random_positions(fixture(spark, sf_dir).table, 500, 5), "alpha")


# Projections -------------------------------------------------------------------------------------------------------


@query("p1_edge_interpolate", w("""SELECT u, v, k, a, round(CASE WHEN bent THEN ux + 100*p ELSE ux + p*(vx-ux) END, 6) + 0.0::DOUBLE AS x,
  round(CASE WHEN bent AND p <= 0.5 THEN uy + 40*p WHEN bent THEN uy + 40*(1-p) ELSE uy + p*(vy-uy) END, 6) + 0.0::DOUBLE AS y FROM (SELECT *, a / CAST(8 AS DOUBLE) AS p FROM et, range(9) g(a))"""))
def p1(spark, sf_dir):
    t = fixture(spark, sf_dir).table.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    t = t.withColumn("p", geometry.interpolate(F.col("geom"), F.col("a") / 8.0))
    return t.select(*EDGE, "a", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query("p2_grid_size", w("SELECT u, v, k, CAST(ceil((length - 0.1::DOUBLE) / 1) AS INT) AS n1, CAST(ceil((length - 0.7::DOUBLE) / 7) AS INT) AS n7 FROM et"))
def p2(spark, sf_dir):
    return fixture(spark, sf_dir).table.select(*EDGE, geometry.grid_size(F.col("length"), 1.0).alias("n1"), geometry.grid_size(F.col("length"), 7.0).alias("n7"))


@query("p3_edge_grid", w("SELECT u, v, k, grid_idx, round(dist, 6) AS dist, round(alpha, 6) AS alpha, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM grid"))
def p3(spark, sf_dir):
    return rounded(fixture(spark, sf_dir).grid, "dist", "alpha", "x", "y")


@query("p5_time_intervals", w("SELECT traj_id, obs_idx, t - lag(t) OVER (PARTITION BY traj_id ORDER BY obs_idx) AS dt, CASE WHEN obs_idx > 0 THEN 12.5::DOUBLE END AS fixed FROM obs"))
def p5(spark, sf_dir):
    obs = fixture(spark, sf_dir).obs
    both = trips.intervals(obs).withColumnRenamed("dt", "own")
    return trips.intervals(both, 12.5).select("traj_id", "obs_idx", F.col("own").alias("dt"), F.col("dt").alias("fixed"))


DT = 15.0
_P0 = "least(0.5::DOUBLE, greatest(0.01::DOUBLE, exp(-0.133::DOUBLE * dt)))"
_EVENT_D = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(event_id % 400 AS DOUBLE) END AS d, CAST(5 + event_id % 30 AS DOUBLE) AS dt FROM events"


def distances(spark, sf_dir) -> DataFrame:
    """A distance and an interval for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.when(F.col("event_id") % 5 == 0, 0.0).otherwise((F.col("event_id") % 400).cast("double")).alias("d"), (5 + F.col("event_id") % 30).cast("double").alias("dt"))


@query("p11_d_max", f"SELECT event_id, 20.0::DOUBLE * dt AS d_max FROM ({_EVENT_D})")
def p11(spark, sf_dir):
    return distances(spark, sf_dir).select("event_id", MODEL.d_max(F.col("dt")).alias("d_max"))


@query("p12_deviation_prior", w("SELECT traj_id, obs_idx, round(exp(-0.052::DOUBLE * abs(sqrt((x-px)*(x-px) + (y-py)*(y-py)) - 45)), 6) AS dev FROM (SELECT *, lag(x) OVER (PARTITION BY traj_id ORDER BY obs_idx) AS px, lag(y) OVER (PARTITION BY traj_id ORDER BY obs_idx) AS py FROM obs)"))
def p12(spark, sf_dir):
    order = W.partitionBy("traj_id").orderBy("obs_idx")
    obs = fixture(spark, sf_dir).obs.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order)})
    return obs.select("traj_id", "obs_idx", r6(MODEL.deviation_prior(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.lit(45.0))).alias("dev"))


@query("p13_likelihood", w("SELECT traj_id, obs_idx, u, v, k, grid_idx, round(lik, 6) AS lik, round(CASE WHEN dist_to_obs < 10 THEN lik ELSE 0 END, 6) AS truncated FROM lik", True))
def p13(spark, sf_dir):
    f = fixture(spark, sf_dir)
    cut = MODEL.with_parameters(likelihood_d_truncate=10.0)
    place = candidates.places_within(f.obs, f.table, f.grid, 5 * MODEL.gps_sd)
    args = [F.col(c) for c in ("x", "y", "ox", "oy")]
    return place.select("traj_id", "obs_idx", *EDGE, "grid_idx", r6(MODEL.likelihood(*args)).alias("lik"), r6(cut.likelihood(*args)).alias("truncated"))


@query("p14_zero_dist_prob", f"SELECT event_id, round({_P0}, 6) AS p0 FROM ({_EVENT_D})")
def p14(spark, sf_dir):
    return distances(spark, sf_dir).select("event_id", r6(MODEL.zero_dist_prob(F.col("dt"))).alias("p0"))


@query("p15_distance_prior", f"SELECT event_id, round(CASE WHEN d > 1e-5 THEN (1-{_P0}) * 0.068::DOUBLE * exp(-0.068::DOUBLE * d / dt) / dt ELSE {_P0} END, 8) AS prior FROM ({_EVENT_D})")
def p15(spark, sf_dir):
    return distances(spark, sf_dir).select("event_id", F.round(MODEL.distance_prior(F.col("d"), F.col("dt")), 8).alias("prior"))


@query("p16_distance_prior_gradient", f"SELECT event_id, round({_P0} * CASE WHEN d > 1e-5 THEN 0.068::DOUBLE * exp(-0.068::DOUBLE * d / dt) ELSE -dt END, 6) + 0.0::DOUBLE AS g_r0, round(CASE WHEN d > 1e-5 THEN (1-{_P0}) * exp(-0.068::DOUBLE * d / dt) / dt * (1 - 0.068::DOUBLE * d / dt) ELSE 0 END, 6) + 0.0::DOUBLE AS g_lambda FROM ({_EVENT_D})")
def p16(spark, sf_dir):
    g = MODEL.distance_prior_gradient(F.col("d"), F.col("dt"))
    return distances(spark, sf_dir).select("event_id", r6(g["zero_dist_prob_neg_exponent"]).alias("g_r0"), r6(g["lambda_speed"]).alias("g_lambda"))


@query("p17_p18_prior_bounds", f"SELECT event_id, round((1-{_P0}) * 0.068::DOUBLE / dt, 8) AS positive, round(greatest({_P0}, (1-{_P0}) * 0.068::DOUBLE / dt), 8) AS bound FROM ({_EVENT_D})")
def p17(spark, sf_dir):
    return distances(spark, sf_dir).select("event_id", F.round(MODEL.pos_distance_prior_bound(F.col("dt")), 8).alias("positive"), F.round(MODEL.distance_prior_bound(F.col("dt")), 8).alias("bound"))


@query("p19_rebased_distance", w("SELECT traj_id, obs_idx, particle_id, round((alpha - 0.25::DOUBLE) * length, 5) + 0.0::DOUBLE AS gain FROM particles JOIN et USING (u, v, k)", True))
def p19(spark, sf_dir):
    f = fixture(spark, sf_dir)
    rows = f.particles.join(f.table.select(*EDGE, "length"), EDGE)
    return rows.select("traj_id", "obs_idx", "particle_id", (paths.rebased(F.col("alpha"), F.lit(0.25), F.col("length")) + F.lit(0.0)).alias("gain"))


# Candidates --------------------------------------------------------------------------------------------------------


@query("j3_edges_within_radius", w("SELECT traj_id, obs_idx, u, v, k, round(distance_to_obs, 6) AS distance_to_obs FROM near_edge_ok", True))
def j3(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return rounded(candidates.edges_within(f.obs, f.table, 5 * MODEL.gps_sd), "distance_to_obs").select("traj_id", "obs_idx", *EDGE, "distance_to_obs")


@query("f2_places_within_radius", w("SELECT traj_id, obs_idx, u, v, k, grid_idx, round(dist_to_obs, 6) AS dist_to_obs FROM lik", True))
def f2(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return rounded(candidates.places_within(f.obs, f.table, f.grid, 5 * MODEL.gps_sd), "dist_to_obs").select("traj_id", "obs_idx", *EDGE, "grid_idx", "dist_to_obs")


@query("g7_initial_weights", w("SELECT traj_id, obs_idx, u, v, k, grid_idx, round(weight, 6) AS weight FROM weights", True))
def g7(spark, sf_dir):
    return rounded(fixture(spark, sf_dir).weights, "weight").select("traj_id", "obs_idx", *EDGE, "grid_idx", "weight")


@query("g7_initial_particles", w("SELECT traj_id, obs_idx, particle_id, u, v, k, grid_idx FROM particles", True))
def g7p(spark, sf_dir):
    return fixture(spark, sf_dir).particles.select("traj_id", "obs_idx", "particle_id", *EDGE, "grid_idx")


@query("a6_effective_size", w("SELECT traj_id, obs_idx, round(1 / sum(weight*weight), 6) AS ess, min(weight) = max(weight) AS all_equal, count(*) AS n, count(*) FILTER (weight > 0) AS good, sum(weight) <= 0 AS failed FROM weights GROUP BY ALL", True))
def a6(spark, sf_dir):
    return rounded(analytics.effective_size(fixture(spark, sf_dir).weights, ["traj_id", "obs_idx"]), "ess")


@query("a1_normalised_weights", w("SELECT traj_id, obs_idx, u, v, k, grid_idx, round(lik / sum(lik) OVER (PARTITION BY traj_id, obs_idx), 6) AS lik FROM lik", True))
def a1(spark, sf_dir):
    rows = fixture(spark, sf_dir).weights.drop("weight")
    return rounded(analytics.normalised(rows, ["traj_id", "obs_idx"], "lik"), "lik").select("traj_id", "obs_idx", *EDGE, "grid_idx", "lik")


@query("w5_categorical_draw", w("SELECT traj_id, obs_idx, draw, u, v, k, grid_idx, round(uni, 6) AS u01 FROM asked JOIN cdf USING (traj_id, obs_idx) WHERE uni >= (cdf - weight) / total AND uni < cdf / total", True))
def w5(spark, sf_dir):
    drawn = fixture(spark, sf_dir).particles
    u = draws.uniform(fixtures.SEED, F.col("traj_id"), F.col("obs_idx"), "init", F.col("particle_id"))
    return drawn.select("traj_id", "obs_idx", F.col("particle_id").alias("draw"), *EDGE, "grid_idx", r6(u).alias("u01"))


# Routes and the proposal -------------------------------------------------------------------------------------------

_ROUTES = """
starts AS (SELECT u, v, k FROM links WHERE {where}),
routes(su, sv, sk, u, v, k, path, d_start, d_end, n_rows, open) AS (
  SELECT u, v, k, u, v, k, u || '-' || v || '-' || k, 0.0::DOUBLE, 0.0::DOUBLE, 1, true FROM starts
  UNION ALL
  SELECT r.su, r.sv, r.sk, e.u, e.v, e.k, r.path || '>' || e.u || '-' || e.v || '-' || e.k, r.d_end, least(r.d_end + e.length, {d_max}::DOUBLE), r.n_rows + 1, r.d_end + e.length <= {d_max} AND r.n_rows + 1 < 10
  FROM routes r JOIN et e ON r.v = e.u WHERE r.open AND NOT (e.v = r.u AND e.k = r.k) AND NOT contains('>' || r.path || '>', '>' || e.u || '-' || e.v || '-' || e.k || '>'))
"""


def route_table(f, starts: DataFrame, d_max: float) -> DataFrame:
    return routes.expand(routes.starts_of(f.table, starts), f.table, d_max, proposal.cutoff_of(DT))


def told(found: DataFrame) -> DataFrame:
    return rounded(found.withColumn("path", routes.route_id(F.col("path"))), "d_start", "d_end").select("su", "sv", "sk", *EDGE, "path", "d_start", "d_end", "n_rows", "open")


@query("g1_possible_routes", f"WITH RECURSIVE {SQL}, {_ROUTES.replace('{where}', 'true').replace('{d_max}', '300')} SELECT su, sv, sk, u, v, k, path, round(d_start, 6) AS d_start, round(d_end, 6) AS d_end, n_rows, open FROM routes")
def g1(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return told(route_table(f, f.edges, 300.0))


@query("g1_full_length_routes", f"WITH RECURSIVE {SQL}, {_ROUTES.replace('{where}', 'true').replace('{d_max}', '300')} SELECT su, sv, sk, count(*) AS n FROM routes WHERE d_end >= 300 GROUP BY ALL")
def g1f(spark, sf_dir):
    return full_length(fixture(spark, sf_dir), 300.0)


@query("g4_extended_routes", f"WITH RECURSIVE {SQL}, {_ROUTES.replace('{where}', 'true').replace('{d_max}', '300')}, {_ROUTES.replace('starts AS', 'starts2 AS').replace('routes(', 'longer(').replace('FROM starts', 'FROM starts2').replace('FROM routes r', 'FROM longer r').replace('{where}', 'true').replace('{d_max}', '400')} SELECT DISTINCT l.path, round(l.d_start, 6) AS d_start, round(l.d_end, 6) AS d_end FROM longer l JOIN routes r ON l.su = r.su AND l.sv = r.sv AND l.sk = r.sk AND r.d_end >= 300 AND (l.path = r.path OR starts_with(l.path, r.path || '>'))")
def g4(spark, sf_dir):
    return longer(fixture(spark, sf_dir), 300.0, 100.0)


def full_length(f, d_max: float) -> DataFrame:
    """From each edge of the network the number of routes that use up d_max."""
    found = routes.expand(routes.starts_of(f.table, f.edges), f.table, d_max, 10, all_routes=False)
    return found.groupBy("su", "sv", "sk").agg(F.count("*").alias("n"))


def longer(f, d_max: float, more: float) -> DataFrame:
    """The routes from each edge of the network that use up d_max, carried on."""
    out = routes.extended(route_table(f, f.edges, d_max), f.table, more, d_max, 10)
    return rounded(out.withColumn("path", routes.route_id(F.col("path"))), "d_start", "d_end").select("path", "d_start", "d_end")


#: Room for a trajectory's observations in the key of a step.
STEPS = 1 << 20
#: In SQL a step's key stands in place of the trajectory's until the last select.
_STEP = f"traj_id // {STEPS} AS traj_id, traj_id % {STEPS} AS obs_idx"
_FIRST = f"firsts AS (SELECT * REPLACE (traj_id * {STEPS} + obs_idx AS traj_id) FROM particles)"
_CANDIDATES = f"""
{_FIRST},
starts AS (SELECT DISTINCT u, v, k FROM firsts),
{_ROUTES[_ROUTES.index('routes('):].replace('{d_max}', '300')},
cand0 AS (SELECT p.traj_id, p.particle_id, p.x AS px, p.y AS py, p.alpha AS pa, s.length AS sl, r.path, r.n_rows, g.u, g.v, g.k, g.grid_idx, g.dist, g.alpha, g.x, g.y, r.d_start + (1-p.alpha)*s.length AS base
  FROM firsts p JOIN et s ON s.u = p.u AND s.v = p.v AND s.k = p.k JOIN routes r ON r.su = p.u AND r.sv = p.v AND r.sk = p.k JOIN grid g ON g.u = r.u AND g.v = r.v AND g.k = r.k),
cand AS (SELECT *, CASE WHEN n_rows = 1 THEN dist - pa * sl ELSE base + dist END AS d FROM cand0 WHERE n_rows > 1 OR alpha >= pa - 1e-12),
prior AS (SELECT c.*, least(0.5::DOUBLE, greatest(0.01::DOUBLE, exp(-0.133::DOUBLE * 15))) AS p0, o.x AS ox, o.y AS oy FROM cand c JOIN obs o ON o.traj_id * {STEPS} + o.obs_idx - 1 = c.traj_id AND o.obs_idx > 0 WHERE d < 300 + 1e-5),
prior2 AS (SELECT *, CASE WHEN d > 1e-5 THEN (1-p0) * 0.068::DOUBLE * exp(-0.068::DOUBLE * d / 15) / 15 ELSE p0 END AS gamma, exp(-0.052::DOUBLE * abs(sqrt((x-px)*(x-px) + (y-py)*(y-py)) - d)) AS dev,
  exp({-0.5 / MODEL.gps_sd**2!r}::DOUBLE * ((x-ox)*(x-ox) + (y-oy)*(y-oy))) AS lik, CASE WHEN d > 1e-5 THEN p0 * 0.068::DOUBLE * exp(-0.068::DOUBLE * d / 15) ELSE -p0 * 15 END AS g1,
  CASE WHEN d > 1e-5 THEN (1-p0) * exp(-0.068::DOUBLE * d / 15) / 15 * (1 - 0.068::DOUBLE * d / 15) ELSE 0 END AS g2 FROM prior)
"""


def steps_held(f) -> tuple[DataFrame, DataFrame]:
    """Every observation's particles but the last one's, and the observations that follow; traj_id is the key of the step."""
    key = F.col("traj_id") * STEPS + F.col("obs_idx")
    later = f.obs.where("obs_idx > 0").withColumn("traj_id", key - 1)
    return f.particles.withColumn("traj_id", key).join(later.select("traj_id"), "traj_id", "left_semi"), later


def proposal_rows(f, gradients: bool = False) -> DataFrame:
    """Candidates of every observation's particles for the next observation, weighted; traj_id is the key of the step."""
    held, later = steps_held(f)
    found = proposal.candidates(held, route_table(f, f.edges, 300.0), f.table, f.grid, 300.0, fixtures.REFINE)
    return proposal.weighted(found, later, MODEL, DT, gradients)


def by_step(df: DataFrame, *names) -> DataFrame:
    """The columns named, with the step's key as traj_id and obs_idx (of the particles, not of the next observation)."""
    key = F.col("traj_id")
    return df.select(F.shiftright(key, 20).alias("traj_id"), key.bitwiseAND(F.lit(STEPS - 1)).alias("obs_idx"), "particle_id", *names)


@query("g5_proposal_totals", f"WITH RECURSIVE {SQL_NEAR}, {_CANDIDATES} SELECT {_STEP}, particle_id, round(sum(gamma*dev), 6) AS z, round(sum(gamma*dev*lik) / sum(gamma*dev), 6) AS weight, round(max(d), 6) AS max_d, count(*) AS n_candidates FROM prior2 GROUP BY ALL")
def g5(spark, sf_dir):
    sums = proposal.totals(proposal_rows(fixture(spark, sf_dir)), 300.0)
    return by_step(rounded(sums, "z", "weight", "max_d"), "z", "weight", "max_d", "n_candidates")


@query("a4_far_mass", f"WITH RECURSIVE {SQL_NEAR}, {_CANDIDATES} SELECT {_STEP}, particle_id, round(CASE WHEN sum(gamma*dev*lik) > 1e-100 THEN sum(CASE WHEN d > 270 THEN gamma*dev*lik ELSE 0 END) / sum(gamma*dev*lik) ELSE 0 END, 6) AS far_ratio FROM prior2 GROUP BY ALL")
def a4(spark, sf_dir):
    return by_step(rounded(proposal.totals(proposal_rows(fixture(spark, sf_dir)), 300.0), "far_ratio"), "far_ratio")


@query("a5_gradient_totals", f"WITH RECURSIVE {SQL_NEAR}, {_CANDIDATES} SELECT {_STEP}, particle_id, round(sum(g1*dev), 6) + 0.0::DOUBLE AS g_r0, round(sum(g2*dev), 6) + 0.0::DOUBLE AS g_lambda, round(-sum(abs(sqrt((x-px)*(x-px) + (y-py)*(y-py)) - d) * gamma * dev), 6) + 0.0::DOUBLE AS g_beta FROM prior2 GROUP BY ALL")
def a5(spark, sf_dir):
    sums = proposal.totals(proposal_rows(fixture(spark, sf_dir), True), 300.0, True)
    return by_step(sums, r6("z_d_zero_dist_prob_neg_exponent").alias("g_r0"), r6("z_d_lambda_speed").alias("g_lambda"), r6("z_d_deviation_beta").alias("g_beta"))


_PROPOSED = f"""{_CANDIDATES},
mass AS (SELECT *, gamma*dev*lik AS m FROM prior2 WHERE lik > 0),
mcdf AS (SELECT *, sum(m) OVER (PARTITION BY traj_id, particle_id ORDER BY path, grid_idx ROWS UNBOUNDED PRECEDING) AS cdf, sum(m) OVER (PARTITION BY traj_id, particle_id) AS total FROM mass),
masked AS (SELECT DISTINCT traj_id, particle_id, CAST(('0x' || substr(md5(concat_ws('|', '17', traj_id, particle_id, 'propose', 0)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS uni FROM mass),
proposed AS (SELECT c.* FROM mcdf c JOIN masked q USING (traj_id, particle_id) WHERE m > 0 AND uni >= (cdf - m) / total AND uni < cdf / total)"""


@query("g6_proposed_particles", f"WITH RECURSIVE {SQL_NEAR}, {_PROPOSED} SELECT {_STEP}, particle_id, u, v, k, grid_idx, path AS route_id, round(d, 6) + 0.0::DOUBLE AS d FROM proposed")
def g6(spark, sf_dir):
    f = fixture(spark, sf_dir)
    out = rounded(proposing.proposed(*steps_held(f), f.table, f.grid, MODEL, DT, 300.0, fixtures.REFINE, 17), "d")
    return by_step(out, *EDGE, "grid_idx", "route_id", "d")


# Resampling, smoothing and stitching -------------------------------------------------------------------------------

_WEIGHTED = "wp AS MATERIALIZED (SELECT *, CAST((obs_idx * 7 + particle_id * 3 + traj_id) % 5 AS DOUBLE) AS wt FROM particles)"


def weighted_particles(f) -> DataFrame:
    """The particles with whole weights from 0 to 4, so that some fail."""
    return f.particles.withColumn("weight", ((F.col("obs_idx") * 7 + F.col("particle_id") * 3 + F.col("traj_id")) % 5).cast("double"))


_DRAWN = f"""{_WEIGHTED},
wc AS (SELECT traj_id, obs_idx, particle_id, wt, sum(wt) OVER (PARTITION BY traj_id, obs_idx ORDER BY particle_id ROWS UNBOUNDED PRECEDING) AS cdf, sum(wt) OVER (PARTITION BY traj_id, obs_idx) AS total FROM wp),
wa AS (SELECT DISTINCT traj_id, obs_idx, draw, CAST(('0x' || substr(md5(concat_ws('|', '23', traj_id, obs_idx, 'resample', draw)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS uni FROM wp, range(4) d(draw)),
drawn AS MATERIALIZED (SELECT traj_id, obs_idx, draw, particle_id AS ancestor_id FROM wa JOIN wc USING (traj_id, obs_idx) WHERE total > 0 AND wt > 0 AND uni >= (cdf - wt) / total AND uni < cdf / total)"""
STEP = ["traj_id", "obs_idx"]


@query("g8_multinomial", w(f"SELECT traj_id, obs_idx, draw, ancestor_id FROM drawn", True).replace(SQL_NEAR, SQL_NEAR + ", " + _DRAWN))
def g8(spark, sf_dir):
    return resampling.multinomial(weighted_particles(fixture(spark, sf_dir)), STEP, 4, 23)


@query("j9_resampled_particles", w("SELECT traj_id, obs_idx, draw AS particle_id, ancestor_id, u, v, k, grid_idx FROM drawn JOIN particles p USING (traj_id, obs_idx) WHERE p.particle_id = ancestor_id", True).replace(SQL_NEAR, SQL_NEAR + ", " + _DRAWN))
def j9(spark, sf_dir):
    p = weighted_particles(fixture(spark, sf_dir))
    return resampling.gathered(p, resampling.multinomial(p, STEP, 4, 23), STEP).select(*STEP, "particle_id", "ancestor_id", *EDGE, "grid_idx")


@query("j10_never_resampled", w("SELECT traj_id, obs_idx, particle_id, u, v, k FROM particles p WHERE NOT EXISTS (SELECT 1 FROM drawn d WHERE d.traj_id = p.traj_id AND d.obs_idx = p.obs_idx AND d.ancestor_id = p.particle_id)", True).replace(SQL_NEAR, SQL_NEAR + ", " + _DRAWN))
def j10(spark, sf_dir):
    p = weighted_particles(fixture(spark, sf_dir))
    return resampling.never_drawn(p, resampling.multinomial(p, STEP, 4, 23), STEP).select(*STEP, "particle_id", *EDGE)


@query("j14_repaired_particles", w(f"""SELECT traj_id, obs_idx, particle_id, CASE WHEN wt > 0 THEN particle_id ELSE sources[1 + CAST(floor(CAST(('0x' || substr(md5(concat_ws('|', '29', traj_id, obs_idx, 'repair', particle_id)), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) * len(sources)) AS INT)] END AS source_id
  FROM wp JOIN (SELECT traj_id, obs_idx, list(particle_id ORDER BY particle_id) AS sources FROM wp WHERE wt > 0 GROUP BY ALL) USING (traj_id, obs_idx)""", True).replace(SQL_NEAR, SQL_NEAR + ", " + _WEIGHTED))
def j14(spark, sf_dir):
    return resampling.repaired(weighted_particles(fixture(spark, sf_dir)), STEP, 29)


#: Future paths: those of even particles end on their edge, those of odd ones 30 m past its end.
_GAMMA = "CASE WHEN {d} > 1e-5 THEN (1-least(0.5::DOUBLE, greatest(0.01::DOUBLE, exp(-0.133::DOUBLE * 15)))) * 0.068::DOUBLE * exp(-0.068::DOUBLE * {d} / 15) / 15 ELSE least(0.5::DOUBLE, greatest(0.01::DOUBLE, exp(-0.133::DOUBLE * 15))) END"
_BACKWARD = f"""
fut AS (SELECT a.traj_id, a.obs_idx, a.particle_id AS j, a.u, a.v, a.k, a.alpha AS alpha0, a.particle_id % 2 = 0 AS stays, CASE WHEN a.particle_id % 2 = 0 THEN a.alpha + (1 - a.alpha) / 2 ELSE 0.3::DOUBLE END AS alpha_next, CASE WHEN a.particle_id % 2 = 0 THEN (1 - a.alpha) / 2 * length ELSE (1 - a.alpha) * length + 30 END AS d_next, CASE WHEN a.particle_id % 2 = 0 THEN a.x ELSE vx END AS nx, CASE WHEN a.particle_id % 2 = 0 THEN a.y ELSE vy + 30 END AS ny FROM particles a JOIN et USING (u, v, k)),
met AS (SELECT f.traj_id, f.obs_idx, j, p.particle_id, d_next + round((alpha0 - p.alpha) * length, 5) AS d, p.x, p.y, nx, ny FROM fut f JOIN particles p ON p.traj_id = f.traj_id AND p.obs_idx = f.obs_idx AND p.u = f.u AND p.v = f.v AND p.k = f.k JOIN et ON et.u = p.u AND et.v = p.v AND et.k = p.k WHERE NOT stays OR p.alpha <= alpha_next + 1e-6),
bw AS (SELECT *, (particle_id + 1) / 0.5::DOUBLE * ({_GAMMA.format(d='d')}) * exp(-0.052::DOUBLE * abs(sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) - d)) AS w0 FROM met WHERE d >= 0)"""


def keyed_steps(f) -> DataFrame:
    """The particles with one key for trajectory and observation."""
    return f.particles.withColumn("traj_id", F.col("traj_id") * 1000 + F.col("obs_idx"))


@query("g9_backward_weights", w("SELECT traj_id * 1000 + obs_idx AS traj_id, j, particle_id, round(d, 5) + 0.0::DOUBLE AS d, round(w0 / sum(w0) OVER (PARTITION BY traj_id, obs_idx, j), 6) AS bw FROM bw", True).replace(SQL_NEAR, SQL_NEAR + ", " + _BACKWARD))
def g9(spark, sf_dir):
    f = fixture(spark, sf_dir)
    p = keyed_steps(f)
    stays, end = F.col("particle_id") % 2 == 0, F.element_at("geom", -1)
    futures = p.join(f.table.select(*EDGE, "geom", "length"), EDGE).select(
        "traj_id", F.col("particle_id").alias("j"), *EDGE, F.col("alpha").alias("alpha0"), stays.alias("same_edge"), F.when(stays, F.col("alpha") + (1 - F.col("alpha")) / 2).otherwise(0.3).alias("alpha_next"),
        F.when(stays, (1 - F.col("alpha")) / 2 * F.col("length")).otherwise((1 - F.col("alpha")) * F.col("length") + 30).alias("d_next"), F.when(stays, F.col("x")).otherwise(end["x"]).alias("nx"), F.when(stays, F.col("y")).otherwise(end["y"] + 30).alias("ny"),
    )
    filtered = p.select("traj_id", "particle_id", *EDGE, "alpha", "x", "y", (F.col("particle_id") + 1).cast("double").alias("weight"), F.lit(0.5).alias("z"))
    out = resampling.backward_weights(filtered, futures, f.table, MODEL, DT)
    return out.select("traj_id", "j", "particle_id", (F.round("d", 5) + F.lit(0.0)).alias("d"), r6("bw").alias("bw"))


_STITCH = f"""
fresh AS (SELECT a.traj_id, a.obs_idx, a.particle_id, a.u, a.v, a.k, a.alpha, a.x, a.y, a.particle_id % 2 = 0 AS stays, CASE WHEN a.particle_id % 2 = 0 THEN a.alpha + (1 - a.alpha) / 2 ELSE 0.1::DOUBLE END AS alpha_next, CASE WHEN a.particle_id % 2 = 0 THEN (1 - a.alpha) / 2 * length ELSE (1 - a.alpha) * length + 10 END AS d_next, CASE WHEN a.particle_id % 2 = 0 THEN a.x + 1 ELSE vx END AS nx, CASE WHEN a.particle_id % 2 = 0 THEN a.y ELSE vy + 10 END AS ny, length FROM particles a JOIN et USING (u, v, k)),
adj AS (SELECT *, ({_GAMMA.format(d='d_next')}) * exp(-0.052::DOUBLE * abs(sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) - d_next)) * 0.5 AS bottom FROM fresh),
smet AS (SELECT f.traj_id, f.obs_idx, f.particle_id AS j, a.particle_id, CASE WHEN bottom > 1e-5 THEN (a.particle_id + 1) / bottom ELSE 0 END AS adjusted, d_next + round((a.alpha - f.alpha) * length, 5) AS d, f.x AS jx, f.y AS jy, nx, ny
  FROM particles f JOIN adj a ON a.traj_id = f.traj_id AND a.obs_idx = f.obs_idx AND a.u = f.u AND a.v = f.v AND a.k = f.k WHERE NOT stays OR alpha_next >= f.alpha - 1e-6),
sw AS (SELECT *, adjusted * ({_GAMMA.format(d='d')}) * exp(-0.052::DOUBLE * abs(sqrt((nx-jx)*(nx-jx) + (ny-jy)*(ny-jy)) - d)) AS w0 FROM smet WHERE d >= 0)"""


@query("g12_stitch_weights", w("SELECT traj_id * 1000 + obs_idx AS traj_id, j, particle_id, round(CASE WHEN sum(w0) OVER g > 0 THEN w0 / sum(w0) OVER g ELSE 0 END, 6) AS sw FROM sw WINDOW g AS (PARTITION BY traj_id, obs_idx, j)", True).replace(SQL_NEAR, SQL_NEAR + ", " + _STITCH))
def g12(spark, sf_dir):
    f = fixture(spark, sf_dir)
    p = keyed_steps(f)
    fixed = p.select("traj_id", F.col("particle_id").alias("j"), *EDGE, F.col("alpha").alias("ja"), F.col("x").alias("jx"), F.col("y").alias("jy"))
    stays, end = F.col("particle_id") % 2 == 0, F.element_at("geom", -1)
    fresh = p.join(f.table.select(*EDGE, "geom", "length"), EDGE).select(
        "traj_id", "particle_id", *EDGE, "alpha", "x", "y", (F.col("particle_id") + 1).cast("double").alias("weight"), F.lit(0.5).alias("z"),
        F.when(stays, (1 - F.col("alpha")) / 2 * F.col("length")).otherwise((1 - F.col("alpha")) * F.col("length") + 10).alias("d_next"), stays.alias("same_edge"),
        F.when(stays, F.col("alpha") + (1 - F.col("alpha")) / 2).otherwise(0.1).alias("alpha_next"), F.when(stays, F.col("x") + 1).otherwise(end["x"]).alias("nx"), F.when(stays, F.col("y")).otherwise(end["y"] + 10).alias("ny"),
    )
    return resampling.stitch_weights(fixed, fresh, f.table, MODEL, DT).select("traj_id", "j", "particle_id", r6("sw").alias("sw"))


# Paths -------------------------------------------------------------------------------------------------------------

#: Paths of the drawn particles: each second observation's row counts as an intersection, and every third moves nothing.
_PATHS = "tracks AS (SELECT traj_id, particle_id, obs_idx AS seq, obs_idx, CASE WHEN obs_idx % 2 = 1 THEN 0.0::DOUBLE ELSE 15.0::DOUBLE * obs_idx END AS t, u, v, k, alpha, x, y, CASE WHEN obs_idx % 3 = 0 OR obs_idx > 30 THEN 0.0::DOUBLE ELSE 40.0::DOUBLE + particle_id END AS d FROM particles)"


def tracks(f) -> DataFrame:
    t = F.when(F.col("obs_idx") % 2 == 1, 0.0).otherwise(15.0 * F.col("obs_idx"))
    d = F.when((F.col("obs_idx") % 3 == 0) | (F.col("obs_idx") > 30), 0.0).otherwise(40.0 + F.col("particle_id"))
    return f.particles.select("traj_id", "particle_id", F.col("obs_idx").alias("seq"), "obs_idx", t.alias("t"), *EDGE, "alpha", "x", "y", d.alias("d"))


def wp(sql: str, more: str = "") -> str:
    return f"WITH {SQL_NEAR}, {_PATHS}{', ' + more if more else ''} {sql}"


@query("p6_f3_observation_rows", wp("SELECT traj_id, particle_id, seq FROM tracks WHERE t <> 0 OR seq = 0"))
def p6(spark, sf_dir):
    return paths.observation_rows(tracks(fixture(spark, sf_dir))).select("traj_id", "particle_id", "seq")


_NODES = """steps AS (SELECT *, lag(u || '-' || v || '-' || k) OVER (PARTITION BY traj_id, particle_id ORDER BY seq) AS before FROM tracks),
nodes_of AS (SELECT traj_id, particle_id, list(u ORDER BY seq) || [last(v ORDER BY seq)] AS nodes FROM steps WHERE before IS NULL OR before <> u || '-' || v || '-' || k GROUP BY ALL)"""


@query("p7_route_nodes", wp("SELECT traj_id, particle_id, array_to_string(nodes, '>') AS nodes FROM nodes_of", _NODES))
def p7(spark, sf_dir):
    return paths.route_nodes(tracks(fixture(spark, sf_dir))).select("traj_id", "particle_id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("nodes"))


@query("f12_multi_modal", wp("SELECT traj_id, count(DISTINCT nodes) > 1 AS is_multi_modal FROM nodes_of GROUP BY ALL", _NODES))
def f12(spark, sf_dir):
    return paths.multi_modal(paths.route_nodes(tracks(fixture(spark, sf_dir))))


@query("a21_multi_modal_count", wp("SELECT count(*) FILTER (m) AS n_multi_modal, count(*) AS n FROM (SELECT traj_id, count(DISTINCT nodes) > 1 AS m FROM nodes_of GROUP BY ALL)", _NODES))
def a21(spark, sf_dir):
    return f12(spark, sf_dir).agg(F.count_if("is_multi_modal").alias("n_multi_modal"), F.count("*").alias("n"))


@query("p8_appended_paths", wp("SELECT traj_id, particle_id, count(*) AS n_full, CAST(2 AS BIGINT) AS n_short, round(arg_max(d, seq), 6) AS last_d FROM tracks WHERE seq > 0 GROUP BY ALL"))
def p8(spark, sf_dir):
    rows = tracks(fixture(spark, sf_dir)).where("seq > 0")
    point = F.struct("seq", "t", *EDGE, "alpha", "x", "y", "d")
    every = rows.groupBy(*paths.KEY).agg(F.array_sort(F.collect_list(point)).alias("path"))
    old = every.select(*paths.KEY, F.slice("path", 1, F.size("path") - 1).alias("path"))
    new = every.select(*paths.KEY, F.slice("path", -1, 1).alias("route"))
    full, short = paths.appended(old, new), paths.appended(old, new, False)
    both = full.join(short.withColumnRenamed("path", "short"), paths.KEY)
    return both.select(*paths.KEY, F.size("path").cast("long").alias("n_full"), F.size("short").cast("long").alias("n_short"), r6(F.element_at("path", -1)["d"]).alias("last_d"))


@query("p9_densified_paths", wp("""SELECT traj_id, particle_id, seq, -1 AS step, u, v, k, round(alpha, 6) AS alpha FROM dense WHERE pe IS NULL
  UNION ALL SELECT traj_id, particle_id, seq, s AS step, u, v, k, round((b + s*10.0::DOUBLE) / length, 6) FROM dense, range(30) g(s) WHERE pe IS NOT NULL AND s < ceil((alpha*length - b) / 10 - 1e-9)""",
  """dense AS (SELECT *, CASE WHEN pe = u || '-' || v || '-' || k THEN pa*length + 10 ELSE 0 END AS b FROM (SELECT tr.*, length, lag(u || '-' || v || '-' || k) OVER o AS pe, lag(alpha) OVER o AS pa FROM tracks tr JOIN et USING (u, v, k) WINDOW o AS (PARTITION BY traj_id, particle_id ORDER BY seq)))"""))  # fmt: skip
def p9(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return rounded(paths.densified(tracks(f), f.table, 10.0), "alpha")


@query("p10_cartesian_paths", wp("SELECT traj_id, particle_id, seq, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y FROM tracks WHERE t <> 0 OR seq = 0"))
def p10(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return rounded(paths.cartesian(tracks(f), f.table, True), "x", "y")


@query("f11_trimmed_zeros", wp("SELECT traj_id, particle_id, seq FROM (SELECT *, count(*) FILTER (seq > last) OVER (PARTITION BY traj_id, particle_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS after FROM (SELECT *, coalesce(max(CASE WHEN d <> 0 THEN seq END) OVER (PARTITION BY traj_id, particle_id), -1) AS last FROM tracks WHERE t <> 0 OR seq = 0)) WHERE after <= 3"))
def f11(spark, sf_dir):
    return paths.trimmed(tracks(fixture(spark, sf_dir))).select("traj_id", "particle_id", "seq")


@query("w8_last_rows", wp("SELECT traj_id, particle_id, max(seq) AS seq, arg_max(u, seq) AS u FROM tracks GROUP BY ALL"))
def w8(spark, sf_dir):
    return paths.last_rows(tracks(fixture(spark, sf_dir))).select("traj_id", "particle_id", "seq", "u")


@query("g15_split_at_observation", wp("SELECT traj_id, particle_id, count(*) FILTER (obs_idx <= 20) AS n_fixed, count(*) FILTER (obs_idx >= 20) AS n_new FROM tracks GROUP BY ALL"))
def g15(spark, sf_dir):
    fixed, new = paths.split_at(tracks(fixture(spark, sf_dir)), 20)
    return fixed.groupBy(*paths.KEY).agg(F.count("*").alias("n_fixed")).join(new.groupBy(*paths.KEY).agg(F.count("*").alias("n_new")), paths.KEY)


# Summaries ---------------------------------------------------------------------------------------------------------


@query("a11_a12_a17_sufficient_statistics", wp("""SELECT traj_id, count(line) AS n_moves, round(sum(CASE WHEN line IS NOT NULL THEN d END), 6) AS sum_d, round(sum(abs(line - d)), 6) AS sum_dev, round(sum(sq), 6) AS sum_sq, round(sqrt(avg(sq) / 2), 6) AS gps_sd,
  round(avg(CASE WHEN line IS NOT NULL THEN CASE WHEN d < 1e-5 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS zero_part FROM (SELECT tr.*, sqrt((tr.x-lag(tr.x) OVER o)*(tr.x-lag(tr.x) OVER o) + (tr.y-lag(tr.y) OVER o)*(tr.y-lag(tr.y) OVER o)) AS line, (tr.x-ob.x)*(tr.x-ob.x) + (tr.y-ob.y)*(tr.y-ob.y) AS sq
  FROM tracks tr JOIN obs ob USING (traj_id, obs_idx) WINDOW o AS (PARTITION BY tr.traj_id, tr.particle_id ORDER BY tr.obs_idx)) GROUP BY ALL"""))  # fmt: skip
def a11(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return rounded(analytics.sufficient(tracks(f), f.obs), "sum_d", "sum_dev", "sum_sq", "gps_sd", "zero_part")


@query("a14_extent", wp("SELECT traj_id, round(min(x), 6) + 0.0::DOUBLE AS min_x, round(max(x), 6) + 0.0::DOUBLE AS max_x, round(min(y), 6) + 0.0::DOUBLE AS min_y, round(max(y), 6) + 0.0::DOUBLE AS max_y, round(avg(x) FILTER (obs_idx = 0), 6) + 0.0::DOUBLE AS start_x, round(avg(y) FILTER (obs_idx = 0), 6) + 0.0::DOUBLE AS start_y, round(avg(x) FILTER (obs_idx = last), 6) + 0.0::DOUBLE AS end_x, round(avg(y) FILTER (obs_idx = last), 6) + 0.0::DOUBLE AS end_y FROM (SELECT *, max(obs_idx) OVER (PARTITION BY traj_id) AS last FROM tracks) GROUP BY ALL"))
def a14(spark, sf_dir):
    out = analytics.extent(tracks(fixture(spark, sf_dir)))
    return rounded(out, *[c for c in out.columns if c != "traj_id"])


@query("k4_expanded_limits", wp("SELECT traj_id, round(min(x) - greatest(max(x) - min(x), 200) * 0.05, 6) AS low, round(max(x) + greatest(max(x) - min(x), 200) * 0.05, 6) AS high FROM tracks GROUP BY ALL"))
def k4(spark, sf_dir):
    out = analytics.extent(tracks(fixture(spark, sf_dir))).withColumn("l", geometry.expanded_limits(F.col("min_x"), F.col("max_x"), 0.05))
    return out.select("traj_id", r6("l.low").alias("low"), r6("l.high").alias("high"))


@query("a18_distance_histogram", wp("SELECT bin, count(*) AS n FROM (SELECT least(39, CAST(floor(line / 2.5) AS INT)) AS bin FROM (SELECT round(sqrt((x-lag(x) OVER o)*(x-lag(x) OVER o) + (y-lag(y) OVER o)*(y-lag(y) OVER o)), 6) AS line FROM tracks WINDOW o AS (PARTITION BY traj_id, particle_id ORDER BY obs_idx)) WHERE line BETWEEN 0 AND 100) GROUP BY ALL"))
def a18(spark, sf_dir):
    return analytics.histogram(rounded(analytics.movements(tracks(fixture(spark, sf_dir))), "line"), [], "line", 0.0, 100.0, 40)


@query("a15_total_variation", wp("SELECT traj_id, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tv FROM (SELECT traj_id, bin, count(*) / sum(count(*)) OVER (PARTITION BY traj_id) AS p FROM binned WHERE particle_id = 0 GROUP BY traj_id, bin) FULL JOIN (SELECT traj_id, bin, count(*) / sum(count(*)) OVER (PARTITION BY traj_id) AS q FROM binned WHERE particle_id = 1 GROUP BY traj_id, bin) USING (traj_id, bin) GROUP BY ALL",
  "box AS (SELECT traj_id, min(x) AS low, max(x) AS high FROM tracks WHERE particle_id = 0 GROUP BY ALL), binned AS (SELECT traj_id, particle_id, CASE WHEN x < low THEN -1 ELSE least(floor((x - low) / 3), ceil((high - low) / 3)) END AS bin FROM tracks JOIN box USING (traj_id))"))
def a15(spark, sf_dir):
    rows = tracks(fixture(spark, sf_dir))
    return rounded(analytics.total_variation(rows.where("particle_id = 0"), rows.where("particle_id = 1"), ["traj_id"], "x", 3.0), "tv")


@query("a16_interval_distances", wp("SELECT traj_id, particle_id, CAST(ceil(t / 60) - 1 AS INT) AS interval, round(sum(d), 6) AS travelled FROM tracks WHERE t > 0 GROUP BY ALL"))
def a16(spark, sf_dir):
    return rounded(analytics.interval_distances(tracks(fixture(spark, sf_dir))), "travelled")


@query("a16_interval_total_variation", wp("SELECT interval, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tv FROM (SELECT interval, travelled, count(*) / sum(count(*)) OVER (PARTITION BY interval) AS p FROM iv WHERE particle_id = 0 GROUP BY interval, travelled) FULL JOIN (SELECT interval, travelled, count(*) / sum(count(*)) OVER (PARTITION BY interval) AS q FROM iv WHERE particle_id = 1 GROUP BY interval, travelled) USING (interval, travelled) GROUP BY ALL",
  "iv AS (SELECT traj_id, particle_id, CAST(ceil(t / 60) - 1 AS INT) AS interval, sum(d) AS travelled FROM tracks WHERE t > 0 GROUP BY ALL)"))
def a16tv(spark, sf_dir):
    rows = analytics.interval_distances(tracks(fixture(spark, sf_dir)))
    return rounded(analytics.total_variation(rows.where("particle_id = 0"), rows.where("particle_id = 1"), ["interval"], "travelled", None), "tv")


def _utm_sql() -> str:
    """Easting and northing by the series of transverse Mercator, in the order in which `geometry.to_utm` sums them."""
    radius, eccentric, series = geometry.utm_constants()
    east = " + ".join(["eta", *[f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(series, 1)]])
    north = " + ".join(["xi", *[f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(series, 1)]])
    return f"""SELECT s_suppkey, zone, round({geometry.FALSE_EAST!r}::DOUBLE + {geometry.SCALE * radius!r}::DOUBLE * ({east}), 3) AS x, round({geometry.SCALE * radius!r}::DOUBLE * ({north}) + CASE WHEN lat < 0 THEN {geometry.FALSE_NORTH!r}::DOUBLE ELSE 0 END, 3) AS y
      FROM (SELECT *, atan2(tangent, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + tangent * tangent)) AS eta
      FROM (SELECT *, sinh(atanh(sin(radians(lat))) - {eccentric!r}::DOUBLE * atanh({eccentric!r}::DOUBLE * sin(radians(lat)))) AS tangent, radians(lon - (zone * 6 - 183)) AS away
      FROM (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone FROM (SELECT s_suppkey, (s_suppkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (s_suppkey * 53 % 1600) / 10.0::DOUBLE - 80 AS lat FROM supplier))))"""


@query("p4_utm", _utm_sql())
def p4(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", ((F.col("s_suppkey") * 37 % 3600) / 10.0 - 180).alias("lon"), ((F.col("s_suppkey") * 53 % 1600) / 10.0 - 80).alias("lat"))
    return geometry.project_table(s, "lon", "lat").select("s_suppkey", "zone", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# Whole matches: no SQL, rows only; tests hold them against exact smoothing ------------------------------------------


def timed(f) -> DataFrame:
    return trips.intervals(f.obs)


@query("g19_offline_map_match")
def g19(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return matching.offline_map_match(timed(f), f.table, MODEL, particles=30, refine=fixtures.REFINE, routes=False)


@query("g20_online_replay_bsi")
def g20(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return matching.online_replay(timed(f), f.table, MODEL, 30, "BSi", 2, refine=fixtures.REFINE, routes=False)


@query("g16_online_replay_pf")
def g16(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return matching.online_replay(timed(f), f.table, MODEL, 30, "PF", 2, refine=fixtures.REFINE, routes=False)


@query("g21_learning_trace")
def g21(spark, sf_dir):
    from pathloom.plans import learning

    f = fixture(spark, sf_dir)
    _, trace = learning.offline_em(timed(f), f.table, MODEL, iterations=1, particles=10, scale=1e-5, refine=fixtures.REFINE)
    return spark.createDataFrame(trace)


@query("s10_sampled_routes")
def s10(spark, sf_dir):
    from pathloom.plans import simulate

    return simulate.sampled_routes(fixture(spark, sf_dir).table, 200, 20, MODEL, seed=1, refine=fixtures.REFINE).drop("route")


@query("f10_trajectories_of_length", w("SELECT traj_id, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) BETWEEN 20 AND 60"))
def s11(spark, sf_dir):
    points = fixture(spark, sf_dir).obs.groupBy("traj_id").agg(F.collect_list(F.array("x", "y")).alias("POLYLINE"))
    return trips.of_length(points).select("traj_id", F.size("POLYLINE").cast("long").alias("n"))


@query("a20_distinct_places", w("SELECT traj_id, count(DISTINCT u || '-' || v || '-' || k || '-' || grid_idx) AS n FROM particles GROUP BY ALL", True))
def a20(spark, sf_dir):
    return fixture(spark, sf_dir).particles.groupBy("traj_id").agg(F.count_distinct(*EDGE, "grid_idx").alias("n"))


@query("a19_runtime_per_observation", "SELECT event_type, round(avg(CAST(event_id % 7 + 1 AS DOUBLE) / (event_id % 3 + 1)), 6) AS seconds FROM events GROUP BY ALL")
def a19(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("event_id") % 7 + 1).cast("double").alias("time"), (F.col("event_id") % 3 + 1).alias("n_obs"))
    return rounded(analytics.runtime_per_observation(runs, ["event_type"]), "seconds")


@query("w6_window_of_observations", w("SELECT traj_id, obs_idx, min(x) OVER g AS low, max(x) OVER g AS high, count(*) OVER g AS n FROM obs WINDOW g AS (PARTITION BY traj_id ORDER BY obs_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"))
def w6(spark, sf_dir):
    last = W.partitionBy("traj_id").orderBy("obs_idx").rowsBetween(-3, 0)
    return fixture(spark, sf_dir).obs.select("traj_id", "obs_idx", F.min("x").over(last).alias("low"), F.max("x").over(last).alias("high"), F.count("*").over(last).alias("n"))


@query("q_retried_particles", f"WITH RECURSIVE {SQL_NEAR}, {_CANDIDATES} SELECT {_STEP}, particle_id FROM prior2 GROUP BY ALL HAVING sum(gamma*dev*lik) > 1e-100 AND sum(CASE WHEN d > 270 THEN gamma*dev*lik ELSE 0 END) > 0.1 * sum(gamma*dev*lik) AND max(d) > 270")
def q7(spark, sf_dir):
    sums = proposal.totals(proposal_rows(fixture(spark, sf_dir)), 300.0)
    return by_step(proposal.retried(sums, 300.0))
