"""Road networks as tables: nodes(node_id, x, y), edges(u, v, k, geom) and what is derived from them.

A network table is small beside observations, but its size isn't bounded here: joins on
it carry no broadcast hint, and Spark broadcasts it while it is under its own threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import geometry

POINTS = "array<struct<x: double, y: double>>"
EDGE = ["u", "v", "k"]


def lattice_nodes(spark: SparkSession, size: int = 20) -> DataFrame:
    """A square lattice of 100 m, and one dead end west of its first node."""
    grid = spark.range(size * size).select(F.col("id").alias("node_id"), (100.0 * (F.col("id") % size)).alias("x"), (100.0 * F.floor(F.col("id") / size)).alias("y"))
    return grid.union(spark.range(1).select(F.lit(size * size).cast("long"), F.lit(-60.0), F.lit(0.0)))


def lattice_edges(spark: SparkSession, size: int = 20) -> DataFrame:
    """Both ways between neighbours, but no way left in each fourth row; bent parallels beside some ways right."""
    cell = spark.range(size * size).select("id", F.floor(F.col("id") / size).alias("r"), (F.col("id") % size).alias("c"))
    none = F.lit(None).cast(POINTS)
    key = F.lit(0).alias("k")
    right = cell.where(F.col("c") < size - 1)
    up = cell.where(F.col("r") < size - 1)
    middle = F.array(
        F.struct((100.0 * F.col("c")).alias("x"), (100.0 * F.col("r")).alias("y")),
        F.struct((100.0 * F.col("c") + 50).alias("x"), (100.0 * F.col("r") + 20).alias("y")),
        F.struct((100.0 * F.col("c") + 100).alias("x"), (100.0 * F.col("r")).alias("y")),
    )
    u, side, above = F.col("id").alias("u"), (F.col("id") + 1).alias("v"), (F.col("id") + size).alias("v")
    parts = [
        right.select(u, side, key, none.alias("geom")),
        right.where(F.col("r") % 4 != 3).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"), key, none.alias("geom")),
        up.select(u, above, key, none.alias("geom")),
        up.select((F.col("id") + size).alias("u"), F.col("id").alias("v"), key, none.alias("geom")),
        right.where((F.col("r") + F.col("c")) % 7 == 0).select(u, side, F.lit(1).alias("k"), middle.cast(POINTS).alias("geom")),
        spark.range(2).select(F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(size * size)).cast("long").alias("u"), F.when(F.col("id") == 0, F.lit(size * size)).otherwise(F.lit(0)).cast("long").alias("v"), key, none.alias("geom")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def edge_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a geometry each, the straight line where none is given, and their length."""
    a = nodes.select(F.col("node_id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    line = F.array(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y")))
    joined = edges.join(a, "u", "left").join(b, "v", "left").withColumn("geom", F.coalesce("geom", line.cast(POINTS)))
    return joined.select(*EDGE, "geom", geometry.polyline_length(F.col("geom")).alias("length"))


def edge_geometry(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The geometry and length of the edges (u, v, k) wanted."""
    return wanted.join(table, EDGE)


def adjacency(table: DataFrame) -> DataFrame:
    """(u, v, k, nu, nv, nk): each edge beside every edge out of its end."""
    follow = table.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("k").alias("nk"))
    return table.select(*EDGE).join(follow, F.col("v") == F.col("nu"))


def out_edges(table: DataFrame, node: int) -> DataFrame:
    return table.where(F.col("u") == node).select(*EDGE)


def segments(table: DataFrame) -> DataFrame:
    """(u, v, k, seg, x0, y0, x1, y1): the straight parts of each edge."""
    both = table.select(*EDGE, "geom", F.posexplode(F.slice("geom", 1, F.size("geom") - 1)).alias("seg", "a"))
    b = F.col("geom")[F.col("seg") + 1]
    return both.select(*EDGE, "seg", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))


def edge_grid(table: DataFrame, refine: float = 1.0, point: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(u, v, k, grid_idx, dist, alpha, x, y): places from each edge's end backwards, `refine` metres apart.
    `point` gives the place from geom, dist and length, in place of interpolation."""
    n = geometry.grid_size(F.col("length"), refine)
    spots = table.where(n > 0).select(*EDGE, "geom", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("grid_idx"))
    spots = spots.withColumn("dist", F.col("length") - F.col("grid_idx") * refine).withColumn("alpha", F.col("dist") / F.col("length"))
    p = geometry.interpolate(F.col("geom"), F.col("alpha")) if point is None else point(F.col("geom"), F.col("dist"), F.col("length"))
    return spots.withColumn("p", p).select(*EDGE, "grid_idx", "dist", "alpha", "p.x", "p.y")


#: Edges that the driver may hold as rows, to send them to all workers.
EDGES_AT_MOST = 200_000


def collected(table: DataFrame, most: int = EDGES_AT_MOST) -> dict[str, list]:
    """The edges and their points as lists of columns on the driver; a table of more than `most` edges is refused."""
    rows = table.select(*EDGE, F.transform("geom", lambda p: F.array(p["x"], p["y"])).alias("geom")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a network of more than {most} edges isn't sent to workers whole; match by offline_map_match, which joins it")
    rows.sort(key=lambda r: (r["u"], r["v"], r["k"]))
    return {c: [r[c] for r in rows] for c in (*EDGE, "geom")}


def write_network(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet in one folder."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def segment_cells(parts: DataFrame, cell: float, reach: float) -> DataFrame:
    """Segments with the cells of their boxes, grown by `reach`: whatever is within reach lies in one."""

    def span(a, b):
        low = F.floor((F.least(a, b) - reach) / cell).cast("int")
        return F.sequence(low, F.floor((F.greatest(a, b) + reach) / cell).cast("int"))

    return parts.withColumn("cx", F.explode(span(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(span(F.col("y0"), F.col("y1"))))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file, which any of Spark's stores may hold. One file is one
    network, as large as the machine that wrote it could hold; its parts are read as rows of XML."""
    keys = {r["_id"]: r["_attr.name"] for r in spark.read.format("xml").option("rowTag", "key").load(path).select("_id", F.col("`_attr.name`")).collect()}
    data = "array<struct<_VALUE: string, _key: string>>"
    schema = f"_id string, _source string, _target string, data {data}"

    def rows(tag):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    def value(name):
        wanted = [k for k, v in keys.items() if v == name]
        return F.get(F.filter("data", lambda d: d["_key"].isin(wanted)), F.lit(0))["_VALUE"] if wanted else F.lit(None).cast("string")

    nodes = rows("node").select(F.col("_id").cast("long").alias("node_id"), value("x").cast("double").alias("x"), value("y").cast("double").alias("y"))
    numbers = F.regexp_extract_all(value("geometry"), F.lit(r"(-?[0-9.]+(?:[eE]-?[0-9]+)?)"), 1)
    many = F.floor(F.coalesce(F.size(numbers), F.lit(0)) / 2).cast("int")
    point = lambda i: F.struct(numbers[i * 2].cast("double").alias("x"), numbers[i * 2 + 1].cast("double").alias("y"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), point)
    order = W.partitionBy("u", "v").orderBy("__i")
    found = rows("edge").select(F.col("_source").cast("long").alias("u"), F.col("_target").cast("long").alias("v"), F.coalesce(F.col("_id").cast("int"), F.lit(None)).alias("key"), value("geometry").alias("wkt"), F.when(many >= 2, pairs).alias("geom"), F.monotonically_increasing_id().alias("__i"))
    edges = found.withColumn("k", F.coalesce("key", F.row_number().over(order) - 1)).select("u", "v", "k", F.col("geom").cast(POINTS).alias("geom"))
    return nodes, edges
