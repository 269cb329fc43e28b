"""Geometry on edges: interpolation, grids, projection. Points are structs (x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the WGS84 ellipsoid and the UTM grid.
AXIS, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def polyline_length(points: Column) -> Column:
    """The sum of the lengths of the segments."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def interpolate(points: Column, alpha: Column) -> Column:
    """The point at a proportion of the way along a polyline, as a struct (x, y)."""
    goal = alpha * polyline_length(points)
    first = points[0]
    start = F.struct(F.lit(0.0).alias("d"), first["x"].alias("px"), first["y"].alias("py"), first["x"].alias("x"), first["y"].alias("y"))

    def step(s, p):
        size = F.hypot(p["x"] - s["px"], p["y"] - s["py"])
        part = F.when(size > 0, F.least(F.lit(1.0), (goal - s["d"]) / size)).otherwise(F.lit(0.0))
        on = goal >= s["d"]
        return F.struct(
            (s["d"] + size).alias("d"), p["x"].alias("px"), p["y"].alias("py"),
            F.when(on, s["px"] + part * (p["x"] - s["px"])).otherwise(s["x"]).alias("x"),
            F.when(on, s["py"] + part * (p["y"] - s["py"])).otherwise(s["y"]).alias("y"),
        )

    end = F.aggregate(F.slice(points, 2, F.size(points) - 1), start, step)
    return F.struct(end["x"].alias("x"), end["y"].alias("y"))


def grid_size(length: Column, refine: float) -> Column:
    """How many grid places an edge has: its length less whole steps, while over a tenth of a step."""
    return F.greatest(F.lit(0), F.ceil((length - refine / 10) / refine)).cast("int")


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    part = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / square))).otherwise(F.lit(0.0))
    return F.hypot(x - (x0 + part * dx), y - (y0 + part * dy))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_constants() -> tuple[float, float, tuple[float, ...]]:
    """The rectifying radius, the ellipsoid's eccentricity, and the coefficients of the series by multiple of the angle."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    series = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    return radius, math.sqrt(FLATTENING * (2 - FLATTENING)), series


def to_utm(lon: Column, lat: Column, zone: Column | None = None) -> Column:
    """Longitude and latitude, in degrees, as a struct (x, y, zone) of UTM metres, by the series of
    transverse Mercator to the sixth order of the third flattening."""
    radius, eccentric, series = utm_constants()
    zone = utm_zone(lon) if zone is None else zone
    phi, away = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    sine = F.sin(phi)
    tangent = F.sinh(F.atanh(sine) - eccentric * F.atanh(eccentric * sine))
    xi, eta = F.atan2(tangent, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + tangent * tangent))
    east, north = eta, xi
    for j, c in enumerate(series, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    y = SCALE * radius * north
    return F.struct((FALSE_EAST + SCALE * radius * east).alias("x"), F.when(lat < 0, y + FALSE_NORTH).otherwise(y).alias("y"), zone.alias("zone"))


def expanded_limits(low: Column, high: Column, inflation: float, least: float = 200.0) -> Column:
    """A plot's limits: the range, at least `least`, padded on both sides by a fraction of it."""
    pad = F.greatest(high - low, F.lit(least)) * inflation
    return F.struct((low - pad).alias("low"), (high + pad).alias("high"))


def project_table(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Adds x, y and zone columns."""
    return df.withColumn("__p", to_utm(F.col(lon), F.col(lat))).select("*", "__p.x", "__p.y", "__p.zone").drop("__p")
