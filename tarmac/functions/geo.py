"""Distances, polygons, polylines and projections as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.195  # a little under the true 111.1949 * 1.0000009, used only for cell sizing


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_polygon(x, y, polygon, eps: float = 0.0) -> Column:
    """Ray casting over array<struct<x,y>>; `eps` pads the edge height as a second variant does."""
    x, y, poly = _c(x), _c(y), _c(polygon)
    n = F.size(poly)

    def crosses(i):
        a = F.element_at(poly, i + 1)
        b = F.element_at(poly, F.when(i == 0, n).otherwise(i))
        ax, ay, bx, by = (a["x"], a["y"], b["x"], b["y"])
        straddles = (ay > y) != (by > y)
        return straddles & (x < (bx - ax) * (y - ay) / (by - ay + F.lit(eps)) + ax)

    edges = F.sequence(F.lit(0), n - 1)
    odd = F.aggregate(edges, F.lit(False), lambda acc, i: acc != F.coalesce(crosses(i), F.lit(False)))
    return F.when(n >= 3, odd).otherwise(F.lit(False))


def polyline_distance(x, y, line) -> Column:
    """Shortest distance from a point to array<struct<x,y>>; a single point counts as a vertex."""
    x, y, pts = _c(x), _c(y), _c(line)

    def seg(i):
        a, b = F.element_at(pts, i), F.element_at(pts, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / len2).otherwise(F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.sqrt(F.pow(x - (a["x"] + t * dx), F.lit(2)) + F.pow(y - (a["y"] + t * dy), F.lit(2)))

    first = F.element_at(pts, 1)
    vertex = F.sqrt(F.pow(x - first["x"], F.lit(2)) + F.pow(y - first["y"], F.lit(2)))
    return F.when(F.size(pts) == 0, F.lit(None).cast("double")).when(
        F.size(pts) == 1, vertex
    ).otherwise(F.array_min(F.transform(F.sequence(F.lit(1), F.size(pts) - 1), seg)))


def project(px, py, h, scale) -> Column:
    """Image point to road plane by a row-major 3x3 matrix; flat scaling near the horizon."""
    px, py, h, scale = _c(px), _c(py), _c(h), _c(scale)
    x = h[0] * px + h[1] * py + h[2]
    y = h[3] * px + h[4] * py + h[5]
    z = h[6] * px + h[7] * py + h[8]
    flat = F.struct((px * scale).alias("x"), (py * scale).alias("y"))
    warped = F.struct((x / z).alias("x"), (y / z).alias("y"))
    return F.when(h.isNull() | (F.abs(z) < 1e-8), flat).otherwise(warped)
