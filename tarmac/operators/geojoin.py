"""Radius and nearest-neighbour joins on coordinates, as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.geo import EARTH_RADIUS_KM, haversine_km
from tarmac.session import broadcast_if_small, stage

_SPLIT, _LEVELS = 2, (0, 3, 6, 9)  # cubes of a quarter of the globe's radius, each level opened into 8 x 8 x 8 of which a surface meets some 64


def radius_join(points: DataFrame, sites: DataFrame, km: float, cell: float = 0.1) -> DataFrame:
    """Pairs at most `km` apart: every column of both sides plus `distance_km`.

    `points` (many rows) have lat/lon, `sites` have site_lat/site_lon. Each site is listed under
    the cells its bounding box touches; each point has one cell. Rows without coordinates never
    match.
    """
    n = round(360 / cell)
    r = km / EARTH_RADIUS_KM
    dlat = F.lit(km / EARTH_RADIUS_KM * 180 / 3.141592653589793 * 1.000001)
    ratio = F.sin(F.lit(r)) / F.greatest(F.cos(F.radians("site_lat")), F.lit(1e-9))
    dlon = F.when(ratio < 1, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * 1.000001).otherwise(180.0)
    gy = F.sequence(F.floor((F.col("site_lat") - dlat) / cell), F.floor((F.col("site_lat") + dlat) / cell))
    gx = F.sequence(F.floor((F.col("site_lon") - dlon) / cell), F.floor((F.col("site_lon") + dlon) / cell))
    s = (
        sites.where("site_lat is not null and site_lon is not null")
        .withColumn("_gy", F.explode(gy)).withColumn("_gx", F.explode(gx))
        .withColumn("_gx", F.pmod("_gx", F.lit(n)))
    )
    p = (
        points.where("lat is not null and lon is not null")
        .withColumn("_gy", F.floor(F.col("lat") / cell))
        .withColumn("_gx", F.pmod(F.floor(F.col("lon") / cell), F.lit(n)))
    )
    d = haversine_km("lat", "lon", "site_lat", "site_lon")
    return (p.join(broadcast_if_small(s), ["_gy", "_gx"]).drop("_gy", "_gx")
            .withColumn("distance_km", d).where(F.col("distance_km") <= km))


def _place(lat: str, lon: str, planar: bool) -> list[Column]:
    """Coordinates whose straight distance orders places as the distance asked for does: on the unit ball, or flat."""
    if planar:
        return [F.col(lat).cast("double"), F.col(lon).cast("double"), F.lit(0.0)]
    y, x = F.radians(lat), F.radians(lon)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def _cell(level: int, planar: bool) -> Column:
    """A number for the cube of that level that holds (_x, _y, _z)."""
    side = (90.0 if planar else 0.25) / _SPLIT**level
    i = [F.floor(F.col(c) / side) + (1 << 20) for c in ("_x", "_y", "_z")]
    return (i[0] * (1 << 21) + i[1]) * (1 << 21) + i[2]


def _within_reach(rows: DataFrame, k: int) -> DataFrame:
    """A row for each of a row's _cells (n sites in the box lo..hi) that may hold one of its place's k nearest sites.

    Taken by their farthest corners, the first cells with k sites between them bound the k-th distance; a cell whose
    nearest corner lies beyond that holds none.
    """
    def apart(c, far):
        total = F.lit(0.0)
        for own, lo, hi in (("_x", "lx", "hx"), ("_y", "ly", "hy"), ("_z", "lz", "hz")):
            a, b = c[lo] - F.col(own), F.col(own) - c[hi]
            gap = F.greatest(F.abs(a), F.abs(b)) if far else F.greatest(F.lit(0.0), a, b)
            total = total + gap * gap
        return total

    far = F.array_sort(F.transform("_cells", lambda c: F.struct(apart(c, True).alias("far"), c["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("far"))
    grown = F.aggregate(far, start, lambda s, c: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + c["n"]).alias("n"), c["far"].alias("far"))))
    out = rows.withColumn("_far", grown).select("*", F.explode("_cells").alias("_c")).drop("_cells")
    near = (F.col("_far.n") < k) | (apart(F.col("_c"), False) <= F.col("_far.far") * (1 + 1e-9) + 1e-15)
    return out.where(near).withColumn("_cell", F.col("_c.cell")).drop("_c", "_far")


def nearest(points: DataFrame, sites: DataFrame, k: int, site_id: str = "cctv_id",
            by: tuple[str, ...] = (), planar: bool = False) -> DataFrame:
    """The `k` nearest sites of every distinct (lat, lon) in `points`, ranked from 1.

    With `by`, both sides carry these columns and only sites with equal values count. Distances are
    great-circle kilometres or, if `planar`, degrees as on flat paper (column `distance_km` as well).

    Sites are counted in the cubes of a hierarchy over the unit ball, so poles and date line are places like others.
    A place starts with the few hundred cubes that cover the globe; in each round it keeps those that can hold one of its
    k nearest sites and opens them into smaller ones. What it meets in the end are the sites of a handful of small cubes,
    however far away they lie, so the answer is exact. Returns lat, lon, the site columns, distance_km, rank. Ties go to the smaller site id.
    """
    by, last = list(by), len(_LEVELS) - 1
    s = sites.where("site_lat is not null and site_lon is not null")
    x, y, z = _place("site_lat", "site_lon", planar)
    s = s.withColumn("_x", x).withColumn("_y", y).withColumn("_z", z)
    names = [f"_c{i}" for i in range(last + 1)]
    s = s.select("*", *(_cell(lv, planar).alias(c) for lv, c in zip(_LEVELS, names)))
    box = [f(f"_{c}").alias(f"{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]
    fine = stage(s.groupBy(*by, *names).agg(F.count("*").alias("n"), *box))
    again = [f(f"{n}{c}").alias(f"{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]

    def children(level):
        """Of each cell above (of each `by` alone at the top) its cells of that level."""
        up = [names[level - 1]] if level else []
        cells = fine.groupBy(*by, *up, names[level]).agg(F.sum("n").alias("n"), *again).withColumnRenamed(names[level], "cell")
        item = F.struct("cell", "n", *(f"{n}{c}" for c in "xyz" for n in "lh"))
        out = cells.groupBy(*by, *up).agg(F.collect_list(item).alias("_cells"))  # bounded by the ways a cube splits
        return out.withColumnRenamed(up[0], "_cell") if up else out

    p = points.where("lat is not null and lon is not null").select("lat", "lon", *by).distinct()
    x, y, z = _place("lat", "lon", planar)
    p = p.withColumn("_x", x).withColumn("_y", y).withColumn("_z", z)
    at = p.join(children(0), by) if by else p.join(F.broadcast(children(0)))  # one row: the globe
    reach = _within_reach(at, k)
    place = ["lat", "lon", *by]
    for level in range(1, last + 1):
        opened = reach.join(children(level), [*by, "_cell"]).groupBy(*place).agg(
            *(F.first(c).alias(c) for c in ("_x", "_y", "_z")), F.flatten(F.collect_list("_cells")).alias("_cells"))
        reach = _within_reach(opened, k)
    km = haversine_km("lat", "lon", "site_lat", "site_lon")
    if planar:
        km = F.hypot(F.col("lat") - F.col("site_lat"), F.col("lon") - F.col("site_lon"))
    cand = reach.select(*place, "_cell").join(s.drop("_x", "_y", "_z", *names[:-1]).withColumnRenamed(names[-1], "_cell"), [*by, "_cell"])
    w = Window.partitionBy(*place).orderBy("distance_km", site_id)
    cand = cand.withColumn("distance_km", km).drop("_cell")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
