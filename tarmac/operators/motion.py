"""Per-vehicle motion features and same-frame vehicle pairs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators import sequence as seq
from tarmac.session import stage

METRES_PER_PIXEL = 0.05
STOP_KMH = 5.0
NO_TTC = 999.0
NO_GAP = 9999.0
GAP_RANGE_PX = 500.0
NEIGHBOUR_RADIUS_PX = 200.0
LANE_OVERLAP = 0.3
KEYS = ["camera_id", "track_id"]
FRAME = ["camera_id", "frame_idx"]
# fixed values: feature names
FEATURES = [
    "speed_kmh", "acceleration", "heading", "heading_change", "heading_deviation",
    "lateral_speed", "ttc_min", "gap_front", "gap_rear", "speed_diff_flow", "stop_duration",
    "area_change_rate", "aspect_ratio", "track_age", "neighbor_count",
]
MA_FRAMES = 5
FLOW_FRAMES = 300
FRAME_CHUNK = 4096
_HALO = 4


def hypot(dx, dy):
    return F.sqrt(dx * dx + dy * dy)


def c_float(f, jvm, *cols: Column) -> Column:
    """f, a function of `math`, of one or two columns; where that is no number, what Spark's own `jvm` gives.

    `math` has the C library's functions, as SQL engines have. The JVM's differ from them in the last bit, which decides
    the sign of what would cancel exactly.
    """
    def each(*parts: pd.Series) -> pd.Series:
        return pd.Series([f(*v) if all(map(math.isfinite, v)) else None for v in zip(*(p.tolist() for p in parts))], dtype="float64")

    if len(cols) == 1:
        @F.pandas_udf("double")
        def run(a: pd.Series) -> pd.Series:
            return each(a)
    else:
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return each(a, b)
    return F.coalesce(run(*cols), jvm(*cols))


def wrap_heading(dx, dy):
    deg = F.degrees(c_float(math.atan2, F.atan2, dx, -dy))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def turn(a, b):
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def track_rows(obs: DataFrame, size: int = seq.BLOCK, halo: int = _HALO) -> DataFrame:
    return seq.blocks(obs, KEYS, ["frame_idx"], F.floor(F.col("frame_idx") / FRAME_CHUNK),
                      size=size, halo=halo, out="track_age")


def motion(obs: DataFrame, dt: float = 1.0, size: int = seq.BLOCK) -> DataFrame:
    """Speed, acceleration, heading, turn, lateral speed, stop time, shape change per observation.

    Input: camera_id, track_id, frame_idx, t (seconds), cx, cy, w, h. `track_age` is the number of
    frames the track has been seen in. A heading survives moves under half a pixel.
    """
    w = seq.block_window(KEYS, "track_age")
    b = track_rows(obs, size)
    lag = {c: F.lag(c, 1).over(w) for c in ("cx", "cy", "w", "h", "t")}
    b = b.select("*", *[v.alias(f"p{c}") for c, v in lag.items()])
    dx, dy = F.col("cx") - F.col("pcx"), F.col("cy") - F.col("pcy")
    kmh = hypot(dx, dy) * METRES_PER_PIXEL / dt * 3.6 if dt > 0 else F.lit(0.0)
    first = F.col("track_age") == 1
    b = b.withColumn("speed_kmh", F.when(first, F.lit(0.0)).otherwise(kmh))
    small = (F.abs(dx) < 0.5) & (F.abs(dy) < 0.5)
    b = b.withColumn(
        "heading", F.when(first, F.lit(0.0)).when(~small, wrap_heading(dx, dy)))
    halted = F.col("speed_kmh") <= STOP_KMH
    b = b.withColumn("_go", F.lag("speed_kmh", 1).over(w) > STOP_KMH)
    b = b.withColumn("_stop_t", F.when(halted & (first | F.col("_go")), F.col("t")))
    b = seq.carry_last(b, KEYS, ["heading", "_stop_t"], pos="track_age", size=size,
                       halo=_HALO, depth=2)
    rad = F.radians("heading")
    fx, fy = F.sin(rad), -F.cos(rad)
    along = dx * fx + dy * fy
    lateral = hypot(dx - along * fx, dy - along * fy)
    area, parea = F.col("w") * F.col("h"), F.col("pw") * F.col("ph")
    b = b.select(
        "*",
        F.when(first, F.lit(0.0)).otherwise(
            (F.col("speed_kmh") / 3.6 - F.lag("speed_kmh", 1).over(w) / 3.6) / dt
        ).alias("acceleration"),
        F.when(first, F.lit(0.0)).otherwise(
            turn(F.col("heading"), F.lag("heading", 1).over(w))).alias("heading_change"),
        F.when(first, F.lit(0.0)).otherwise(lateral).alias("lateral_speed"),
        F.when(halted, F.col("t") - F.col("_stop_t")).otherwise(F.lit(0.0)).alias("stop_duration"),
        F.when(parea > 0, (area - parea) / parea * 100).otherwise(F.lit(0.0))
        .alias("area_change_rate"),
        F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(F.lit(1.0)).alias("aspect_ratio"),
    )
    return seq.body(b).drop("_go", "_stop_t", "pw", "ph")


def heading_deviation(m: DataFrame, expected: float | None = None) -> DataFrame:
    """Deviation from the expected heading, else from the circular mean of at least three others."""
    if expected is not None:
        return m.withColumn("heading_deviation", turn(F.col("heading"), F.lit(expected)))
    rad = F.radians("heading")
    frame = m.groupBy(*FRAME).agg(
        F.sum(F.sin(rad)).alias("_s"), F.sum(F.cos(rad)).alias("_c"), F.count("*").alias("_n"))
    mean = F.degrees(F.atan2(F.col("_s") - F.sin(rad), F.col("_c") - F.cos(rad)))
    mean = F.when(mean < 0, mean + 360).otherwise(mean)
    dev = F.when(F.col("_n") > 3, turn(F.col("heading"), mean)).otherwise(F.lit(0.0))
    return m.join(frame, FRAME).withColumn("heading_deviation", dev).drop("_s", "_c", "_n")


def frame_flow(m: DataFrame, size: int = seq.BLOCK) -> DataFrame:
    """Mean speed per frame and the mean of the previous 300 frame means (null on the first)."""
    f = m.groupBy(*FRAME).agg(F.avg("speed_kmh").alias("frame_speed"),
                              F.count("*").alias("n_tracks"))
    b = seq.blocks(f, ["camera_id"], ["frame_idx"], F.floor(F.col("frame_idx") / FRAME_CHUNK),
                   size=size, halo=FLOW_FRAMES)
    w = seq.block_window(["camera_id"])
    b = b.withColumn("flow_speed", F.avg("frame_speed").over(w.rowsBetween(-FLOW_FRAMES, -1)))
    return seq.body(b).drop("_g")


def same_lane(a: str, b: str):
    over = F.greatest(
        F.lit(0.0), F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2"))
        - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1")))
    width = F.least(F.col(f"{a}.w"), F.col(f"{b}.w"))
    return (width > 0) & (over / width > LANE_OVERLAP)


def pair_ttc_expr(a: str, b: str, on_road=None):
    """Seconds to contact from the last two positions of two tracks; null when not closing.

    Where the boolean `on_road` holds, positions are those of the road plane (wx, wy, pwx, pwy).
    """
    def d(x, y):
        return hypot(F.col(f"{b}.{x}") - F.col(f"{a}.{x}"), F.col(f"{b}.{y}") - F.col(f"{a}.{y}"))

    before, now = d("pcx", "pcy"), d("cx", "cy")
    if on_road is not None:
        before, now = F.when(on_road, d("pwx", "pwy")).otherwise(before), F.when(on_road, d("wx", "wy")).otherwise(now)
    dt = ((F.col(f"{a}.t") - F.col(f"{a}.pt")) + (F.col(f"{b}.t") - F.col(f"{b}.pt"))) / 2
    closing = (before - now) / dt
    return F.when(dt <= 0, None).when(closing <= 0, None).when(now <= 0, F.lit(0.0)).otherwise(
        now / closing)


_PAIR_COLS = ["camera_id", "frame_idx", "track_id", "cx", "cy", "pcx", "pcy", "t", "pt", "x1", "x2",
              "w"]


def on_plane(m: DataFrame, planes: DataFrame) -> DataFrame:
    """`m` with its two last positions on the road plane of its camera and `calibrated`, whether it has one.

    `planes` has a row for each calibrated camera: camera_id, h (array of nine doubles, row by row) and scale (metres a
    pixel, for points near the horizon). Cameras without a row or without a matrix are not calibrated.
    """
    from tarmac.functions.geo import project

    p = planes.where("h IS NOT NULL").groupBy("camera_id").agg(F.min(F.struct("h", F.coalesce("scale", F.lit(METRES_PER_PIXEL)).alias("scale"))).alias("_plane"))
    out = m.join(p, "camera_id", "left")
    at = lambda x, y: project(F.col(x), F.col(y), F.col("_plane.h"), F.col("_plane.scale"))
    out = out.withColumn("calibrated", F.col("_plane").isNotNull()).withColumn("_now", at("cx", "cy")).withColumn("_then", at("pcx", "pcy"))
    return out.select(*m.columns, "calibrated", F.col("_now.x").alias("wx"), F.col("_now.y").alias("wy"),
                      F.col("_then.x").alias("pwx"), F.col("_then.y").alias("pwy"))


def pair_ttc(m: DataFrame, lane_filter: bool = True, planes: DataFrame | None = None) -> DataFrame:
    """Closing pairs of one frame, a < b. Only pairs that pass the lane test leave the join.

    With `planes` (see `on_plane`) pairs of calibrated cameras are measured in metres on the road, which perspective
    does not distort; the lane test stays one of pixels. Adds `calibrated` then.
    """
    s = m.select(*_PAIR_COLS).where(F.col("pt").isNotNull())
    if planes is not None:
        s = on_plane(s, planes)
    on = (
        (F.col("a.camera_id") == F.col("b.camera_id"))
        & (F.col("a.frame_idx") == F.col("b.frame_idx"))
        & (F.col("a.track_id") < F.col("b.track_id"))
    )
    if lane_filter:
        on = on & same_lane("a", "b")
    road = F.col("a.calibrated") if planes is not None else None
    return (
        s.alias("a").join(s.alias("b"), on)
        .select("a.camera_id", "a.frame_idx", F.col("a.track_id").alias("track_a"),
                F.col("b.track_id").alias("track_b"), pair_ttc_expr("a", "b", road).alias("ttc"), *([road.alias("calibrated")] if planes is not None else []))
        .where("ttc is not null")
    )


def surroundings(m: DataFrame, radius: float = NEIGHBOUR_RADIUS_PX,
                 reach: float = GAP_RANGE_PX) -> DataFrame:
    """Nearest vehicle ahead and behind within `reach`, and vehicles within `radius`.

    The frame is split into `reach`-sized cells and each vehicle is offered to its 3x3 cells, so a
    crowded frame is spread over cells and far pairs never meet.
    """
    rad = F.radians("heading")
    s = m.select(*FRAME, "track_id", "cx", "cy", c_float(math.sin, F.sin, rad).alias("fx"),
                 (-c_float(math.cos, F.cos, rad)).alias("fy"))
    cell = lambda c: F.floor(F.col(c) / reach)
    left = s.withColumn("gx", cell("cx")).withColumn("gy", cell("cy"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = (
        s.select(*FRAME, F.col("track_id").alias("o_id"), F.col("cx").alias("ox"),
                 F.col("cy").alias("oy"), cell("cx").alias("gx0"), cell("cy").alias("gy0"))
        .withColumn("dx_", F.explode(near)).withColumn("dy_", F.explode(near))
        .select(*FRAME, "o_id", "ox", "oy", (F.col("gx0") + F.col("dx_")).alias("gx"),
                (F.col("gy0") + F.col("dy_")).alias("gy"))
    )
    dx, dy = F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy")
    proj = dx * F.col("fx") + dy * F.col("fy")
    pairs = (
        left.join(right, [*FRAME, "gx", "gy"])
        .where((F.col("track_id") != F.col("o_id")) & (hypot(dx, dy) <= reach))
        .select(*FRAME, "track_id", hypot(dx, dy).alias("d"), proj.alias("p"))
    )
    agg = pairs.groupBy(*FRAME, "track_id").agg(
        F.min(F.when(F.col("p") > 0, F.col("d"))).alias("gap_front"),
        F.min(F.when(F.col("p") < 0, F.col("d"))).alias("gap_rear"),
        F.count_if(F.col("d") <= radius).alias("neighbor_count"),
    )
    return m.join(agg, [*FRAME, "track_id"], "left").fillna(
        {"gap_front": NO_GAP, "gap_rear": NO_GAP, "neighbor_count": 0})


def features(obs: DataFrame, dt: float = 1.0, expected: float | None = None,
             size: int = seq.BLOCK) -> DataFrame:
    """All fifteen features of every observation."""
    m = stage(motion(obs, dt, size))
    ttc = pair_ttc(m)
    per_track = (
        ttc.select(*FRAME, F.explode(F.array("track_a", "track_b")).alias("track_id"), "ttc")
        .groupBy(*FRAME, "track_id").agg(F.min("ttc").alias("ttc_min"))
    )
    out = surroundings(heading_deviation(m, expected))
    out = out.join(per_track, [*FRAME, "track_id"], "left").fillna({"ttc_min": NO_TTC})
    out = out.join(frame_flow(m, size), FRAME)
    diff = F.col("speed_kmh") - F.coalesce("flow_speed", "speed_kmh")
    return out.withColumn("speed_diff_flow", diff).drop("pcx", "pcy", "pt")


def moving_average(feats: DataFrame, cols=FEATURES, size: int = seq.BLOCK, extra_halo: int = 0):
    """Mean of each feature over the track's last five frames, suffixed `_ma`."""
    b = seq.cut(feats, "track_age", size, MA_FRAMES - 1 + extra_halo)
    w = seq.block_window(KEYS, "track_age").rowsBetween(-(MA_FRAMES - 1), 0)
    return b.select("*", *[F.avg(c).over(w).alias(f"{c}_ma") for c in cols])


def calibrated_speed(obs: DataFrame, homography, scale: float = METRES_PER_PIXEL,
                     size: int = seq.BLOCK) -> DataFrame:
    """Speed on the road plane; `homography` is a Column of nine doubles or null."""
    from tarmac.functions.geo import project

    w = seq.block_window(KEYS, "track_age")
    b = track_rows(obs, size, 2)
    b = b.withColumn("_w", project(F.col("cx"), F.col("cy"), homography, F.lit(scale)))
    d = hypot(F.col("_w.x") - F.lag("_w.x", 1).over(w), F.col("_w.y") - F.lag("_w.y", 1).over(w))
    dt = F.col("t") - F.lag("t", 1).over(w)
    b = b.withColumn(
        "world_kmh",
        F.when(F.col("track_age") == 1, None).when(dt <= 0, F.lit(0.0)).otherwise(d / dt * 3.6))
    return seq.body(b).drop("_w")


def circular_mean(sin_sum, cos_sum):
    deg = F.degrees(F.atan2(sin_sum, cos_sum))
    return F.when(deg < 0, deg + 360).otherwise(deg)


