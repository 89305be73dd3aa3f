"""Interval traffic flow, directional counting, track summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators import sequence as seq

TRUCK_CLASSES = [f"T{i}" for i in range(3, 13)]
MIN_TRACK_FRAMES = 4
MIN_DISPLACE_PX = 12.0


def floor_to(ts, seconds: int) -> Column:
    """Start of the epoch-aligned interval holding ts, in epoch seconds."""
    return F.floor(F.unix_timestamp(ts) / seconds).cast("long") * seconds


def first_sightings(obs_speed: DataFrame, seconds: int, tie: str) -> DataFrame:
    """Each track's first observation inside each period."""
    o = obs_speed.withColumn("period_start", floor_to("ts", seconds))
    return (
        o.groupBy("ic_name", "period_start", "track_id")
        .agg(F.min_by(F.struct("speed", "vehicle_cls"), F.struct("ts", tie)).alias("f"))
        .select("ic_name", "period_start", "track_id", F.col("f.speed").alias("speed"),
                F.col("f.vehicle_cls").alias("vehicle_cls"))
    )


def flow_of(first: DataFrame, by=("ic_name", "period_start")) -> DataFrame:
    n = F.count("*")
    trucks = F.count_if(F.col("vehicle_cls").isin(TRUCK_CLASSES))
    return first.groupBy(*by).agg(
        n.alias("volume"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("avg_speed"),
        F.coalesce(F.stddev_pop("speed"), F.lit(0.0)).alias("speed_std"),
        (trucks / n).alias("truck_ratio"),
    )


def traffic_flow(obs_speed: DataFrame, seconds: int = 300, tie: str = "track_id") -> DataFrame:
    """Volume, mean and spread of speed and truck share per interchange and period."""
    return flow_of(first_sightings(obs_speed, seconds, tie))


def bucket(cls: Column, coco: Column | None = None) -> Column:
    """Four counting buckets from a class code, else from a detector class number."""
    # fixed values: the four counting buckets
    b = (
        F.when(cls == "T1", "승용차").when(cls == "T2", "버스").when(cls == "T13", "이륜차")
        .when(cls.isin(TRUCK_CLASSES), "화물차")
    )
    if coco is None:
        return b
    return F.coalesce(b, F.when(coco == 2, "승용차").when(coco == 3, "이륜차")
                      .when(coco == 5, "버스").when(coco == 7, "화물차"))


def line_crossings(
    obs: DataFrame, y_line: Column, band: tuple[Column, Column] | None = None,
    up: str = "방향A", down: str = "방향B", size: int = seq.BLOCK,
) -> DataFrame:
    """First crossing of the counting line per track, with the track's modal bucket so far."""
    keys = ["camera_id", "track_id"]
    b = seq.blocks(obs, keys, ["frame_idx"], F.floor(F.col("frame_idx") / 4096), size=size, halo=1)
    py = F.lag("cy", 1).over(seq.block_window(keys))
    y = F.col("cy")
    crossed = ((F.col("py") < y_line) & (y >= y_line)) | ((F.col("py") >= y_line) & (y < y_line))
    if band is not None:
        crossed = crossed & y.between(*band)
    b = seq.body(b.withColumn("py", py)).withColumn("crossed", crossed)
    hit = b.where("crossed").groupBy(*keys).agg(
        F.min_by(F.struct("frame_idx", "cy", "py"), "frame_idx").alias("x"))
    hit = hit.select(*keys, F.col("x.frame_idx").alias("cross_frame"),
                     F.when(F.col("x.cy") > F.col("x.py"), down).otherwise(up).alias("direction"))
    seen = (
        b.withColumn("bucket", bucket(F.col("cls"))).where("bucket is not null")
        .join(hit.select(*keys, "cross_frame"), keys)
        .where(F.col("frame_idx") <= F.col("cross_frame"))
    )
    mode = modal(seen, keys, "bucket", "frame_idx").withColumnRenamed("bucket", "cls_name")
    return hit.join(mode, keys, "left").fillna({"cls_name": "미분류"})


def modal(df: DataFrame, keys, value: str, pos: str) -> DataFrame:
    """Most frequent value per key; the one seen first wins ties."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    best = F.max_by(value, F.struct(F.col("_n"), -F.col("_first")))
    return n.groupBy(*keys).agg(best.alias(value))


def directional_counts(crossings: DataFrame, per: list[str]) -> DataFrame:
    """Volume and class map per direction; two-stage so a busy camera is pre-counted."""
    n = crossings.groupBy(*per, "direction", "cls_name").agg(F.count("*").alias("n"))
    return n.groupBy(*per, "direction").agg(
        F.sum("n").alias("volume"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls_name", "n"))))
        .alias("by_class"),
    )


def net_displacement(obs: DataFrame) -> DataFrame:
    """First-to-last movement of each track and whether it counts."""
    ends = obs.groupBy("camera_id", "track_id").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("cx", "cy"), "frame_idx").alias("a"),
        F.max_by(F.struct("cx", "cy"), "frame_idx").alias("z"),
    )
    d = ends.select("camera_id", "track_id", "n", (F.col("z.cx") - F.col("a.cx")).alias("dx"),
                    (F.col("z.cy") - F.col("a.cy")).alias("dy"))
    d = d.withColumn("disp", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return d.withColumn(
        "status",
        F.when(F.col("n") < MIN_TRACK_FRAMES, "dropped_short")
        .when(F.col("disp") < MIN_DISPLACE_PX, "dropped_static").otherwise("counted"))


def principal_axis(disp: DataFrame, by=("camera_id",)) -> DataFrame:
    """Unit vector of largest second moment; the sign points down-screen, else rightwards."""
    m = disp.groupBy(*by).agg(
        F.avg(F.col("dx") * F.col("dx")).alias("xx"), F.avg(F.col("dx") * F.col("dy")).alias("xy"),
        F.avg(F.col("dy") * F.col("dy")).alias("yy"))
    ang = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    ax, ay = F.cos(ang), F.sin(ang)
    flip = F.when((F.col("_y") < 0) | ((F.col("_y") == 0) & (F.col("_x") < 0)), -1.0).otherwise(1.0)
    return (
        m.withColumn("_x", ax).withColumn("_y", ay)
        .select(*by, (F.col("_x") * flip).alias("ax"), (F.col("_y") * flip).alias("ay"))
    )


def direction_labels(ax: Column, ay: Column) -> tuple[Column, Column]:
    vertical = F.abs(ay) >= F.abs(ax)
    a = F.when(vertical, F.when(ay < 0, "방향A(화면상단행)").otherwise("방향A(화면하단행)")).otherwise(
        F.when(ax > 0, "방향A(화면우측행)").otherwise("방향A(화면좌측행)"))
    b = F.when(vertical, F.when(ay < 0, "방향B(화면하단행)").otherwise("방향B(화면상단행)")).otherwise(
        F.when(ax > 0, "방향B(화면좌측행)").otherwise("방향B(화면우측행)"))
    return a, b


def track_summary(obs: DataFrame, keys, cls: str = "cls", speed: str = "speed",
                  recent: int = 10) -> DataFrame:
    """First and last frame, last known class and mean of the last `recent` speeds per track.

    Positions come from `number_rows`, so no track is sorted as a whole; only rows in a track's
    last `recent` positions reach the second aggregate.
    """
    keys = list(keys)
    n = seq.number_rows(obs, keys, ["frame_idx"], F.floor(F.col("frame_idx") / 4096))
    ends = n.groupBy(*keys).agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"),
        F.max("_g").alias("n"),
        F.max_by(cls, F.when(F.col(cls).isNotNull(), F.col("frame_idx"))).alias("last_cls"))
    tail = n.join(ends.select(*keys, "n"), keys).where(F.col("_g") > F.col("n") - recent)
    return ends.join(tail.groupBy(*keys).agg(F.avg(speed).alias("recent_speed")), keys)


