"""Frames and context around a trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators import sequence as seq
from tarmac.session import stage

MAX_FRAMES, MIN_GAP_SEC, WINDOW_SEC = 5, 1.0, 10.0


def quality(area: Column, conf: Column, cx: Column, cy: Column, w: float = 1920.0, h: float = 1080.0):
    """Box share of the frame x confidence x closeness to the centre."""
    share = F.least(F.lit(1.0), area / (w * h))
    central = F.greatest(F.lit(0.0), 1 - (F.abs(cx - w / 2) / (w / 2) + F.abs(cy - h / 2) / (h / 2)) / 2)
    return share * conf * central


def frame_quality(obs: DataFrame, conf: Column) -> DataFrame:
    """Best box quality of every frame."""
    q = quality(F.col("w") * F.col("h"), conf, F.col("cx"), F.col("cy"))
    return obs.groupBy("camera_id", "frame_idx").agg(F.max(q).alias("q"), F.max("t").alias("t"))


def window_frames(triggers: DataFrame, frames: DataFrame, reach: int) -> DataFrame:
    """Frames within `reach` of each trigger: an equi-join on (camera, frame range)."""
    lo = F.floor((F.col("trigger_frame") - reach) / (reach + 1))
    hi = F.floor((F.col("trigger_frame") + reach) / (reach + 1))
    t = triggers.withColumn("_b", F.explode(F.sequence(lo, hi)))
    f = frames.withColumn("_b", F.floor(F.col("frame_idx") / (reach + 1)))
    return t.join(f, ["camera_id", "_b"]).where(
        F.abs(F.col("frame_idx") - F.col("trigger_frame")) <= reach).drop("_b")


def select(window: DataFrame, max_frames: int = MAX_FRAMES, min_gap: float = MIN_GAP_SEC) -> DataFrame:
    """Trigger frame plus the best frames at least `min_gap` seconds from those already taken.

    A trigger's window is at most 2 * reach + 1 frames, so the walk is over a small array.
    """
    items = F.array_sort(F.collect_list(F.struct(
        (-F.col("q")).alias("o"), F.col("frame_idx").alias("f"), F.col("t").alias("t"))))
    g = window.groupBy("camera_id", "event_id", "trigger_frame", "trigger_t").agg(items.alias("s"))
    start = F.struct(F.array(F.col("trigger_frame")).cast("array<bigint>").alias("f"),
                     F.array(F.col("trigger_t").cast("double")).alias("t"))

    def take(acc, it):
        free = F.forall(acc["t"], lambda x: F.abs(x - it["t"]) >= min_gap)
        ok = (F.size(acc["f"]) < max_frames) & (it["f"] != F.col("trigger_frame")) & free
        return F.when(ok, F.struct(F.concat(acc["f"], F.array(it["f"])).alias("f"),
                                   F.concat(acc["t"], F.array(it["t"].cast("double"))).alias("t"))).otherwise(acc)

    picked = F.aggregate("s", start, take, lambda acc: F.array_sort(acc["f"]))
    return g.select("camera_id", "event_id", "trigger_frame", picked.alias("keyframes"))


def change_points(hist: DataFrame, keys, max_frames: int = MAX_FRAMES, size: int = seq.BLOCK) -> DataFrame:
    """First and last frame of each clip and the frames after the largest histogram jumps.

    Input: keys, frame_idx, hist array<double>. Distance is Bhattacharyya's on normalised bins. A clip is cut into blocks
    of `size` frames that carry the frame before them; each block names its best frames, and the clip's are among those.
    """
    keys = list(keys)
    b = seq.blocks(hist.select(*keys, "frame_idx", "hist"), keys, ["frame_idx"], F.floor(F.col("frame_idx") / 4096), size=size, halo=1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    h = b.withColumn("_p", F.lag("hist", 1).over(seq.block_window(keys)))
    bc = total(F.zip_with("hist", "_p", lambda a, b: F.sqrt(a * b)))
    scale = F.sqrt(total(F.col("hist")) * total(F.col("_p")))
    d = F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(bc, scale), F.lit(0.0))))
    h = h.withColumn("d", F.when(F.col("_p").isNotNull(), d)).where(~F.col("_halo")).select(*keys, "_blk", "_g", "frame_idx", "d")
    count = h.groupBy(*keys, "_blk").agg(F.max("_g").alias("_top")).groupBy(*keys).agg(F.max("_top").alias("_top"))
    first, last = F.col("_g") == 1, F.col("_g") == F.col("_top")
    order = [F.desc("_edge"), F.desc_nulls_last("d"), "frame_idx"]
    inside, across = (Window.partitionBy(*keys, *c).orderBy(*order) for c in (["_blk"], []))
    # a block's last frame may be the clip's, so it is always handed on
    ends = Window.partitionBy(*keys, "_blk")
    best = h.withColumn("_edge", first).withColumn("_rank", F.row_number().over(inside)).withColumn("_end", F.col("_g") == F.max("_g").over(ends))
    best = best.where((F.col("_rank") <= max_frames) | F.col("_end")).join(count, keys).withColumn("_edge", first | last)
    return best.withColumn("_rank", F.row_number().over(across)).where(F.col("_rank") <= max_frames).select(*keys, "frame_idx", "d")


def nearest_frame(triggers: DataFrame, frames: DataFrame, keys) -> DataFrame:
    """The stored frame closest to each trigger frame (the earlier one on a tie).

    Frames are spread over ranges of 256; a trigger looks into its own and the neighbouring ranges.
    One finding nothing there takes the closer of the last frame before and the first after, found
    on the ranges' first and last frames.
    """
    keys = list(keys)
    r = 256
    f = frames.select(*keys, "frame_idx").distinct()
    t = triggers.withColumn("_b", F.floor(F.col("trigger_frame") / r))
    near = t.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                                    lambda o: F.col("_b") + o)))
    gap = F.abs(F.col("frame_idx") - F.col("trigger_frame"))
    own = [*triggers.columns]
    best = near.join(f.withColumn("_b", F.floor(F.col("frame_idx") / r)), [*keys, "_b"]).where(
        gap <= r).groupBy(*own).agg(
        F.min_by("frame_idx", F.struct(gap, "frame_idx")).alias("frame_idx"))
    # the three ranges show every frame up to 256 away, so a hit within that is the closest overall
    rest = triggers.join(best, own, "left_anti")
    ends = f.withColumn("_b", F.floor(F.col("frame_idx") / r)).groupBy(*keys, "_b").agg(
        F.min("frame_idx").alias("_lo"), F.max("frame_idx").alias("_hi"))
    both = ends.unionByName(rest.withColumn("_b", F.floor(F.col("trigger_frame") / r)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_b")
    before = F.last("_hi", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_lo", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    sides = F.filter(F.array(before, after), lambda x: x.isNotNull())
    far = both.withColumn("_s", F.transform(sides, lambda x: F.struct(F.abs(x - F.col("trigger_frame")).alias("g"), x.alias("x")))).where(
        F.col("trigger_frame").isNotNull() & (F.size("_s") > 0)).select(*own, F.array_min("_s")["x"].alias("frame_idx"))
    return best.unionByName(far)


def neighbour_frames(triggers: DataFrame, frames: DataFrame, keys, spread: int = 5) -> DataFrame:
    """The stored frame closest to each trigger frame and those `spread` positions before and after it, without repeats.

    Positions count the stored frames of a key; near its ends the first or the last frame stands in. They are numbered by
    counts of ranges, so no key is sorted as a whole.
    """
    keys = list(keys)
    f = stage(seq.number_rows(frames.select(*keys, "frame_idx").distinct(), keys, ["frame_idx"], F.floor(F.col("frame_idx") / 4096), "_at"))
    last = f.groupBy(*keys).agg(F.max("_at").alias("_n"))
    mid = nearest_frame(triggers, f, keys).join(f, [*keys, "frame_idx"]).join(last, keys)
    places = F.array_distinct(F.array(F.greatest(F.lit(1), F.col("_at") - spread), F.col("_at"), F.least(F.col("_n"), F.col("_at") + spread)))
    return mid.select(*triggers.columns, F.explode(places).alias("_at")).join(f, [*keys, "_at"]).select(*triggers.columns, "frame_idx")


def trigger_context(triggers: DataFrame, latest: DataFrame, pairs: DataFrame,
                    calibrated: bool = False) -> DataFrame:
    """Involved tracks and closing pairs of each trigger.

    triggers: camera_id, event_id, frame_idx, involved_tracks; latest: state of each track at that
    frame (camera_id, frame_idx, track_id, track_age, speed_kmh, x1..y2); pairs: closing pairs.
    """
    t = triggers.select("camera_id", "event_id", "frame_idx", F.explode("involved_tracks").alias("track_id"))
    tr = t.join(latest, ["camera_id", "frame_idx", "track_id"], "left").groupBy(
        "camera_id", "event_id").agg(F.array_sort(F.collect_list(F.struct(
            "track_id", "track_age", "speed_kmh", "x1", "y1", "x2", "y2"))).alias("tracks"))
    touching = pairs.select("camera_id", "frame_idx", "track_a", "track_b", "ttc", F.explode(
        F.array("track_a", "track_b")).alias("track_id"))
    tt = t.join(touching, ["camera_id", "frame_idx", "track_id"]).select(
        "camera_id", "event_id", "track_a", "track_b", "ttc").distinct().groupBy(
        "camera_id", "event_id").agg(F.array_sort(F.collect_list(F.struct(
            "ttc", "track_a", "track_b"))).alias("ttc_pairs"))
    return tr.join(tt, ["camera_id", "event_id"], "left").withColumn("calibrated", F.lit(calibrated))
