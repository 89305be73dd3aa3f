"""Frame-level candidate signals: runs, streaks, variance, wrong-way movement, pre-filter scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators import sequence as seq

_FRAME_CHUNK = 4096
# fixed values: pre-filter thresholds
FG_LOW, FG_HIGH, DIFF_MAX, HIST_MIN, WARM_UP = 0.02, 0.40, 30.0, 0.4, 50


def _frame_chunk():
    return F.floor(F.col("frame_idx") / _FRAME_CHUNK)


def runs_below(obs: DataFrame, value: str, limit: float, size: int = seq.BLOCK) -> DataFrame:
    """One row per unbroken run of `value <= limit` of a track."""
    keys = ["camera_id", "track_id"]
    b = seq.blocks(obs, keys, ["frame_idx"], _frame_chunk(), size=size, halo=1)
    prev = F.lag(value, 1).over(seq.block_window(keys))
    low = F.col(value) <= limit
    b = b.withColumn("_start", low & ((F.col("_g") == 1) | (prev > limit)))
    b = seq.islands(b, keys, F.col("_start"), "run", size=size, halo=1, depth=1)
    return seq.body(b).where(low).groupBy(*keys, "run").agg(
        F.count("*").alias("frames"), (F.max("t") - F.min("t")).alias("seconds"),
        F.max("_g").alias("last_age"))


def speed_variance(obs: DataFrame, history: int = 300, least: int = 10, sigma: float = 2.0,
                   min_tracks: int = 3, size: int = seq.BLOCK) -> DataFrame:
    """Frames whose mean speed is `sigma` deviations off the last `history` frame means."""
    f = obs.groupBy("camera_id", "frame_idx").agg(
        F.avg("speed").alias("frame_speed"), F.count("speed").alias("n"))
    f = f.where(F.col("n") >= min_tracks)
    b = seq.blocks(f, ["camera_id"], ["frame_idx"], _frame_chunk(), size=size, halo=history - 1)
    w = seq.block_window(["camera_id"]).rowsBetween(-(history - 1), 0)
    b = b.select("*", F.avg("frame_speed").over(w).alias("_m"),
                 F.stddev_pop("frame_speed").over(w).alias("_s"))
    dev = F.abs(F.col("frame_speed") - F.col("_m")) / F.col("_s")
    out = seq.body(b).where((F.col("_g") >= least) & (F.col("_s") >= 1.0))
    return out.withColumn("deviation", dev).where(F.col("deviation") >= sigma)


def ttc_streaks(pairs: DataFrame, low: float = 0.5, high: float = 2.0, need: int = 4,
                size: int = seq.BLOCK) -> DataFrame:
    """Length of each pair's run of consecutive frames inside [low, high]; fires every `need`."""
    keys = ["camera_id", "track_a", "track_b"]
    p = pairs.where(F.col("ttc").between(low, high))
    b = seq.blocks(p, keys, ["frame_idx"], _frame_chunk(), size=size, halo=1)
    prev = F.lag("frame_idx", 1).over(seq.block_window(keys))
    b = b.withColumn("_start", (F.col("_g") == 1) | (F.col("frame_idx") - prev > 1))
    b = seq.islands(b, keys, F.col("_start"), "_run", size=size, halo=1, depth=1)
    s = seq.body(b).withColumn("streak", F.col("_g") - F.col("_run") + 1)
    return s.withColumn("fires", F.col("streak") % need == 0).drop("_start", "_run", "_g")


def wrong_way(obs: DataFrame, min_move: float = 50.0, min_others: int = 3, min_norm: float = 0.3,
              below: float = -0.7) -> DataFrame:
    """Vehicles moving against the mean direction of at least three others in the frame.

    Directions run from each track's first position, found by an aggregate rather than a window.
    """
    keys = ["camera_id", "track_id"]
    start = obs.groupBy(*keys).agg(
        F.min_by(F.struct("cx", "cy", "frame_idx"), "frame_idx").alias("i"))
    d = obs.join(start, keys).where(F.col("frame_idx") > F.col("i.frame_idx"))
    dx, dy = F.col("cx") - F.col("i.cx"), F.col("cy") - F.col("i.cy")
    dist = F.sqrt(dx * dx + dy * dy)
    u = d.where(dist >= min_move).select(
        "camera_id", "frame_idx", "track_id", F.try_divide(dx, dist).alias("ux"),
        F.try_divide(dy, dist).alias("uy"))
    s = u.groupBy("camera_id", "frame_idx").agg(
        F.sum("ux").alias("sx"), F.sum("uy").alias("sy"), F.count("*").alias("n"))
    o = u.join(s, ["camera_id", "frame_idx"]).where(F.col("n") - 1 >= min_others)
    o = o.withColumn("ax", F.try_divide(F.col("sx") - F.col("ux"), F.col("n") - 1)).withColumn(
        "ay", F.try_divide(F.col("sy") - F.col("uy"), F.col("n") - 1))
    norm = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay"))
    o = o.where(norm >= min_norm)
    cosine = (F.col("ux") * F.col("ax") + F.col("uy") * F.col("ay"))
    return o.withColumn("cosine", F.try_divide(cosine, norm)).where(F.col("cosine") < below)


def exact_mean(value: str) -> Column:
    """Mean of a column of doubles (to twelve decimals) that the order of its rows can't move across a limit.

    Summed as doubles, values whose mean is a limit may come out beside it. Values that no decimal holds are summed as they are.
    """
    d = F.col(value).try_cast("decimal(30,12)")
    return F.when(F.count(d) == F.count(value), F.avg(d).cast("double")).otherwise(F.avg(value))


def frame_score(frames: DataFrame) -> DataFrame:
    """Fuse foreground share, frame difference, static object and histogram correlation.

    Foreground is ignored during the first fifty frames of a camera (`frame_no` counts from one).
    """
    warm = F.col("frame_no") > WARM_UP
    fg, diff, hist = F.col("fg_ratio"), F.col("diff_mean"), F.col("hist_corr")
    one = F.lit(1.0)
    checks = [
        ("fg_ratio_low", warm & (fg < FG_LOW), F.least(F.lit(0.3), one - fg / FG_LOW)),
        ("fg_ratio_high", warm & (fg > FG_HIGH), F.least(one, fg / FG_HIGH - 0.5)),
        ("frame_diff", diff > DIFF_MAX, F.least(one, diff / (DIFF_MAX * 3))),
        ("static_object", F.col("has_static"), F.lit(0.7)),
        ("hist_change", hist < HIST_MIN, F.least(one, one - hist / HIST_MIN)),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, c, _ in checks]))
    top = F.greatest(*[F.when(c, s) for _, c, s in checks])
    return (frames.withColumn("reasons", reasons)
            .withColumn("score", F.coalesce(top, F.lit(0.0)))
            .withColumn("is_anomaly", F.size("reasons") > 0))


def detection_quality(m: DataFrame) -> DataFrame:
    """Per camera: tracks, class-unstable tracks, mean centre movement, polygon hits, persons."""
    jitter = F.sqrt(F.pow(F.col("cx") - F.col("pcx"), F.lit(2))
                    + F.pow(F.col("cy") - F.col("pcy"), F.lit(2)))
    per_track = m.groupBy("camera_id", "track_id").agg(
        F.count_distinct("cls").alias("nc"), F.sum(jitter).alias("j"), F.count(jitter).alias("jn"),
        F.count_if("inside").alias("i"), F.count_if(~F.col("inside")).alias("o"),
        F.count_if(F.col("cls") == "person").alias("p"))
    return per_track.groupBy("camera_id").agg(
        F.count("*").alias("unique_tracks"), F.count_if(F.col("nc") > 1).alias("unstable_class_tracks"),
        (F.sum("j") / F.sum("jn")).alias("mean_jitter"), F.sum("i").alias("in_roi"),
        F.sum("o").alias("out_roi"), F.sum("p").alias("persons"))
