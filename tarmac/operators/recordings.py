"""Recording inventory: health, coverage, retention, quality, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.clock import valid_day
from tarmac.operators import sequence as seq

# fixed values: staleness, size and quality limits
STALE, VALID_STALE = 900, 1800
ACTIVE_SEC, GOOD_BYTES = 300, 1 << 20
MIN_W, MIN_H, MIN_FPS, MIN_SEC = 640, 480, 15.0, 10.0
KEEP_DAYS = 21


def camera_health(files: DataFrame, expected: DataFrame, now: Column) -> DataFrame:
    """State of every expected camera. files: camera, path, length, mtime (epoch seconds)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    s = files.where(ext.isin("mp4", "ts")).groupBy("camera").agg(
        F.sum("length").alias("bytes_total"), F.count("*").alias("files_total"),
        F.count_if(ext == "mp4").alias("mp4_count"), F.count_if(ext == "ts").alias("ts_count"),
        F.count_if(F.col("length") == 0).alias("zero_count"), F.max("mtime").alias("latest"),
        F.max(F.when(F.col("length") > 0, F.col("mtime"))).alias("latest_valid"),
        F.max(F.when(F.col("length") >= GOOD_BYTES, F.col("mtime"))).alias("latest_good"))
    h = expected.select("camera").distinct().join(s, "camera", "left").fillna(0, [
        "bytes_total", "files_total", "mp4_count", "ts_count", "zero_count"])
    status = (
        F.when(F.col("latest").isNull(), "문제").when(now - F.col("latest") > STALE, "문제")
        .when(F.col("latest_valid").isNull(), "주의")
        .when(now - F.col("latest_valid") > VALID_STALE, "주의").otherwise("정상"))
    note = (
        F.when(F.col("latest").isNull(), "파일 없음").when(now - F.col("latest") > STALE, "최신파일 미갱신")
        .when(F.col("latest_valid").isNull(), "유효 파일 없음")
        .when(now - F.col("latest_valid") > VALID_STALE, "최신유효파일 미갱신").otherwise(""))
    active = F.coalesce(now - F.col("latest_good") <= ACTIVE_SEC, F.lit(False))
    return h.withColumn("status", status).withColumn("note", note).withColumn("active", active)


def totals(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count("*").alias("cameras_total"), F.count_if("active").alias("cameras_active"),
        F.sum("bytes_total").alias("day_bytes"), F.sum("zero_count").alias("zero_byte_files"),
        F.count_if(~F.col("active")).alias("stale_cameras"))


def metrics(total: DataFrame) -> DataFrame:
    """Totals in long form, one (metric, value) per row."""
    vals = [F.col(c).cast("double").alias(f"cctv_recording_{c}") for c in total.columns]
    wide = total.select(*vals)
    return wide.unpivot([], wide.columns, "metric", "value")


def coverage(incidents: DataFrame, files: DataFrame) -> DataFrame:
    """The last file of the incident's day and camera. incidents: event_id, camera, day."""
    last = files.groupBy("camera", "day").agg(F.max("path").alias("file"))
    return incidents.join(last, ["camera", "day"], "left")


def expired(files: DataFrame, today: Column, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Day folders older than `keep_days` with a real date, and what deleting them frees."""
    day = valid_day("day")
    old = files.where(day < F.date_sub(today, keep_days))
    return old.groupBy("day").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def media_quality(media: DataFrame) -> DataFrame:
    """Failures of each file: resolution, frame rate, length."""
    failures = F.array_compact(F.array(
        F.when((F.col("width") < MIN_W) | (F.col("height") < MIN_H), "resolution"),
        F.when(F.col("fps") < MIN_FPS, "fps"), F.when(F.col("duration") < MIN_SEC, "duration")))
    return media.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def gaps(files: DataFrame, limit: float, start: Column, end: Column,
         size: int = seq.BLOCK) -> DataFrame:
    """Recording gaps longer than `limit` seconds and uptime per camera. files: camera, mtime, path."""
    b = seq.blocks(files, ["camera"], ["mtime", "path"], F.floor(F.col("mtime") / 86_400), size=size, halo=1)
    step = F.col("mtime") - F.lag("mtime", 1).over(seq.block_window(["camera"]))
    g = seq.body(b.withColumn("gap", step)).withColumn("gap", F.when(F.col("gap") > limit, F.col("gap")))
    s = g.groupBy("camera").agg(
        F.count("*").alias("files"), F.count("gap").alias("gap_count"),
        F.coalesce(F.sum("gap"), F.lit(0)).alias("gap_seconds"))
    up = (1 - F.col("gap_seconds") / F.greatest(end - start, F.lit(1))) * 100
    return s.withColumn("uptime_pct", F.greatest(F.lit(0.0), F.least(F.lit(100.0), up)))


def stalls(checks: DataFrame, size: int = seq.BLOCK) -> DataFrame:
    """Checks at which a file had not grown. checks: path, check_t, length."""
    b = seq.blocks(checks, ["path"], ["check_t"], F.floor(F.col("check_t") / 86_400), size=size, halo=1)
    prev = F.lag("length", 1).over(seq.block_window(["path"]))
    return seq.body(b.withColumn("stalled", F.coalesce(F.col("length") == prev, F.lit(False)))).drop("_g")


def followups(events: DataFrame, media: DataFrame, before: float, after: float,
              bucket: float = 3600.0) -> DataFrame:
    """Recordings whose start lies in [t - before, t + after] of a trigger, with their quality.

    Time is cut into buckets so this is an equi-join on (camera, bucket).
    """
    lo, hi = F.floor((F.col("t") - before) / bucket), F.floor((F.col("t") + after) / bucket)
    e = events.withColumn("_b", F.explode(F.sequence(lo, hi)))
    m = media_quality(media).withColumn("_b", F.floor(F.col("start_t") / bucket))
    return e.join(m, ["camera_id", "_b"]).where(
        F.col("start_t").between(F.col("t") - before, F.col("t") + after)).drop("_b")
