"""Queries over trigger sequences: cooldown, consensus, recording, health, tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import episodes
from tarmac.plans.registry import query
from tarmac.sources import samples as S


def _chain_sql(rows, key, nxt):
    """Follow precomputed successors from each key's first row."""
    on = " AND ".join(f"n.{k} = c.{k}" for k in key)
    cols = ", ".join(key)
    ncols = ", ".join(f"n.{k}" for k in key)
    return f"""
chain AS (
  SELECT {cols}, min(rn) AS rn FROM {rows} GROUP BY {cols}
  UNION ALL SELECT {ncols}, n.nxt FROM chain c JOIN {nxt} n ON {on} AND n.rn = c.rn
  WHERE n.nxt IS NOT NULL)"""


@query("trigger_cooldown", f"""
WITH RECURSIVE {S.SQL_TRIG},
r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, type ORDER BY t, event_id) AS rn FROM trig),
nx AS (SELECT a.camera_id, a.type, a.rn, min(b.rn) AS nxt FROM r a
       LEFT JOIN r b ON a.camera_id = b.camera_id AND a.type = b.type AND b.t >= a.t + 60
       GROUP BY 1, 2, 3),
{_chain_sql('r', ['camera_id', 'type'], 'nx')}
SELECT r.camera_id, r.type, r.event_id, r.t FROM chain c
JOIN r ON r.camera_id = c.camera_id AND r.type = c.type AND r.rn = c.rn""")
def trigger_cooldown(spark, sf):
    t = S.triggers(spark, sf)
    return episodes.cooldown(t, ["camera_id", "type"]).select("camera_id", "type", "event_id", "t")


@query("trigger_consensus", f"""
WITH {S.SQL_TRIG},
f AS (SELECT * FROM trig WHERE type IN ('T1','T2','T3','T4','T5','T6') AND severity >= 0.5)
SELECT a.camera_id, a.event_id, a.type, a.t,
       a.type = 'T5' OR count(DISTINCT b.type) >= 2 AS accepted
FROM f a JOIN f b ON a.camera_id = b.camera_id AND b.t > a.t - 5 AND b.t <= a.t
GROUP BY 1, 2, 3, 4""")
def trigger_consensus(spark, sf):
    return episodes.consensus(S.triggers(spark, sf)).select(
        "camera_id", "event_id", "type", "t", "accepted")


SQL_EPISODES = S.SQL_TRIG + """,
f AS (SELECT *, row_number() OVER w AS rn, lead(t, 1) OVER w AS n1, lead(t, 2) OVER w AS n2 FROM trig
      WHERE type IN ('T1','T2','T3','T4','T5','T6') AND severity >= 0.5
      WINDOW w AS (PARTITION BY camera_id ORDER BY t, event_id)),
m AS (SELECT a.camera_id, a.rn, max(b.t) AS other FROM f a
      JOIN f b ON a.camera_id = b.camera_id AND b.t > a.t - 5 AND b.t <= a.t AND a.type <> b.type
      GROUP BY 1, 2),
p AS (SELECT f.*, CASE WHEN type = 'T5' THEN t ELSE other END AS backing,
             t + CASE WHEN n1 < t + 180 AND n2 < t + 240 THEN 300 WHEN n1 < t + 180 THEN 240
                      ELSE 180 END AS end_t
      FROM f LEFT JOIN m USING (camera_id, rn)),
s0 AS (SELECT * FROM p WHERE backing IS NOT NULL),
nx AS (SELECT a.camera_id, a.rn, min(b.rn) AS nxt FROM s0 a
       LEFT JOIN s0 b ON a.camera_id = b.camera_id AND b.backing >= a.end_t + 600 GROUP BY 1, 2),
""" + _chain_sql("s0", ["camera_id"], "nx")


@query("recording_episodes", f"""
WITH RECURSIVE {SQL_EPISODES}
SELECT s0.camera_id, s0.event_id, s0.type, s0.t AS start_t, CAST(end_t AS DOUBLE) AS end_t,
       CAST(end_t - s0.t AS DOUBLE) AS seconds
FROM chain c JOIN s0 ON s0.camera_id = c.camera_id AND s0.rn = c.rn""")
def recording_episodes(spark, sf):
    return episodes.recording_episodes(S.triggers(spark, sf)).drop("severity")


@query("periodic_trigger", f"""
WITH RECURSIVE {S.SQL_TRIG},
r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) AS rn FROM trig),
nx AS (SELECT a.camera_id, a.rn, min(b.rn) AS nxt FROM r a
       LEFT JOIN r b ON a.camera_id = b.camera_id AND b.t >= a.t + 300 GROUP BY 1, 2),
{_chain_sql('r', ['camera_id'], 'nx')}
SELECT r.camera_id, r.frame_idx, r.t FROM chain c
JOIN r ON r.camera_id = c.camera_id AND r.rn = c.rn WHERE c.rn > 1""")
def periodic_trigger(spark, sf):
    return episodes.periodic(S.triggers(spark, sf), ["camera_id"]).select(
        "camera_id", "frame_idx", "t")


FAIL_LIMIT = 3


SQL_HEALTH = f"""
WITH {S.SQL_TRIG},
h AS (SELECT camera_id, event_id, t, cls = 'person' OR k >= 70 AS failed FROM trig),
g AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) AS g,
             row_number() OVER (PARTITION BY camera_id, failed ORDER BY t, event_id) AS gf FROM h),
q AS (SELECT *, row_number() OVER (PARTITION BY camera_id, g - gf ORDER BY t) AS nth FROM g WHERE failed)
SELECT camera_id, min(g) AS run, count(*) AS failures, min(t) AS first_t,
       max(t) FILTER (nth = {FAIL_LIMIT}) AS disabled_t,
       max(t) FILTER (nth = {FAIL_LIMIT}) IS NOT NULL AS disabled,
       max(t) FILTER (nth = {FAIL_LIMIT}) + 1800 AS reprobe_t
FROM q GROUP BY camera_id, g - gf"""


def failures(spark, sf):
    return S.triggers(spark, sf).select("camera_id", "event_id", "t", ((F.col("cls") == "person") | (F.col("k") >= 70)).alias("failed"))


@query("stream_health", SQL_HEALTH)
def stream_health(spark, sf):
    return episodes.failure_runs(failures(spark, sf), FAIL_LIMIT)


@query("tier_counts", f"""
WITH {S.SQL_EV},
last AS (SELECT camera_id, track_id, arg_max(k, (ts, event_id)) AS k, count(*) AS frames,
                count(*) FILTER (speed <= 0.5) AS zero_frames FROM ev GROUP BY 1, 2)
SELECT CASE WHEN k >= 90 THEN 3 WHEN k >= 60 THEN 2 ELSE 1 END AS tier, k < 10 AS disabled,
       count(*) AS streams, CAST(sum(frames) AS BIGINT) AS frames,
       count(*) FILTER (zero_frames > 0) AS zero_frame_streams FROM last GROUP BY 1, 2""")
def tier_counts(spark, sf):
    last = S.ev(spark, sf).groupBy("camera_id", "track_id").agg(
        F.max_by("k", F.struct("ts", "event_id")).alias("k"), F.count("*").alias("frames"),
        F.count_if(F.col("speed") <= 0.5).alias("zero_frames"))
    tier = F.when(F.col("k") >= 90, 3).when(F.col("k") >= 60, 2).otherwise(1)
    return last.groupBy(tier.alias("tier"), (F.col("k") < 10).alias("disabled")).agg(
        F.count("*").alias("streams"), F.sum("frames").alias("frames"),
        F.count_if(F.col("zero_frames") > 0).alias("zero_frame_streams"))


SQL_TIER = f"""
WITH RECURSIVE {S.SQL_TRIG},
r AS MATERIALIZED (SELECT event_id, camera_id * 1000 + track_id AS cam, t, t + 60 AS until, row_number() OVER (ORDER BY t, event_id) AS rn FROM trig),
go AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, false AS admitted, CAST([] AS STRUCT(c BIGINT, u DOUBLE)[]) AS held
  UNION ALL
  SELECT rn, event_id, ok, CASE WHEN ok THEN list_append(live, struct_pack(c := cam, u := until)) ELSE live END FROM (
    SELECT *, len(live) < {episodes.TIER3_MAX} AND len(list_filter(live, lambda h: h.c = cam)) = 0 AS ok FROM (
      SELECT r.rn, r.event_id, r.cam, r.until, list_filter(held, lambda h: h.u > r.t) AS live FROM go JOIN r ON r.rn = go.rn + 1)))
SELECT event_id, admitted FROM go WHERE rn > 0"""


@query("tier_admissions", SQL_TIER)
def tier_admissions(spark, sf):
    """Promotion requests against the shared cap of concurrently analysed cameras."""
    t = S.triggers(spark, sf)
    r = t.select("event_id", (F.col("camera_id") * 1000 + F.col("track_id")).alias("camera_id"), "t",
                 F.lit(60.0).alias("hold"))
    return episodes.tier_admission(r)


SQL_EMA = S.SQL_OBS + """,
e0 AS (SELECT camera_id, track_id, frame_idx, k / 100.0 AS raw,
              row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS g FROM obs),
e1 AS (
  SELECT camera_id, track_id, frame_idx, g, CAST(raw AS DOUBLE) AS ema FROM e0 WHERE g = 1
  UNION ALL
  SELECT e0.camera_id, e0.track_id, e0.frame_idx, e0.g, 0.45 * e0.raw + 0.55 * e1.ema
  FROM e1 JOIN e0 ON e0.camera_id = e1.camera_id AND e0.track_id = e1.track_id AND e0.g = e1.g + 1)"""


@query("score_ema", f"""
WITH RECURSIVE {SQL_EMA}
SELECT camera_id, track_id, frame_idx, round(ema, 6) AS ema, ema >= 0.75 AS on FROM e1""".replace(
    " AS on FROM", " AS is_on FROM"))
def score_ema(spark, sf):
    from tarmac.operators.smoothing import ema

    o = S.obs(spark, sf).withColumn("raw", F.col("k") / 100.0)
    e = ema(o, ["camera_id", "track_id"], ["frame_idx"], F.floor(F.col("frame_idx") / 4096), "raw",
            0.45, "ema")
    return e.select("camera_id", "track_id", "frame_idx", F.round("ema", 6).alias("ema"),
                    (F.col("ema") >= 0.75).alias("is_on"))


@query("latest_per_key", f"""
WITH {S.SQL_EV}
SELECT camera_id, arg_max(event_id, (ts, event_id)) AS event_id,
       arg_max(speed, (ts, event_id)) AS speed FROM ev
WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1""")
def latest_per_key(spark, sf):
    """Latest row not after a moment, per camera."""
    e = S.ev(spark, sf).where(F.col("ts") <= F.lit("2024-01-20 12:00:00").cast("timestamp"))
    r = F.max_by(F.struct("event_id", "speed"), F.struct("ts", "event_id"))
    return e.groupBy("camera_id").agg(r.alias("r")).select("camera_id", "r.*")


@query("distinct_keys", f"""
WITH {S.SQL_EV}
SELECT DISTINCT camera_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS period_start, cls FROM ev""")
def distinct_keys(spark, sf):
    from tarmac.operators.flow import floor_to

    return S.ev(spark, sf).select(
        "camera_id", floor_to("ts", 21_600).alias("period_start"), "cls").distinct()
