"""Queries over vehicle observations: flow, counting and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import flow, motion
from tarmac.plans.registry import query
from tarmac.sources import samples as S

PERIOD = 21_600


def r6(c, name=None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def obs_speed(spark, sf):
    return S.ev(spark, sf).select(F.col("camera_id").alias("ic_name"), "ts", "track_id", "speed",
                                  F.col("cls").alias("vehicle_cls"), "event_id")


SQL_FLOW = S.SQL_EV + f""",
fl0 AS (
  SELECT camera_id AS ic_name, CAST(floor(epoch(ts) / {PERIOD}) AS BIGINT) * {PERIOD} AS period_start,
         track_id, speed, cls,
         row_number() OVER (PARTITION BY camera_id, floor(epoch(ts) / {PERIOD}), track_id
                            ORDER BY ts, event_id) AS rn
  FROM ev),
flow AS (
  SELECT ic_name, period_start, count(*) AS volume, avg(speed) AS avg_speed,
         stddev_pop(speed) AS speed_std,
         count(*) FILTER (cls IN ('T3','T5')) / count(*) AS truck_ratio
  FROM fl0 WHERE rn = 1 GROUP BY 1, 2)"""


def flow_table(spark, sf):
    return flow.traffic_flow(obs_speed(spark, sf), PERIOD, "event_id")


@query("traffic_flow", f"""
WITH {SQL_FLOW}
SELECT ic_name, period_start, volume, round(avg_speed, 6) AS avg_speed,
       round(speed_std, 6) AS speed_std, round(truck_ratio, 6) AS truck_ratio FROM flow""")
def traffic_flow(spark, sf):
    return flow_table(spark, sf).select(
        "ic_name", "period_start", "volume", r6("avg_speed"), r6("speed_std"), r6("truck_ratio"))


SQL_CROSS = S.SQL_OBS + """,
cr0 AS (
  SELECT *, lag(cy) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS py FROM obs),
cr1 AS (
  SELECT camera_id, track_id, frame_idx, cy, py,
         row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS rn
  FROM cr0 WHERE ((py < 648 AND cy >= 648) OR (py >= 648 AND cy < 648)) AND cy BETWEEN 324 AND 918),
hit AS (
  SELECT camera_id, track_id, frame_idx AS cross_frame,
         CASE WHEN cy > py THEN 'down' ELSE 'up' END AS direction FROM cr1 WHERE rn = 1),
bk AS (
  SELECT o.camera_id, o.track_id,
         CASE WHEN cls = 'T1' THEN '승용차' WHEN cls = 'T2' THEN '버스' WHEN cls = 'T13' THEN '이륜차'
              WHEN cls IN ('T3','T5') THEN '화물차' END AS bucket,
         count(*) AS n, min(frame_idx) AS first
  FROM obs o JOIN hit USING (camera_id, track_id) WHERE frame_idx <= cross_frame
  GROUP BY 1, 2, 3),
md AS (
  SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY n DESC, first) AS rn
  FROM bk WHERE bucket IS NOT NULL),
crossings AS (
  SELECT h.*, coalesce(m.bucket, '미분류') AS cls_name
  FROM hit h LEFT JOIN md m ON h.camera_id = m.camera_id AND h.track_id = m.track_id AND m.rn = 1)"""


def crossings(spark, sf):
    frame_h = 1080.0
    line = scaled(0.60, frame_h)
    band = (scaled(0.30, frame_h), scaled(0.85, frame_h))
    return flow.line_crossings(S.obs(spark, sf), line, band, up="up", down="down")


def scaled(value, extent):
    """Configuration values up to 1 are shares of the frame, larger ones are pixels."""
    v = F.lit(float(value))
    return F.when(v <= 1.0, v * extent).otherwise(v)


SQL_DIRECTIONS = f"""
WITH {SQL_CROSS},
n AS (SELECT camera_id, cross_frame // 60 AS period, direction, cls_name, count(*) AS n
      FROM crossings GROUP BY 1, 2, 3, 4)
SELECT camera_id, period, direction, CAST(sum(n) AS BIGINT) AS volume,
       string_agg(cls_name || '=' || n, ',' ORDER BY cls_name) AS by_class
FROM n GROUP BY 1, 2, 3"""


@query("traffic_by_direction", SQL_DIRECTIONS)
def traffic_by_direction(spark, sf):
    c = crossings(spark, sf).withColumn("period", F.expr("cross_frame div 60"))
    d = flow.directional_counts(c, ["camera_id", "period"])
    text = F.array_join(F.transform(F.map_entries("by_class"),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select("camera_id", "period", "direction", "volume", text.alias("by_class"))


SQL_MOTION = S.SQL_OBS + """,
mo0 AS (
  SELECT *, row_number() OVER w AS track_age, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy,
         lag(t) OVER w AS pt, lag(w) OVER w AS pw, lag(h) OVER w AS ph
  FROM obs WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
mo1 AS (
  SELECT *, cx - pcx AS dx, cy - pcy AS dy,
         CASE WHEN track_age = 1 THEN 0.0
              ELSE sqrt((cx - pcx) * (cx - pcx) + (cy - pcy) * (cy - pcy)) * 0.05 / 1.0 * 3.6
         END AS speed_kmh FROM mo0),
mo2 AS (
  SELECT *, CASE WHEN track_age = 1 THEN 0.0 WHEN abs(dx) < 0.5 AND abs(dy) < 0.5 THEN NULL
                 WHEN degrees(atan2(dx, -dy)) < 0 THEN degrees(atan2(dx, -dy)) + 360
                 ELSE degrees(atan2(dx, -dy)) END AS hraw FROM mo1),
mo3 AS (
  SELECT *, last_value(hraw IGNORE NULLS) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading,
         lag(speed_kmh) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS pspeed
  FROM mo2),
mo4 AS (
  SELECT *, lag(heading) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS pheading,
         dx * sin(radians(heading)) + dy * -cos(radians(heading)) AS along,
         last_value(CASE WHEN speed_kmh <= 5 AND (track_age = 1 OR pspeed > 5) THEN t END IGNORE NULLS)
           OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop_t
  FROM mo3),
motion AS (
  SELECT *, CASE WHEN track_age = 1 THEN 0.0 ELSE speed_kmh / 3.6 - pspeed / 3.6 END AS acceleration,
         CASE WHEN track_age = 1 THEN 0.0 WHEN abs(heading - pheading) > 180
              THEN 360 - abs(heading - pheading) ELSE abs(heading - pheading) END AS heading_change,
         CASE WHEN track_age = 1 THEN 0.0 ELSE
           sqrt(pow(dx - along * sin(radians(heading)), 2) + pow(dy + along * cos(radians(heading)), 2))
         END AS lateral_speed,
         CASE WHEN speed_kmh <= 5 THEN t - stop_t ELSE 0.0 END AS stop_duration,
         CASE WHEN pw * ph > 0 THEN (w * h - pw * ph) / (pw * ph) * 100 ELSE 0.0 END
           AS area_change_rate,
         CASE WHEN h > 0 THEN w / h ELSE 1.0 END AS aspect_ratio
  FROM mo4)"""

MOTION_COLS = ["speed_kmh", "acceleration", "heading", "heading_change", "lateral_speed",
               "stop_duration", "area_change_rate", "aspect_ratio"]


@query("motion_features", f"""
WITH {SQL_MOTION}
SELECT camera_id, track_id, frame_idx, track_age,
       {', '.join(f'round({c}, 6) AS {c}' for c in MOTION_COLS)} FROM motion""")
def motion_features(spark, sf):
    m = motion.motion(S.obs(spark, sf))
    return m.select("camera_id", "track_id", "frame_idx", "track_age", *[r6(c) for c in MOTION_COLS])


