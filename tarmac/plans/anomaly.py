"""Queries from vehicle features to rule violations, ensemble results and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import geo
from tarmac.operators import ensemble, flow, motion, rules, signals
from tarmac.plans.registry import query
from tarmac.plans.traffic import SQL_MOTION, r6, scaled
from tarmac.sources import samples as S
from tarmac.sources.rules import RULES

ID = ["camera_id", "frame_idx", "track_id"]

SQL_FEATURES = SQL_MOTION + """,
fr AS (
  SELECT camera_id, frame_idx, sum(sin(radians(heading))) AS s, sum(cos(radians(heading))) AS c,
         count(*) AS n, avg(speed_kmh) AS frame_speed FROM motion GROUP BY 1, 2),
fl AS (
  SELECT *, avg(frame_speed) OVER (PARTITION BY camera_id ORDER BY frame_idx
            ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING) AS flow_speed FROM fr),
de AS (
  SELECT m.*, fl.n, fl.flow_speed, fl.frame_speed,
         degrees(atan2(s - sin(radians(heading)), c - cos(radians(heading)))) AS mean0
  FROM motion m JOIN fl USING (camera_id, frame_idx)),
de2 AS (
  SELECT *, abs(heading - CASE WHEN mean0 < 0 THEN mean0 + 360 ELSE mean0 END) AS dv FROM de),
tp AS (
  SELECT a.camera_id, a.frame_idx, a.track_id AS track_a, b.track_id AS track_b,
         sqrt(pow(b.pcx - a.pcx, 2) + pow(b.pcy - a.pcy, 2)) AS d0,
         sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) AS d1,
         ((a.t - a.pt) + (b.t - b.pt)) / 2 AS dt
  FROM motion a JOIN motion b ON a.camera_id = b.camera_id AND a.frame_idx = b.frame_idx
   AND a.track_id < b.track_id
  WHERE a.pt IS NOT NULL AND b.pt IS NOT NULL
    AND greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.w, b.w) > 0.3),
ttc AS (
  SELECT camera_id, frame_idx, track_a, track_b,
         CASE WHEN d1 <= 0 THEN 0.0 ELSE d1 / ((d0 - d1) / dt) END AS ttc
  FROM tp WHERE dt > 0 AND d0 > d1),
tt AS (
  SELECT camera_id, frame_idx, track_id, min(ttc) AS ttc_min FROM (
    SELECT camera_id, frame_idx, track_a AS track_id, ttc FROM ttc
    UNION ALL SELECT camera_id, frame_idx, track_b, ttc FROM ttc) GROUP BY 1, 2, 3),
gp AS (
  SELECT a.camera_id, a.frame_idx, a.track_id,
         sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)) AS d,
         (b.cx - a.cx) * sin(radians(a.heading)) + (b.cy - a.cy) * -cos(radians(a.heading)) AS p
  FROM motion a JOIN motion b ON a.camera_id = b.camera_id AND a.frame_idx = b.frame_idx
   AND a.track_id <> b.track_id),
ga AS (
  SELECT camera_id, frame_idx, track_id, min(d) FILTER (p > 0) AS gap_front,
         min(d) FILTER (p < 0) AS gap_rear, count(*) FILTER (d <= 200) AS neighbor_count
  FROM gp WHERE d <= 500 GROUP BY 1, 2, 3),
features AS (
  SELECT d.*, CASE WHEN n > 3 THEN CASE WHEN dv > 180 THEN 360 - dv ELSE dv END ELSE 0.0 END
           AS heading_deviation,
         coalesce(ttc_min, 999.0) AS ttc_min, coalesce(gap_front, 9999.0) AS gap_front,
         coalesce(gap_rear, 9999.0) AS gap_rear, coalesce(neighbor_count, 0) AS neighbor_count,
         speed_kmh - coalesce(flow_speed, speed_kmh) AS speed_diff_flow
  FROM de2 d LEFT JOIN tt USING (camera_id, frame_idx, track_id)
  LEFT JOIN ga USING (camera_id, frame_idx, track_id))"""

SQL_MA = SQL_FEATURES + """,
ma AS (
  SELECT *, """ + ", ".join(
    f"avg({c}) OVER w AS {c}_ma" for c in motion.FEATURES) + """
  FROM features WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx
                             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def feats(spark, sf):
    return motion.features(S.obs(spark, sf))


@query("features_ma5", f"""
WITH {SQL_MA}
SELECT camera_id, frame_idx, track_id,
       {', '.join(f'round({c}_ma, 6) AS {c}_ma' for c in motion.FEATURES)} FROM ma""")
def features_ma5(spark, sf):
    ma = motion.moving_average(feats(spark, sf)).where("not _halo")
    return ma.select(*ID, *[r6(f"{c}_ma") for c in motion.FEATURES])


@query("flow_deviation", f"""
WITH {SQL_FEATURES}
SELECT camera_id, frame_idx, track_id, round(speed_diff_flow, 6) AS speed_diff_flow FROM features""")
def flow_deviation(spark, sf):
    m = motion.motion(S.obs(spark, sf))
    f = m.join(motion.frame_flow(m), motion.FRAME)
    diff = F.col("speed_kmh") - F.coalesce("flow_speed", "speed_kmh")
    return f.select(*ID, r6(diff, "speed_diff_flow"))


@query("circular_heading", f"""
WITH {SQL_FEATURES},
cm AS (SELECT camera_id, frame_idx, degrees(atan2(s, c)) AS m FROM fr)
SELECT f.camera_id, f.frame_idx, f.track_id, round(heading_deviation, 6) AS heading_deviation,
       round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 6) AS mean_heading
FROM features f JOIN cm USING (camera_id, frame_idx)""")
def circular_heading(spark, sf):
    m = motion.heading_deviation(motion.motion(S.obs(spark, sf)))
    mean = m.groupBy(*motion.FRAME).agg(motion.circular_mean(
        F.sum(F.sin(F.radians("heading"))), F.sum(F.cos(F.radians("heading")))).alias("mean"))
    return m.join(mean, motion.FRAME).select(*ID, r6("heading_deviation"), r6("mean", "mean_heading"))


@query("pair_ttc", f"""
WITH {SQL_FEATURES}
SELECT camera_id, frame_idx, track_a, track_b, round(ttc, 6) AS ttc FROM ttc ORDER BY ttc""")
def pair_ttc(spark, sf):
    p = motion.pair_ttc(motion.motion(S.obs(spark, sf)))
    return p.select("camera_id", "frame_idx", "track_a", "track_b", r6("ttc")).orderBy("ttc")


def planes(spark, sf):
    """A matrix for two of three cameras, taken from the suppliers of their numbers."""
    s = S.cameras(spark, sf).where("cctv_id % 3 <> 0")
    c = F.col("cctv_id").cast("double")
    h = F.array(0.05 + c * 0.001, F.lit(0.001), c * 0.1, F.lit(0.0), F.lit(0.06), F.lit(0.0), F.lit(0.0), F.lit(0.0002), F.lit(1.0))
    return s.select(F.col("cctv_id").alias("camera_id"), h.alias("h"), F.lit(0.05).alias("scale"))


def _plane_sql(x, y):
    deep = f"(0.0002 * {y} + 1.0)"
    return f"((0.05 + c * 0.001) * {x} + 0.001 * {y} + c * 0.1) / {deep}", f"(0.06 * {y}) / {deep}"


@query("pair_ttc_world", f"""
WITH {SQL_FEATURES}, {S.SQL_CAM},
pl AS (SELECT m.*, c, {_plane_sql('cx', 'cy')[0]} AS wx, {_plane_sql('cx', 'cy')[1]} AS wy, {_plane_sql('pcx', 'pcy')[0]} AS pwx, {_plane_sql('pcx', 'pcy')[1]} AS pwy
       FROM motion m LEFT JOIN (SELECT cctv_id, cctv_id::DOUBLE AS c FROM cam WHERE cctv_id % 3 <> 0) k ON k.cctv_id = m.camera_id WHERE pt IS NOT NULL),
pw AS (SELECT a.camera_id, a.frame_idx, a.track_id AS track_a, b.track_id AS track_b, a.c IS NOT NULL AS calibrated,
         CASE WHEN a.c IS NULL THEN sqrt(pow(b.pcx - a.pcx, 2) + pow(b.pcy - a.pcy, 2)) ELSE sqrt(pow(b.pwx - a.pwx, 2) + pow(b.pwy - a.pwy, 2)) END AS d0,
         CASE WHEN a.c IS NULL THEN sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) ELSE sqrt(pow(b.wx - a.wx, 2) + pow(b.wy - a.wy, 2)) END AS d1,
         ((a.t - a.pt) + (b.t - b.pt)) / 2 AS dt
       FROM pl a JOIN pl b ON a.camera_id = b.camera_id AND a.frame_idx = b.frame_idx AND a.track_id < b.track_id
       WHERE least(a.w, b.w) > 0 AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.w, b.w) > 0.3)
SELECT camera_id, frame_idx, track_a, track_b, calibrated, round(CASE WHEN d1 <= 0 THEN 0 ELSE d1 / ((d0 - d1) / dt) END, 6) AS ttc
FROM pw WHERE dt > 0 AND (d0 - d1) / dt > 0""")
def pair_ttc_world(spark, sf):
    """Time to contact on the road plane of each calibrated camera, in pixels for the others."""
    p = motion.pair_ttc(motion.motion(S.obs(spark, sf)), planes=planes(spark, sf))
    return p.select("camera_id", "frame_idx", "track_a", "track_b", "calibrated", r6("ttc"))


@query("neighbours_gaps", f"""
WITH {SQL_FEATURES}
SELECT camera_id, frame_idx, track_id, round(gap_front, 6) AS gap_front,
       round(gap_rear, 6) AS gap_rear, neighbor_count FROM features""")
def neighbours_gaps(spark, sf):
    s = motion.surroundings(motion.motion(S.obs(spark, sf)))
    return s.select(*ID, r6("gap_front"), r6("gap_rear"), "neighbor_count")


SQL_VIOL = SQL_MA + """,
pv AS (
  SELECT *, heading_deviation_ma >= 150 AND track_age_ma >= 10 AS v2 FROM ma),
pv2 AS (
  SELECT *, v2 AND coalesce(lag(v2, 1) OVER w, false) AND coalesce(lag(v2, 2) OVER w, false) AS v2x
  FROM pv WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
st AS (
  SELECT camera_id, frame_idx, min(track_id) AS stopped_id FROM features
  WHERE speed_kmh <= 5 AND stop_duration >= 5 GROUP BY 1, 2),
bad AS (
  SELECT camera_id, frame_idx, list({'id': track_id, 'x': cx, 'y': cy} ORDER BY track_id) AS items
  FROM pv2 WHERE acceleration_ma <= -4 GROUP BY 1, 2 HAVING count(*) >= 3),
seeded AS (
  SELECT camera_id, frame_idx, items AS rest, CAST([] AS BIGINT[]) AS ids FROM bad
  UNION ALL
  SELECT camera_id, frame_idx,
         list_filter(rest, lambda o: sqrt((o.x - rest[1].x) ** 2 + (o.y - rest[1].y) ** 2) > 200),
         list_transform(list_filter(rest, lambda o: sqrt((o.x - rest[1].x) ** 2 + (o.y - rest[1].y) ** 2) <= 200), lambda o: o.id)
  FROM seeded WHERE len(rest) > 0),
viol AS (
  SELECT camera_id, frame_idx, ids[1] AS track_id, 'R9' AS rule_id, 8 AS pos, 'CRITICAL' AS severity, 1.0 AS wt,
         least(1.0, len(ids) / 6.0) AS score, ids AS tracks FROM seeded WHERE len(ids) >= 3
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R1' AS rule_id, 0 AS pos, 'HIGH' AS severity, 0.8 AS wt,
         least(1.0, 0.8 * (1 + greatest(0.0, abs(acceleration_ma / -6.0) - 1) * 0.5)) AS score,
         [track_id] AS tracks
  FROM pv2 WHERE acceleration_ma <= -6 AND track_age_ma >= 5 AND speed_kmh_ma >= 20
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R2', 1, 'CRITICAL', 1.0, 1.0, [track_id] FROM pv2 WHERE v2x
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R3', 2, 'MEDIUM', 0.5,
         least(1.0, 0.5 * (1 + greatest(0.0, stop_duration_ma / 30.0 - 1) * 0.5)), [track_id]
  FROM pv2 WHERE stop_duration_ma >= 30 AND track_age_ma >= 30
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R4', 3, 'HIGH', 0.8,
         least(1.0, greatest(0.0, 1 - ttc_min_ma / 3.0) * 0.8), [track_id]
  FROM pv2 WHERE ttc_min_ma < 999 AND ttc_min_ma <= 3
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R5', 4, 'HIGH', 0.8,
         least(1.0, 0.8 * (1 + greatest(0.0, lateral_speed_ma / 3.0 - 1) * 0.5)), [track_id]
  FROM pv2 WHERE lateral_speed_ma >= 3 AND track_age_ma >= 5 AND speed_kmh_ma >= 30
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R6', 5, 'CRITICAL', 1.0, 1.0, [track_id]
  FROM pv2 WHERE cls IN ('person', 'pedestrian') AND track_age >= 3
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R7', 6, 'MEDIUM', 0.5, 0.5, [track_id]
  FROM pv2 WHERE heading_deviation_ma >= 120 AND speed_kmh_ma <= 20 AND track_age_ma >= 10
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R8', 7, 'LOW', 0.3,
         least(1.0, 0.3 * (1 + greatest(0.0, acceleration_ma / 4.0 - 1) * 0.5)), [track_id]
  FROM pv2 WHERE acceleration_ma >= 4 AND track_age_ma >= 5
  UNION ALL
  SELECT camera_id, frame_idx, track_id, 'R10', 9, 'HIGH', 0.8,
         least(1.0, greatest(0.0, 1 - ttc_min / 5.0) * 0.8), [track_id, stopped_id]
  FROM pv2 JOIN st USING (camera_id, frame_idx)
  WHERE speed_kmh > 5 AND track_age >= 5 AND ttc_min < 5)"""


@query("rule_violations", f"""
WITH RECURSIVE {SQL_VIOL}
SELECT camera_id, frame_idx, tracks[1] AS track_id, rule_id, severity, round(score, 6) AS score,
       array_to_string(tracks, ',') AS involved FROM viol""")
def rule_violations(spark, sf):
    v = rules.violations(feats(spark, sf))
    return v.select("camera_id", "frame_idx", F.get("involved_tracks", F.lit(0)).alias("track_id"),
                    "rule_id", "severity", r6("score"),
                    F.array_join("involved_tracks", ",").alias("involved"))


@query("rule_matrix", f"""
WITH RECURSIVE {SQL_VIOL}
SELECT camera_id, rule_id, severity, count(*) AS n, round(max(score), 6) AS max_score,
       round(avg(score), 6) AS avg_score FROM viol GROUP BY 1, 2, 3""")
def rule_matrix(spark, sf):
    v = rules.violations(feats(spark, sf))
    return v.groupBy("camera_id", "rule_id", "severity").agg(
        F.count("*").alias("n"), F.round(F.max("score"), 6).alias("max_score"),
        F.round(F.avg("score"), 6).alias("avg_score"))


@query("cluster_braking", f"""
WITH RECURSIVE {SQL_VIOL}
SELECT camera_id, frame_idx, round(score, 6) AS score, array_to_string(tracks, ',') AS involved
FROM viol WHERE rule_id = 'R9'""")
def cluster_braking(spark, sf):
    rule, pos = next((r, i) for i, r in enumerate(RULES) if r["type"] == "group")
    v = rules.cluster_violations(feats(spark, sf), rule, pos)
    return v.select("camera_id", "frame_idx", r6("score"),
                    F.array_join("involved_tracks", ",").alias("involved"))


SQL_TOP = SQL_VIOL + """,
vo AS (
  SELECT *, row_number() OVER (PARTITION BY camera_id, frame_idx
            ORDER BY wt DESC, pos, tracks[1], tracks[2]) AS rk FROM viol)"""


@query("top_violations", f"""
WITH RECURSIVE {SQL_TOP}
SELECT camera_id, frame_idx,
       string_agg(rule_id || ':' || tracks[1], ',' ORDER BY rk) FILTER (rk <= 5) AS top5,
       round(max(score), 6) AS max_score, count(*) AS n FROM vo GROUP BY 1, 2""")
def top_violations(spark, sf):
    b = rules.by_frame(rules.violations(feats(spark, sf)))
    head = F.transform(F.slice("violations", 1, 5), lambda v: F.concat(
        v["rule_id"], F.lit(":"), F.get(v["involved_tracks"], F.lit(0))))
    return b.select(
        "camera_id", "frame_idx", F.array_join(head, ",").alias("top5"),
        F.round(F.array_max(F.transform("violations", lambda v: v["score"])), 6).alias("max_score"),
        F.size("violations").cast("long").alias("n"))


SQL_ENS = SQL_TOP + """,
ml AS (SELECT camera_id, frame_idx, max(k) / 100.0 AS a, min(k) / 100.0 AS b FROM obs GROUP BY 1, 2),
va AS (
  SELECT camera_id, frame_idx, count(*) AS nv,
         max(score) FILTER (wt >= 0.8) AS ch, max(score) FILTER (severity = 'MEDIUM') AS med,
         max(score) AS anyv,
         arg_min(rule_id || '_' || severity, rk) FILTER (wt >= 0.8) AS top_rule FROM vo GROUP BY 1, 2),
br AS (
  SELECT ml.camera_id, ml.frame_idx, a, b, coalesce(nv, 0) AS nv, med,
    CASE WHEN ch IS NOT NULL THEN least(1.0, ch)
         WHEN a >= 0.5 AND b >= 0.5 THEN (a + b) / 2
         WHEN a >= 0.9 OR b >= 0.9 THEN greatest(a, b)
         WHEN med IS NOT NULL AND (a >= 0.3 OR b >= 0.3) THEN (med + (a + b) / 2) / 2
         WHEN nv > 0 THEN anyv ELSE greatest(a, b) END AS final_score,
    CASE WHEN ch IS NOT NULL OR (a >= 0.5 AND b >= 0.5) OR a >= 0.9 OR b >= 0.9
           OR (med IS NOT NULL AND (a >= 0.3 OR b >= 0.3)) THEN true
         WHEN nv > 0 THEN false ELSE greatest(a, b) >= 0.3 END AS trigger,
    CASE WHEN ch IS NOT NULL THEN 'rule_' || top_rule
         WHEN a >= 0.5 AND b >= 0.5 THEN 'ml_vote_2'
         WHEN a >= 0.9 OR b >= 0.9 THEN 'ml_high_conf_' || CASE WHEN a >= b THEN 'a' ELSE 'b' END
         WHEN med IS NOT NULL AND (a >= 0.3 OR b >= 0.3) THEN 'rule_medium_ml_support'
         WHEN nv > 0 THEN 'below_threshold' ELSE 'ml_only' END AS trigger_reason
  FROM ml LEFT JOIN va USING (camera_id, frame_idx)),
inv AS (
  SELECT v.camera_id, v.frame_idx, t.track AS track, min(rk * 10 + t.ord) AS o
  FROM vo v JOIN br USING (camera_id, frame_idx),
       LATERAL (SELECT unnest(v.tracks) AS track, generate_subscripts(v.tracks, 1) AS ord) t
  WHERE CASE WHEN br.trigger_reason LIKE 'rule_R%' THEN v.wt >= 0.8
             WHEN br.trigger_reason = 'rule_medium_ml_support' THEN v.severity = 'MEDIUM'
             ELSE true END
  GROUP BY 1, 2, 3),
ens AS (
  SELECT br.*, (SELECT string_agg(track, ',' ORDER BY o) FROM inv
                WHERE inv.camera_id = br.camera_id AND inv.frame_idx = br.frame_idx) AS involved
  FROM br)"""


def scored_frames(spark, sf):
    o = S.obs(spark, sf)
    raw = F.create_map(F.lit("a"), F.max("k") / 100.0, F.lit("b"), F.min("k") / 100.0,
                       F.lit("unvetted"), F.lit(0.99))
    frames = o.groupBy("camera_id", "frame_idx").agg(raw.alias("raw_scores"), F.max("k").alias("k"))
    active = F.array(F.lit("a"), F.lit("b"))
    frames = frames.withColumn("ml_scores", ensemble.keep_models(F.col("raw_scores"), active))
    v = rules.by_frame(rules.violations(motion.features(o)))
    return ensemble.score(frames.join(v, ["camera_id", "frame_idx"], "left"))


@query("ensemble_alerts", f"""
WITH RECURSIVE {SQL_ENS}
SELECT camera_id, frame_idx, round(final_score, 6) AS final_score, trigger, trigger_reason,
       coalesce(involved, '') AS involved,
       CASE WHEN final_score < 0.3 THEN 'NONE' WHEN final_score >= 0.7 THEN 'ALARM' ELSE 'ALERT' END
         AS level FROM ens""")
def ensemble_alerts(spark, sf):
    s = scored_frames(spark, sf)
    level = F.when(F.col("final_score") < 0.3, "NONE").when(
        F.col("final_score") >= 0.7, "ALARM").otherwise("ALERT")
    return s.select("camera_id", "frame_idx", r6("final_score"), "trigger", "trigger_reason",
                    F.array_join("involved_tracks", ",").alias("involved"), level.alias("level"))


@query("shadow_log", f"""
WITH RECURSIVE {SQL_ENS}
SELECT camera_id, frame_idx, round(final_score, 6) AS final_score, trigger, trigger_reason,
       least(nv, 5) AS n_violations, round(a, 6) AS score_a, round(b, 6) AS score_b FROM ens""")
def shadow_log(spark, sf):
    s = ensemble.shadow_rows(scored_frames(spark, sf))
    return s.select("camera_id", "frame_idx", r6("final_score"), "trigger", "trigger_reason",
                    F.size("violations").cast("long").alias("n_violations"),
                    r6(F.col("gated_scores")["a"], "score_a"),
                    r6(F.col("gated_scores")["b"], "score_b"))


def alarm_events(spark, sf):
    level = F.when(F.col("severity") >= ensemble.ALARM_AT, "ALARM").otherwise("ALERT")
    return S.triggers(spark, sf).where(F.col("severity") >= ensemble.ALERT_AT).select(
        "camera_id", "event_id", (F.col("t") * 60).alias("t"), "severity", level.alias("level"))


SQL_ALARMS = f"""
WITH RECURSIVE {S.SQL_TRIG},
lv AS (SELECT camera_id, event_id, t * 60 AS t, CASE WHEN severity >= {ensemble.ALARM_AT} THEN 'ALARM' ELSE 'ALERT' END AS level
       FROM trig WHERE severity >= {ensemble.ALERT_AT}),
al AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) AS rn FROM lv WHERE level = 'ALARM'),
ru AS (
  SELECT camera_id, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DOUBLE) AS t, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS kept, true AS ok
  FROM (SELECT DISTINCT camera_id FROM al)
  UNION ALL
  SELECT a.camera_id, a.event_id, a.t, a.rn,
         CASE WHEN len(list_filter(kept, lambda x: x > a.t - 3600)) < {ensemble.ALARMS_PER_HOUR}
              THEN list_append(list_filter(kept, lambda x: x > a.t - 3600), a.t) ELSE list_filter(kept, lambda x: x > a.t - 3600) END,
         len(list_filter(kept, lambda x: x > a.t - 3600)) < {ensemble.ALARMS_PER_HOUR}
  FROM ru JOIN al a ON a.camera_id = ru.camera_id AND a.rn = ru.rn + 1)
SELECT camera_id, event_id, t, CASE WHEN ok THEN 'ALARM' ELSE 'ALERT' END AS level FROM ru WHERE rn > 0
UNION ALL SELECT camera_id, event_id, t, level FROM lv WHERE level <> 'ALARM'"""


@query("alarm_rate_limit", SQL_ALARMS)
def alarm_rate_limit(spark, sf):
    """Alarm limiting over every trigger scored by its severity."""
    out = ensemble.limit_alarms(alarm_events(spark, sf), F.floor(F.col("t") / 86_400))
    return out.select("camera_id", "event_id", "t", "level")


# fixed plane for the sample cameras: a mild perspective
HOMOGRAPHY = [0.05, 0.001, 0.0, 0.0, 0.06, 0.0, 0.0, 0.0002, 1.0]


@query("calibrated_speed", f"""
WITH {S.SQL_OBS},
wp AS (
  SELECT *, (0.05 * cx + 0.001 * cy) / (0.0002 * cy + 1.0) AS wx,
         (0.06 * cy) / (0.0002 * cy + 1.0) AS wy FROM obs),
wl AS (
  SELECT *, lag(wx) OVER w AS px, lag(wy) OVER w AS py, lag(t) OVER w AS pt
  FROM wp WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx))
SELECT camera_id, frame_idx, track_id,
       round(sqrt(pow(wx - px, 2) + pow(wy - py, 2)) / (t - pt) * 3.6, 6) AS world_kmh FROM wl""")
def calibrated_speed(spark, sf):
    h = F.array(*[F.lit(v) for v in HOMOGRAPHY])
    return motion.calibrated_speed(S.obs(spark, sf), h).select(*ID, r6("world_kmh"))


ROI = [(200.0, 100.0), (1700.0, 150.0), (1600.0, 950.0), (900.0, 700.0), (250.0, 1000.0)]
LANES = {"L1": [(300.0, 0.0), (350.0, 1080.0)], "L2": [(900.0, 0.0), (1000.0, 540.0), (900.0, 1080.0)],
         "L3": [(1500.0, 0.0), (1450.0, 1080.0)]}


def points(pts):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pts])


def _sql_edges(pts):
    n = len(pts)
    return " + ".join(
        f"(CASE WHEN ({pts[i][1]} > cy) <> ({pts[i-1][1]} > cy) AND cx < "
        f"({pts[i-1][0]} - {pts[i][0]}) * (cy - {pts[i][1]}) / ({pts[i-1][1] - pts[i][1]}) "
        f"+ {pts[i][0]} THEN 1 ELSE 0 END)" for i in range(n))


@query("roi_filter", f"""
WITH {S.SQL_OBS}, r AS (SELECT *, ({_sql_edges(ROI)}) % 2 = 1 AS inside FROM obs)
SELECT camera_id, frame_idx, track_id, round(cx / 1920, 9) AS nx, round(cy / 1080, 9) AS ny,
       CASE WHEN cls = 'person' THEN 'pedestrian' ELSE 'vehicle' END AS kind
FROM r WHERE cls <> 'person' OR (k / 100.0 >= 0.25 AND inside)""")
def roi_filter(spark, sf):
    """Vehicles pass; pedestrians need confidence and a place inside the road polygon."""
    o = S.obs(spark, sf).withColumn("conf", F.col("k") / 100.0)
    ped = F.col("cls") == "person"
    on_road = geo.in_polygon("cx", "cy", points(ROI))
    kept = o.where(~ped | ((F.col("conf") >= 0.25) & on_road))
    return kept.select(*ID, F.round(F.col("cx") / 1920, 9).alias("nx"),
                       F.round(F.col("cy") / 1080, 9).alias("ny"),
                       F.when(ped, "pedestrian").otherwise("vehicle").alias("kind"))


def _sql_seg(a, b):
    (ax, ay), (bx, by) = a, b
    dx, dy = bx - ax, by - ay
    t = f"greatest(0.0, least(1.0, ((cx - {ax}) * {dx} + (cy - {ay}) * {dy}) / {dx*dx+dy*dy}))"
    return (f"sqrt(pow(cx - ({ax} + {t} * {dx}), 2) + pow(cy - ({ay} + {t} * {dy}), 2))")


_LANE_SQL = {k: "least(" + ", ".join(_sql_seg(p[i], p[i + 1]) for i in range(len(p) - 1)) + ")"
             for k, p in LANES.items()}


@query("nearest_lane", f"""
WITH {S.SQL_OBS},
d AS (SELECT camera_id, frame_idx, track_id, {_LANE_SQL['L1']} AS l1, {_LANE_SQL['L2']} AS l2,
      {_LANE_SQL['L3']} AS l3 FROM obs)
SELECT camera_id, frame_idx, track_id, round(least(l1, l2, l3), 6) AS distance,
       CASE WHEN l1 <= l2 AND l1 <= l3 THEN 'L1' WHEN l2 <= l3 THEN 'L2' ELSE 'L3' END AS lane
FROM d""")
def nearest_lane(spark, sf):
    lanes = F.array(*[F.struct(F.lit(k).alias("id"), points(p).alias("line"))
                      for k, p in LANES.items()])
    d = F.transform(lanes, lambda l: F.struct(
        geo.polyline_distance(F.col("cx"), F.col("cy"), l["line"]).alias("d"), l["id"].alias("id")))
    o = S.obs(spark, sf).withColumn("best", F.array_min(d))
    return o.select(*ID, r6("best.d", "distance"), F.col("best.id").alias("lane"))


@query("counting_band", f"""
WITH {S.SQL_OBS},
nd AS (
  SELECT camera_id, track_id, count(*) AS n, arg_max(cx, frame_idx) - arg_min(cx, frame_idx) AS dx,
         arg_max(cy, frame_idx) - arg_min(cy, frame_idx) AS dy,
         count(*) FILTER (cy BETWEEN 0.3 * 1080 AND 0.85 * 1080) AS in_band
  FROM obs GROUP BY 1, 2)
SELECT camera_id, track_id, n, in_band, round(sqrt(dx * dx + dy * dy), 6) AS disp,
       CASE WHEN n < 4 THEN 'dropped_short' WHEN sqrt(dx * dx + dy * dy) < 12 THEN 'dropped_static'
            ELSE 'counted' END AS status FROM nd""")
def counting_band(spark, sf):
    o = S.obs(spark, sf)
    band = o.groupBy("camera_id", "track_id").agg(
        F.count_if(F.col("cy").between(scaled(0.3, 1080.0), scaled(0.85, 1080.0))).alias("in_band"))
    return flow.net_displacement(o).join(band, ["camera_id", "track_id"]).select(
        "camera_id", "track_id", "n", "in_band", r6("disp"), "status")


@query("track_modal_class", f"""
WITH {S.SQL_OBS},
c AS (SELECT camera_id, track_id, cls, count(*) AS n, min(frame_idx) AS f FROM obs GROUP BY 1, 2, 3),
m AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY n DESC, f) AS rk FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx DESC) AS b
      FROM obs),
s AS (SELECT camera_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame,
             count(*) AS n, arg_max(cls, frame_idx) AS last_cls,
             avg(speed) FILTER (b <= 10) AS recent_speed FROM o GROUP BY 1, 2)
SELECT s.camera_id, s.track_id, first_frame, last_frame, s.n, last_cls,
       round(recent_speed, 6) AS recent_speed, m.cls AS modal_cls
FROM s JOIN m ON s.camera_id = m.camera_id AND s.track_id = m.track_id AND m.rk = 1""")
def track_modal_class(spark, sf):
    o = S.obs(spark, sf)
    keys = ["camera_id", "track_id"]
    mode = flow.modal(o, keys, "cls", "frame_idx").withColumnRenamed("cls", "modal_cls")
    s = flow.track_summary(o, keys)
    return s.join(mode, keys).select(*keys, "first_frame", "last_frame", "n", "last_cls",
                                     r6("recent_speed"), "modal_cls")


@query("detection_quality", f"""
WITH {SQL_MOTION}, r AS (SELECT *, ({_sql_edges(ROI)}) % 2 = 1 AS inside FROM motion),
t AS (SELECT camera_id, track_id, count(DISTINCT cls) AS nc FROM r GROUP BY 1, 2),
u AS (SELECT camera_id, count(*) AS unique_tracks, count(*) FILTER (nc > 1) AS unstable
      FROM t GROUP BY 1)
SELECT r.camera_id, max(unique_tracks) AS unique_tracks, max(unstable) AS unstable_class_tracks,
       round(avg(sqrt(dx * dx + dy * dy)), 6) AS mean_jitter, count(*) FILTER (inside) AS in_roi,
       count(*) FILTER (NOT inside) AS out_roi, count(*) FILTER (cls = 'person') AS persons
FROM r JOIN u USING (camera_id) GROUP BY 1""")
def detection_quality(spark, sf):
    m = motion.motion(S.obs(spark, sf)).withColumn(
        "inside", geo.in_polygon("cx", "cy", points(ROI)))
    return signals.detection_quality(m).withColumn("mean_jitter", F.round("mean_jitter", 6))


@query("principal_axis", f"""
WITH {S.SQL_OBS},
nd AS (
  SELECT camera_id, track_id, count(*) AS n, arg_max(cx, frame_idx) - arg_min(cx, frame_idx) AS dx,
         arg_max(cy, frame_idx) - arg_min(cy, frame_idx) AS dy FROM obs GROUP BY 1, 2),
ok AS (SELECT * FROM nd WHERE n >= 4 AND sqrt(dx * dx + dy * dy) >= 12),
mm AS (SELECT camera_id, avg(dx * dx) AS xx, avg(dx * dy) AS xy, avg(dy * dy) AS yy FROM ok GROUP BY 1),
an AS (SELECT *, cos(atan2(2 * xy, xx - yy) / 2) AS x0, sin(atan2(2 * xy, xx - yy) / 2) AS y0 FROM mm),
ax AS (SELECT camera_id, CASE WHEN y0 < 0 OR (y0 = 0 AND x0 < 0) THEN -x0 ELSE x0 END AS ax,
       CASE WHEN y0 < 0 OR (y0 = 0 AND x0 < 0) THEN -y0 ELSE y0 END AS ay FROM an)
SELECT o.camera_id, round(ax, 6) AS ax, round(ay, 6) AS ay,
       CASE WHEN abs(ay) >= abs(ax) THEN CASE WHEN ay < 0 THEN '방향A(화면상단행)' ELSE '방향A(화면하단행)' END
            WHEN ax > 0 THEN '방향A(화면우측행)' ELSE '방향A(화면좌측행)' END AS label_a,
       count(*) FILTER (dx * ax + dy * ay >= 0) AS n_a, count(*) FILTER (dx * ax + dy * ay < 0) AS n_b
FROM ok o JOIN ax USING (camera_id) GROUP BY 1, 2, 3, 4""")
def principal_axis(spark, sf):
    ok = flow.net_displacement(S.obs(spark, sf)).where("status = 'counted'")
    axis = flow.principal_axis(ok)
    side = F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay") >= 0
    n = ok.join(axis, "camera_id").groupBy("camera_id", "ax", "ay").agg(
        F.count_if(side).alias("n_a"), F.count_if(~side).alias("n_b"))
    a, _ = flow.direction_labels(F.col("ax"), F.col("ay"))
    return n.select("camera_id", r6("ax"), r6("ay"), a.alias("label_a"), "n_a", "n_b")


@query("stop_runs", f"""
WITH {S.SQL_OBS},
s0 AS (SELECT *, row_number() OVER w AS g, lag(speed) OVER w AS ps
       FROM obs WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
s1 AS (SELECT *, last_value(CASE WHEN speed <= 5 AND (g = 1 OR ps > 5) THEN g END IGNORE NULLS)
       OVER (PARTITION BY camera_id, track_id ORDER BY g ROWS UNBOUNDED PRECEDING) AS run FROM s0)
SELECT camera_id, track_id, run, count(*) AS frames, max(t) - min(t) AS seconds, max(g) AS last_age
FROM s1 WHERE speed <= 5 GROUP BY 1, 2, 3""")
def stop_runs(spark, sf):
    return signals.runs_below(S.obs(spark, sf), "speed", motion.STOP_KMH)


@query("speed_variance", f"""
WITH {S.SQL_OBS},
f AS (SELECT camera_id, frame_idx, avg(speed) AS m FROM obs GROUP BY 1, 2 HAVING count(*) >= 3),
h AS (SELECT *, count(*) OVER w AS n, avg(m) OVER w AS hm, stddev_pop(m) OVER w AS hs FROM f
      WINDOW w AS (PARTITION BY camera_id ORDER BY frame_idx ROWS BETWEEN 299 PRECEDING AND CURRENT ROW))
SELECT camera_id, frame_idx, round(m, 6) AS frame_speed, round(abs(m - hm) / hs, 6) AS deviation
FROM h WHERE n >= 10 AND hs >= 1 AND abs(m - hm) / hs >= 2""")
def speed_variance(spark, sf):
    s = signals.speed_variance(S.obs(spark, sf))
    return s.select("camera_id", "frame_idx", r6("frame_speed"), r6("deviation"))


SQL_STREAK = SQL_FEATURES + """,
lo AS (SELECT * FROM ttc WHERE ttc BETWEEN 0.05 AND 6),
sq AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY camera_id, track_a, track_b
                                               ORDER BY frame_idx) AS isl FROM lo),
st2 AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_a, track_b, isl
                                    ORDER BY frame_idx) AS streak FROM sq)"""


@query("ttc_streak", f"""
WITH {SQL_STREAK}
SELECT camera_id, track_a, track_b, frame_idx, streak, streak % 2 = 0 AS fires FROM st2""")
def ttc_streak(spark, sf):
    p = motion.pair_ttc(motion.motion(S.obs(spark, sf)))
    s = signals.ttc_streaks(p, low=0.05, high=6.0, need=2)
    return s.select("camera_id", "track_a", "track_b", "frame_idx", "streak", "fires")


@query("wrong_way", f"""
WITH {S.SQL_OBS},
i AS (SELECT *, first_value(cx) OVER w AS ix, first_value(cy) OVER w AS iy, row_number() OVER w AS g
      FROM obs WINDOW w AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
d AS (SELECT *, sqrt(pow(cx - ix, 2) + pow(cy - iy, 2)) AS dist FROM i),
u AS (SELECT camera_id, frame_idx, track_id, (cx - ix) / dist AS ux, (cy - iy) / dist AS uy
      FROM d WHERE g > 1 AND dist >= 50),
s AS (SELECT camera_id, frame_idx, sum(ux) AS sx, sum(uy) AS sy, count(*) AS n FROM u GROUP BY 1, 2),
o AS (SELECT u.*, (sx - ux) / (n - 1) AS ax, (sy - uy) / (n - 1) AS ay
      FROM u JOIN s USING (camera_id, frame_idx) WHERE n - 1 >= 3),
c AS (SELECT *, (ux * ax + uy * ay) / sqrt(ax * ax + ay * ay) AS cosine FROM o
      WHERE sqrt(ax * ax + ay * ay) >= 0.3)
SELECT camera_id, frame_idx, track_id, round(cosine, 6) AS cosine FROM c WHERE cosine < -0.7""")
def wrong_way(spark, sf):
    return signals.wrong_way(S.obs(spark, sf)).select(*ID, r6("cosine"))


@query("frame_signal_score", f"""
WITH {S.SQL_OBS},
g AS (SELECT camera_id, frame_idx, avg(k) / 100.0 AS fg_ratio, avg(speed) AS diff_mean,
             max(k) >= 98 AS has_static, min(k) / 20.0 AS hist_corr FROM obs GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN frame_idx >= 50 AND fg_ratio < 0.02 THEN least(0.3, 1 - fg_ratio / 0.02)
                     WHEN frame_idx >= 50 AND fg_ratio > 0.4 THEN least(1.0, fg_ratio / 0.4 - 0.5) END AS s1,
             CASE WHEN diff_mean > 30 THEN least(1.0, diff_mean / 90.0) END AS s2,
             CASE WHEN has_static THEN 0.7 END AS s3,
             CASE WHEN hist_corr < 0.4 THEN least(1.0, 1 - hist_corr / 0.4) END AS s4 FROM g)
SELECT camera_id, frame_idx, round(coalesce(greatest(s1, s2, s3, s4), 0.0), 6) AS score,
       concat_ws(',', CASE WHEN s1 IS NOT NULL THEN
                   CASE WHEN fg_ratio < 0.02 THEN 'fg_ratio_low' ELSE 'fg_ratio_high' END END,
                 CASE WHEN s2 IS NOT NULL THEN 'frame_diff' END,
                 CASE WHEN s3 IS NOT NULL THEN 'static_object' END,
                 CASE WHEN s4 IS NOT NULL THEN 'hist_change' END) AS reasons,
       s1 IS NOT NULL OR s2 IS NOT NULL OR s3 IS NOT NULL OR s4 IS NOT NULL AS is_anomaly FROM s""")
def frame_signal_score(spark, sf):
    g = S.obs(spark, sf).groupBy("camera_id", "frame_idx").agg(
        (F.avg("k") / 100.0).alias("fg_ratio"), signals.exact_mean("speed").alias("diff_mean"),
        (F.max("k") >= 98).alias("has_static"), (F.min("k") / 20.0).alias("hist_corr"))
    s = signals.frame_score(g.withColumn("frame_no", F.col("frame_idx") + 1))
    return s.select("camera_id", "frame_idx", r6("score"), F.array_join("reasons", ",").alias("reasons"),
                    "is_anomaly")
