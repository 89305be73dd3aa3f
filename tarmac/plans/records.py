"""Queries on responses, recordings, keyframes and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarmac.operators import keyframes as KF
from tarmac.operators import motion, normalise, scoring
from tarmac.operators import recordings as REC
from tarmac.plans.anomaly import SQL_FEATURES
from tarmac.plans.registry import query
from tarmac.plans.traffic import r6
from tarmac.session import shared_dir, spread, stage
from tarmac.sinks import tables
from tarmac.sources import samples as S

# response texts built from events: fenced JSON, JSON inside prose, broken JSON, prose
SQL_RESP = S.SQL_EV + """,
tx AS (SELECT event_id, k, 'T' || (1 + event_id % 13) AS vision, CASE event_id % 4
    WHEN 0 THEN '```json' || chr(10) || '{"accident_detected": "yes", "confidence": ' || k || ', "accident_type": "rear_end", "severity": "fatal", "involved_vehicles": [1, 2], "corrected_class": " t4 ", "unit_count": 2, "axle_count": 9, "risk_level": "high", "traffic_state": "jam", "fire": true, "blocked_lanes": [1, 2]}' || chr(10) || '```'
    WHEN 1 THEN 'Result: {"accident_detected": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "confidence": "0.25", "accident_type": "x", "involved_vehicles": [3], "corrected_class": "T5", "vision_agreed": "no", "anomalies": ["a"]} end'
    WHEN 2 THEN '{"accident_detected": 1, "confidence": '
    ELSE 'nothing seen ' || k END AS text FROM ev)"""


def responses(spark, sf):
    e = S.ev(spark, sf)
    i, k = F.col("event_id") % 4, F.col("k").cast("string")
    flag = F.when(F.col("k") % 2 == 0, "true").otherwise("false")
    text = (
        F.when(i == 0, F.concat(F.lit('```json\n{"accident_detected": "yes", "confidence": '), k, F.lit(
            ', "accident_type": "rear_end", "severity": "fatal", "involved_vehicles": [1, 2], '
            '"corrected_class": " t4 ", "unit_count": 2, "axle_count": 9, "risk_level": "high", '
            '"traffic_state": "jam", "fire": true, "blocked_lanes": [1, 2]}\n```')))
        .when(i == 1, F.concat(F.lit('Result: {"accident_detected": '), flag, F.lit(
            ', "confidence": "0.25", "accident_type": "x", "involved_vehicles": [3], '
            '"corrected_class": "T5", "vision_agreed": "no", "anomalies": ["a"]} end')))
        .when(i == 2, F.lit('{"accident_detected": 1, "confidence": '))
        .otherwise(F.concat(F.lit("nothing seen "), k)))
    return e.select("event_id", "k", F.concat(F.lit("T"), 1 + F.col("event_id") % 13).alias("vision"),
                    text.alias("text"))


@query("response_normalise", f"""
WITH {SQL_RESP}, m AS (SELECT *, event_id % 4 AS i FROM tx)
SELECT event_id, CASE i WHEN 0 THEN true WHEN 1 THEN k % 2 = 0 ELSE false END AS accident_detected,
  CASE i WHEN 0 THEN least(1.0, CAST(k AS DOUBLE)) WHEN 1 THEN 0.25 ELSE 0.0 END AS confidence,
  CASE i WHEN 0 THEN 'rear_end' ELSE 'none' END AS accident_type, CASE i WHEN 0 THEN 'fatal' ELSE 'minor' END AS severity,
  CASE WHEN i = 0 THEN '[1,2]' WHEN i = 1 AND k % 2 = 0 THEN '[3]' ELSE '[]' END AS involved_vehicles, i >= 2 AS parse_error,
  CASE i WHEN 0 THEN 'T4' WHEN 1 THEN 'T5' ELSE vision END AS corrected_class,
  CASE i WHEN 0 THEN 2 ELSE 1 END AS unit_count, 2 AS axle_count,
  CASE i WHEN 0 THEN vision = 'T4' WHEN 1 THEN false ELSE true END AS vision_agreed,
  'free_flow' AS traffic_state, CASE i WHEN 0 THEN 'high' ELSE 'low' END AS risk_level,
  CASE i WHEN 1 THEN '["a"]' ELSE '[]' END AS anomalies, i = 0 AS fire, CASE i WHEN 0 THEN 2 ELSE 0 END AS lanes FROM m""")
def response_normalise(spark, sf):
    r = normalise.with_json(spread(responses(spark, sf), "event_id"), "text")
    a = normalise.accident(r, "text").drop("k", "timestamp_estimated", "reasoning")
    c = normalise.vehicle_class(a.withColumnRenamed("confidence", "conf"), "text", "vision") \
        .drop("confidence", "reasoning").withColumnRenamed("conf", "confidence")
    s = normalise.scene(c, "text").drop("scene_description")
    keep = [x for x in s.columns if x not in ("text", "json", "doc")]
    o = normalise.outbreak(s.withColumn("conf", F.col("confidence")).withColumn("sev", F.col("severity")), "text")
    return o.select(*[x for x in keep if x not in ("confidence", "severity", "vision")],
                    F.col("conf").alias("confidence"), F.col("sev").alias("severity"), "fire",
                    F.coalesce(F.size("lane_damage"), F.lit(0)).alias("lanes"))


@query("report_normalise", """
WITH c AS (SELECT conv_id * 100 + turn AS id, text, turn % 3 AS i, 'NATION_' || conv_id % 25 AS road, conv_id % 7 AS km FROM conversations)
SELECT id, 8 AS sections, CASE i WHEN 0 THEN 2 ELSE 0 END AS given_sections, CASE i WHEN 0 THEN '경부선' ELSE road END AS line,
  '부산' AS way, CAST(km AS VARCHAR) AS km_post, CASE i WHEN 0 THEN '졸음' ELSE '' END AS cause_primary, 'CCTV' AS reported_by,
  CASE i WHEN 0 THEN 0.9 ELSE 0.3 END AS confidence, i <> 0 AS needs_review,
  md5(CASE i WHEN 0 THEN '' ELSE text END) AS narrative_md5 FROM c""")
def report_normalise(spark, sf):
    c = S.table(spark, sf, "conversations")
    good = F.lit('{"위치": {"노선명": "경부선", "방향": ""}, "추론": {"cause_primary": "졸음", "confidence": 0.9}}')
    d = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"),
                 F.when(F.col("turn") % 3 == 0, good).otherwise(F.col("text")).alias("text"),
                 F.concat(F.lit("NATION_"), F.col("conv_id") % 25).alias("road_name"),
                 F.lit("부산").alias("direction"), (F.col("conv_id") % 7).alias("km"), F.lit("A").alias("branch"))
    r = normalise.report(d, "text")
    return r.select("id", "sections", "given_sections", "line", "way", "km_post", "cause_primary",
                    "reported_by", "confidence", "needs_review", F.md5("narrative").alias("narrative_md5"))


@query("llm_batch_eval", """
WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'abnormal' ELSE 'normal' END AS label, max(turn) > 3 AS anomaly,
             sum(length(text)) / 10.0 AS latency, count(*) FILTER (role = 'assistant') AS vehicles FROM conversations GROUP BY 1)
SELECT label, count(*) AS clips, round(avg(latency), 6) AS mean_latency, count(*) FILTER (vehicles > 0) AS with_vehicles,
  count(*) FILTER (label = 'abnormal' AND anomaly) AS tp, count(*) FILTER (label <> 'abnormal' AND anomaly) AS fp,
  count(*) FILTER (label = 'abnormal' AND NOT anomaly) AS fn, count(*) FILTER (label <> 'abnormal' AND NOT anomaly) AS tn
FROM c GROUP BY 1""")
def llm_batch_eval(spark, sf):
    c = S.table(spark, sf, "conversations").groupBy("conv_id").agg(
        (F.max("turn") > 3).alias("anomaly"), (F.sum(F.length("text")) / 10.0).alias("latency"),
        F.count_if(F.col("role") == "assistant").alias("vehicles"))
    c = c.withColumn("label", F.when(F.col("conv_id") % 3 == 0, "abnormal").otherwise("normal"))
    return normalise.evaluate(c, ["label"]).withColumn("mean_latency", F.round("mean_latency", 6))


@query("responses_by_ic", f"""
WITH {S.SQL_EV}, v AS (SELECT DISTINCT camera_id, track_id FROM ev WHERE k >= 50)
SELECT conv_id * 100 + turn AS response_id, v.camera_id FROM conversations JOIN v ON v.track_id = conv_id % 15 AND v.camera_id = turn % 10""")
def responses_by_ic(spark, sf):
    """Responses whose video was seen at an interchange."""
    v = S.ev(spark, sf).where("k >= 50").select("camera_id", "track_id").distinct()
    c = S.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("response_id"),
        (F.col("conv_id") % 15).alias("track_id"), (F.col("turn") % 10).alias("camera_id"))
    return c.join(v, ["camera_id", "track_id"], "left_semi").select("response_id", "camera_id")


def recordings(spark, sf):
    e = S.ev(spark, sf)
    return e.select(
        F.col("camera_id").alias("camera"), F.date_format("ts", "yyyyMMdd").alias("day"),
        F.when(F.col("k") == 0, 0).otherwise(F.col("k") * 65_536).cast("long").alias("length"),
        F.unix_timestamp("ts").alias("mtime"),
        F.concat(F.lit("rec/"), F.date_format("ts", "yyyyMMdd"), F.lit("/"), "camera_id", F.lit("_hls/"),
                 F.lpad("event_id", 12, "0"), F.when(F.col("event_id") % 2 == 0, ".ts").otherwise(".mp4")).alias("path"))


SQL_REC = S.SQL_EV + """,
rec AS (SELECT camera_id AS camera, strftime(ts, '%Y%m%d') AS day, CASE WHEN k = 0 THEN 0 ELSE k * 65536 END AS length,
          CAST(floor(epoch(ts)) AS BIGINT) AS mtime, 'rec/' || strftime(ts, '%Y%m%d') || '/' || camera_id || '_hls/' ||
          lpad(CAST(event_id AS VARCHAR), 12, '0') || CASE WHEN event_id % 2 = 0 THEN '.ts' ELSE '.mp4' END AS path FROM ev),
mx AS (SELECT max(mtime) AS now FROM rec),
he AS (SELECT e.cctv_id AS camera, coalesce(sum(length), 0) AS bytes_total, count(path) AS files_total,
         count(*) FILTER (path LIKE '%.mp4') AS mp4_count, count(*) FILTER (path LIKE '%.ts') AS ts_count,
         count(*) FILTER (length = 0) AS zero_count, max(mtime) AS latest, max(mtime) FILTER (length > 0) AS latest_valid,
         max(mtime) FILTER (length >= 1048576) AS latest_good
       FROM (SELECT s_suppkey AS cctv_id FROM supplier) e LEFT JOIN rec ON rec.camera = e.cctv_id GROUP BY 1),
hs AS (SELECT *, CASE WHEN latest IS NULL OR now - latest > 900 THEN '문제' WHEN latest_valid IS NULL OR now - latest_valid > 1800 THEN '주의'
         ELSE '정상' END AS status, coalesce(now - latest_good <= 300, false) AS active FROM he, mx)"""


@query("recording_health", f"""
WITH {SQL_REC}
SELECT camera, CAST(bytes_total AS BIGINT) AS bytes_total, files_total, mp4_count, ts_count, zero_count, status, active FROM hs""")
def recording_health(spark, sf):
    r = recordings(spark, sf)
    now = F.lit(r.agg(F.max("mtime")).first()[0])
    expected = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("camera"))
    return REC.camera_health(r, expected, now).select(
        "camera", "bytes_total", "files_total", "mp4_count", "ts_count", "zero_count", "status", "active")


@query("health_metrics", f"""
WITH {SQL_REC}, t AS (SELECT count(*) AS a, count(*) FILTER (active) AS b, sum(bytes_total) AS c, sum(zero_count) AS d, count(*) FILTER (NOT active) AS e FROM hs)
SELECT 'cctv_recording_cameras_total' AS metric, CAST(a AS DOUBLE) AS value FROM t UNION ALL
SELECT 'cctv_recording_cameras_active', CAST(b AS DOUBLE) FROM t UNION ALL SELECT 'cctv_recording_day_bytes', CAST(c AS DOUBLE) FROM t UNION ALL
SELECT 'cctv_recording_zero_byte_files', CAST(d AS DOUBLE) FROM t UNION ALL SELECT 'cctv_recording_stale_cameras', CAST(e AS DOUBLE) FROM t""")
def health_metrics(spark, sf):
    r = recordings(spark, sf)
    now = F.lit(r.agg(F.max("mtime")).first()[0])
    expected = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("camera"))
    return REC.metrics(REC.totals(REC.camera_health(r, expected, now)))


@query("retention", f"""
WITH {SQL_REC}
SELECT day, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM rec
WHERE strptime(day, '%Y%m%d') < DATE '2024-01-31' - 21 GROUP BY 1""")
def retention(spark, sf):
    return REC.expired(recordings(spark, sf), F.lit("2024-01-31").cast("date"))


@query("recording_coverage", f"""
WITH {SQL_REC}, l AS (SELECT camera, day, max(path) AS file FROM rec GROUP BY 1, 2),
i AS (SELECT o_orderkey AS event_id, o_custkey % 12 AS camera, '202401' || lpad(CAST(1 + o_orderkey % 31 AS VARCHAR), 2, '0') AS day FROM orders)
SELECT event_id, i.camera, i.day, file FROM i LEFT JOIN l USING (camera, day)""")
def recording_coverage(spark, sf):
    i = S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 12).alias("camera"),
        F.concat(F.lit("202401"), F.lpad((1 + F.col("o_orderkey") % 31).cast("string"), 2, "0")).alias("day"))
    return REC.coverage(i, recordings(spark, sf)).select("event_id", "camera", "day", "file")


@query("uptime_gaps", f"""
WITH {SQL_REC}, g AS (SELECT camera, mtime - lag(mtime) OVER (PARTITION BY camera ORDER BY mtime, path) AS gap FROM rec),
s AS (SELECT camera, count(*) AS files, count(*) FILTER (gap > 3600) AS gap_count, CAST(coalesce(sum(gap) FILTER (gap > 3600), 0) AS BIGINT) AS gap_seconds FROM g GROUP BY 1)
SELECT *, round(greatest(0.0, least(100.0, (1 - gap_seconds / 2678400.0) * 100)), 6) AS uptime_pct FROM s""")
def uptime_gaps(spark, sf):
    g = REC.gaps(recordings(spark, sf), 3600, F.lit(S.EPOCH_2024), F.lit(S.EPOCH_2024 + 2_678_400))
    return g.withColumn("uptime_pct", F.round("uptime_pct", 6))


@query("media_quality", """
WITH m AS (SELECT page_id, 320 + length(html) % 1600 AS width, (320 + length(html) % 1600) * 9 // 16 AS height, 5 + page_id % 30 AS fps, length(url) AS duration FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN width < 640 OR height < 480 THEN 'resolution' END, CASE WHEN fps < 15 THEN 'fps' END,
  CASE WHEN duration < 10 THEN 'duration' END) AS failures, NOT (width < 640 OR height < 480 OR fps < 15 OR duration < 10) AS passed FROM m""")
def media_quality(spark, sf):
    q = REC.media_quality(media(spark, sf))
    return q.select("page_id", F.array_join("failures", ",").alias("failures"), "passed")


def media(spark, sf):
    p = S.table(spark, sf, "pages")
    w = 320 + F.length("html") % 1600
    return p.select("page_id", w.alias("width"), F.floor(w * 9 / 16).alias("height"),
                    (5 + F.col("page_id") % 30).alias("fps"), F.length("url").alias("duration"),
                    (F.col("page_id") % 10).alias("camera_id"),
                    (F.col("page_id") * 97 % 20_000).cast("double").alias("start_t"))


@query("trigger_followup", f"""
WITH {S.SQL_TRIG}, m AS (SELECT page_id, page_id % 10 AS camera_id, CAST(page_id * 97 % 20000 AS DOUBLE) AS start_t, 5 + page_id % 30 AS fps FROM pages)
SELECT event_id, page_id, fps FROM trig JOIN m ON trig.camera_id = m.camera_id AND start_t BETWEEN t - 30 AND t + 300""")
def trigger_followup(spark, sf):
    """Recordings taken around each trigger."""
    f = REC.followups(S.triggers(spark, sf), media(spark, sf), 30, 300)
    return f.select("event_id", "page_id", "fps")


@query("upsert_latest", f"""
WITH {S.SQL_EV} SELECT camera_id, track_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(speed, (ts, event_id)) AS speed,
  'pipeline' AS source FROM ev GROUP BY 1, 2""")
def upsert_latest(spark, sf):
    """Two writes into a keyed table; the later row of a key stays."""
    e = S.ev(spark, sf).select("camera_id", "track_id", "event_id", "speed", F.unix_micros("ts").alias("us"))
    e = e.withColumn("seq", F.struct("us", "event_id"))
    path = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    first = F.col("event_id") % 3 == 0
    for part in (e.where(first), e.where(~first)):
        tables.upsert(part, path, ["camera_id", "track_id"], "seq", "camera_id")
    out = spark.read.parquet(path).drop("seq", "us").withColumn("camera_id", F.col("camera_id").cast("long"))
    return tables.migrate(out, {"source": "string"}, {"source": "pipeline"})


@query("schema_evolution", f"""
WITH {S.SQL_EV} SELECT event_id, camera_id, CASE WHEN k >= 50 THEN cls END AS vehicle_cls,
  CASE WHEN k >= 50 THEN 'v2' ELSE 'CCTV' END AS report_source FROM ev""")
def schema_evolution(spark, sf):
    e = S.ev(spark, sf)
    old = e.where("k < 50").select("event_id", "camera_id")
    new = e.where("k >= 50").select("event_id", "camera_id", F.col("cls").alias("vehicle_cls"),
                                    F.lit("v2").alias("report_source"))
    return tables.migrate(old.unionByName(new, allowMissingColumns=True), {}, {"report_source": "CCTV"})


def checks():
    return {"speed_range": F.col("speed") <= 80, "known_class": F.col("cls") != "person"}


@query("dead_letter", f"""
WITH {S.SQL_EV} SELECT event_id, strftime(ts, '%Y%m%d') AS day, concat_ws('; ', CASE WHEN speed > 80 THEN 'speed_range' END,
  CASE WHEN cls = 'person' THEN 'known_class' END) AS error FROM ev WHERE speed > 80 OR cls = 'person'""")
def dead_letter(spark, sf):
    _, bad = tables.split_valid(S.ev(spark, sf), checks())
    letters = tables.dead_letters(bad, "tracks", F.date_format("ts", "yyyyMMdd"))
    return letters.select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), "day", "error")


@query("dead_letter_replay", f"""
WITH {S.SQL_EV} SELECT cls = 'person' AS kept, count(*) AS n, round(sum(speed), 6) AS speed FROM ev WHERE speed > 80 OR cls = 'person' GROUP BY 1""")
def dead_letter_replay(spark, sf):
    """Dead letters written, read back and replayed against a relaxed speed check."""
    _, bad = tables.split_valid(S.ev(spark, sf).drop("ts"), checks())
    path = f"{shared_dir(spark)}/dead-{uuid.uuid4().hex}"
    tables.write_dead_letters(tables.dead_letters(bad, "tracks", F.lit("20240101")), path)
    back = spark.read.schema("error string, record string, kind string, day string").json(path)
    good, keep = tables.replay(back, "event_id long, camera_id long, speed double, cls string",
                               {"known_class": F.col("cls") != "person"})
    kept = keep.select(F.from_json("record", "speed double").alias("r")).select(F.lit(True).alias("kept"), "r.speed")
    both = good.select(F.lit(False).alias("kept"), "speed").unionByName(kept)
    return both.groupBy("kept").agg(F.count("*").alias("n"), F.round(F.sum("speed"), 6).alias("speed"))


@query("export_roundtrip", f"""
WITH {S.SQL_TRAJ} SELECT clip_id, count(*) AS n, round(sum(round((x * 1280) / 1280.0, 6)), 4) AS sx,
  count(*) FILTER (flag = 'R') AS major, CAST(sum(CASE WHEN flag = 'R' THEN 3 ELSE -1 END) AS BIGINT) AS minor FROM traj GROUP BY 1""")
def export_roundtrip(spark, sf):
    """Trajectories exported as text by split and range of clips, then read back."""
    t = S.traj(spark, sf)
    b = t.select("clip_id", "frame", "track_id", (F.col("x") * 1280).alias("x"), (F.col("y") * 720).alias("y"),
                 F.lit(0.0).alias("w"), F.lit(0.0).alias("h"),
                 F.when(F.col("flag") == "R", "차선 물기").otherwise("정상차로변경 주행").alias("driving"))
    rows = tables.trajectory_rows(b)
    share = scoring.split_share(F.col("clip_id"))
    rows = rows.withColumn("split", F.when((F.col("clip_id") % 3 != 0) & (share < 80), "train").otherwise("test"))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    tables.write_trajectories(rows, path)
    back = tables.read_trajectories(spark, path)
    return back.groupBy("clip_id").agg(
        F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.count_if(F.col("major") == 1).alias("major"),
        F.sum("minor").alias("minor"))


@query("keyframe_window", f"""
WITH {S.SQL_OBS},
fq AS (SELECT camera_id, frame_idx, max(least(1.0, w * h / (1920.0 * 1080)) * (k / 100.0) *
         greatest(0.0, 1 - (abs(cx - 960) / 960 + abs(cy - 540) / 540) / 2)) AS q FROM obs GROUP BY 1, 2),
tr AS (SELECT camera_id, event_id, frame_idx AS trigger_frame FROM obs WHERE k >= 95)
SELECT event_id, tr.camera_id, trigger_frame, count(*) AS candidates, round(max(q), 9) AS best_quality, arg_max(frame_idx, (q, -frame_idx)) AS best_frame
FROM tr JOIN fq ON fq.camera_id = tr.camera_id AND abs(frame_idx - trigger_frame) <= 10 GROUP BY 1, 2, 3""")
def keyframe_window(spark, sf):
    o = S.obs(spark, sf)
    f = KF.frame_quality(o, F.col("k") / 100.0)
    t = o.where("k >= 95").select("camera_id", "event_id", F.col("frame_idx").alias("trigger_frame"))
    w = KF.window_frames(t, f, 10)
    return w.groupBy("event_id", "camera_id", "trigger_frame").agg(
        F.count("*").alias("candidates"), F.round(F.max("q"), 9).alias("best_quality"),
        F.max_by("frame_idx", F.struct(F.col("q"), -F.col("frame_idx"))).alias("best_frame"))


@query("keyframes", f"""
WITH RECURSIVE {S.SQL_OBS},
fq AS (SELECT camera_id, frame_idx, max(t) AS t, max(least(1.0, w * h / (1920.0 * 1080)) * (k / 100.0) *
         greatest(0.0, 1 - (abs(cx - 960) / 960 + abs(cy - 540) / 540) / 2)) AS q FROM obs GROUP BY 1, 2),
tr AS (SELECT camera_id, event_id, frame_idx AS trigger_frame, t AS trigger_t FROM obs WHERE k >= 95),
ca AS MATERIALIZED (SELECT tr.*, fq.frame_idx AS f, fq.t AS ft, row_number() OVER (PARTITION BY tr.camera_id, event_id ORDER BY q DESC, frame_idx) AS rn
  FROM tr JOIN fq ON fq.camera_id = tr.camera_id AND abs(frame_idx - trigger_frame) <= 10),
pick AS (
  SELECT camera_id, event_id, trigger_frame, CAST(0 AS BIGINT) AS rn, [trigger_frame] AS fs, [trigger_t] AS ts FROM tr
  UNION ALL
  SELECT p.camera_id, p.event_id, p.trigger_frame, c.rn,
         CASE WHEN len(fs) < 5 AND f <> p.trigger_frame AND len(list_filter(ts, lambda x: abs(x - ft) < 2)) = 0 THEN list_append(fs, f) ELSE fs END,
         CASE WHEN len(fs) < 5 AND f <> p.trigger_frame AND len(list_filter(ts, lambda x: abs(x - ft) < 2)) = 0 THEN list_append(ts, ft) ELSE ts END
  FROM pick p JOIN ca c ON c.camera_id = p.camera_id AND c.event_id = p.event_id AND c.rn = p.rn + 1)
SELECT event_id, camera_id, trigger_frame, array_to_string(list_sort(fs), ',') AS keyframes FROM pick
QUALIFY row_number() OVER (PARTITION BY camera_id, event_id ORDER BY rn DESC) = 1""")
def keyframes(spark, sf):
    """Selected keyframes of every trigger."""
    o = S.obs(spark, sf)
    f = KF.frame_quality(o, F.col("k") / 100.0)
    t = o.where("k >= 95").select("camera_id", "event_id", F.col("frame_idx").alias("trigger_frame"),
                                  F.col("t").alias("trigger_t"))
    s = KF.select(KF.window_frames(t, f, 10), min_gap=2.0)
    return s.select("event_id", "camera_id", "trigger_frame", F.array_join("keyframes", ",").alias("keyframes"))


SQL_HIST = ", ".join(f"count(*) FILTER (cls = '{c}')::DOUBLE AS c{i}" for i, c in enumerate(("T1", "T3", "T5", "T13", "person")))


@query("change_frames", f"""
WITH {S.SQL_OBS},
hi AS (SELECT camera_id, frame_idx // 60 AS clip, frame_idx, {SQL_HIST} FROM obs GROUP BY 1, 2, 3),
pv AS (SELECT *, {', '.join(f'lag(c{i}) OVER w AS p{i}' for i in range(5))}, row_number() OVER w AS g,
              count(*) OVER (PARTITION BY camera_id, clip) AS n FROM hi WINDOW w AS (PARTITION BY camera_id, clip ORDER BY frame_idx)),
di AS (SELECT camera_id, clip, frame_idx, g = 1 OR g = n AS edge, CASE WHEN p0 IS NOT NULL THEN
         sqrt(greatest(0.0, 1 - ({' + '.join(f'sqrt(c{i} * p{i})' for i in range(5))}) / sqrt(({' + '.join(f'c{i}' for i in range(5))}) * ({' + '.join(f'p{i}' for i in range(5))})))) END AS d FROM pv)
SELECT camera_id, clip, frame_idx, round(d, 6) AS d FROM di
QUALIFY row_number() OVER (PARTITION BY camera_id, clip ORDER BY edge DESC, d DESC NULLS LAST, frame_idx) <= 5""")
def change_frames(spark, sf):
    """Change-point frames of every camera-hour from class histograms."""
    o = S.obs(spark, sf)
    classes = ["T1", "T3", "T5", "T13", "person"]
    h = o.groupBy("camera_id", F.expr("frame_idx div 60").alias("clip"), "frame_idx").agg(F.array(*[
        F.count_if(F.col("cls") == c).cast("double") for c in classes]).alias("hist"))
    return KF.change_points(h, ["camera_id", "clip"]).select("camera_id", "clip", "frame_idx", r6("d"))


@query("trigger_context", f"""
WITH {SQL_FEATURES}, tr AS (SELECT camera_id, event_id, frame_idx, track_id FROM motion WHERE k >= 95),
tc AS (SELECT tr.event_id, count(*) AS pairs, round(min(ttc), 6) AS min_ttc FROM tr JOIN ttc ON ttc.camera_id = tr.camera_id
         AND ttc.frame_idx = tr.frame_idx AND tr.track_id IN (track_a, track_b) GROUP BY 1)
SELECT tr.event_id, tr.camera_id, tr.track_id, m.track_age, round(m.speed_kmh, 6) AS speed_kmh, coalesce(pairs, 0) AS pairs, min_ttc
FROM tr JOIN motion m USING (camera_id, frame_idx, track_id) LEFT JOIN tc ON tc.event_id = tr.event_id""")
def trigger_context(spark, sf):
    m = stage(motion.motion(S.obs(spark, sf)))
    t = m.where("k >= 95").select("camera_id", "event_id", "frame_idx", F.array("track_id").alias("involved_tracks"))
    c = KF.trigger_context(t, m.drop("event_id"), motion.pair_ttc(m))
    tr = F.get("tracks", F.lit(0))
    return c.select("event_id", "camera_id", tr["track_id"].alias("track_id"), tr["track_age"].alias("track_age"),
                    F.round(tr["speed_kmh"], 6).alias("speed_kmh"),
                    F.coalesce(F.size("ttc_pairs"), F.lit(0)).cast("long").alias("pairs"),
                    F.round(F.get("ttc_pairs", F.lit(0))["ttc"], 6).alias("min_ttc"))


@query("nearest_frames", f"""
WITH {S.SQL_OBS}, f AS (SELECT DISTINCT camera_id, frame_idx FROM obs WHERE frame_idx % 7 = 3),
t AS (SELECT camera_id, event_id, frame_idx AS trigger_frame FROM obs WHERE k >= 90),
r AS (SELECT event_id, t.camera_id, trigger_frame, f.frame_idx, row_number() OVER (PARTITION BY event_id
        ORDER BY abs(f.frame_idx - trigger_frame), f.frame_idx) AS rk FROM t JOIN f USING (camera_id))
SELECT event_id, camera_id, trigger_frame, frame_idx FROM r WHERE rk = 1""")
def nearest_frames(spark, sf):
    """The closest stored frame to every trigger frame when only every seventh is stored."""
    o = S.obs(spark, sf)
    t = o.where("k >= 90").select("camera_id", "event_id", F.col("frame_idx").alias("trigger_frame"))
    return KF.nearest_frame(t, o.where("frame_idx % 7 = 3"), ["camera_id"])


@query("frame_neighbours", f"""
WITH {S.SQL_OBS}, f AS (SELECT camera_id, frame_idx, row_number() OVER (PARTITION BY camera_id ORDER BY frame_idx) AS p,
  count(*) OVER (PARTITION BY camera_id) AS n FROM (SELECT DISTINCT camera_id, frame_idx FROM obs WHERE frame_idx % 7 = 3)),
t AS (SELECT camera_id, event_id, frame_idx AS trigger_frame FROM obs WHERE k >= 90),
r AS (SELECT event_id, t.camera_id, trigger_frame, p, n, row_number() OVER (PARTITION BY event_id
        ORDER BY abs(f.frame_idx - trigger_frame), f.frame_idx) AS rk FROM t JOIN f USING (camera_id)),
w AS (SELECT DISTINCT event_id, camera_id, trigger_frame, unnest([greatest(1, p - 5), p, least(n, p + 5)]) AS p FROM r WHERE rk = 1)
SELECT event_id, camera_id, trigger_frame, frame_idx FROM w JOIN f USING (camera_id, p)""")
def frame_neighbours(spark, sf):
    """The closest stored frame to every trigger frame, with the fifth before and the fifth after it."""
    o = S.obs(spark, sf)
    t = o.where("k >= 90").select("camera_id", "event_id", F.col("frame_idx").alias("trigger_frame"))
    return KF.neighbour_frames(t, o.where("frame_idx % 7 = 3"), ["camera_id"])
