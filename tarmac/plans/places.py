"""Queries joining incidents and cameras in space."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions.geo import haversine_km
from tarmac.operators import incidents as I
from tarmac.plans.registry import query
from tarmac.plans.traffic import r6
from tarmac.sources import samples as S


def km_sql(lat1, lon1, lat2, lon2):
    a = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"2 * 6371.0 * asin(sqrt({a}))"


KM = km_sql("i.lat", "i.lon", "c.lat", "c.lon")


@query("incident_camera_radius", f"""
WITH {S.SQL_INC}, {S.SQL_CAM}
SELECT event_id, cctv_id, round({KM}, 6) AS distance_km FROM inc i, cam c WHERE {KM} <= 5""")
def incident_camera_radius(spark, sf):
    return I.camera_matches(S.incidents(spark, sf), S.cameras(spark, sf)).select(
        "event_id", "cctv_id", r6("distance_km"))


SQL_NEAR = f"""{S.SQL_INC}, {S.SQL_CAM},
pl AS (SELECT DISTINCT lat, lon FROM inc),
kk AS (SELECT i.lat, i.lon, cctv_id, {KM} AS d FROM pl i, cam c),
rk AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY d, cctv_id) AS rk FROM kk),
mon AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY rk) AS rm FROM rk
        WHERE rk <= 9 AND cctv_id IN (SELECT cctv_id FROM cam WHERE acctbal >= 0))"""


@query("nearest_cameras", f"""
WITH {SQL_NEAR}
SELECT event_id, cctv_id, rm AS rank, round(d, 6) AS distance_km
FROM inc JOIN mon USING (lat, lon) WHERE rm <= 3""")
def nearest_cameras(spark, sf):
    c = S.cameras(spark, sf)
    m = I.monitored_cameras(S.incidents(spark, sf), c, c.where("acctbal >= 0"))
    return m.select("event_id", "cctv_id", "rank", r6("distance_km"))


@query("nearest_within", f"""
WITH {SQL_NEAR}
SELECT event_id, cctv_id, round(d, 6) AS distance_km FROM inc JOIN rk USING (lat, lon)
WHERE rk = 1 AND d <= 5""")
def nearest_within(spark, sf):
    """The nearest camera of each incident, only if it is within 5 km."""
    n = I.nearest_cameras(S.incidents(spark, sf), S.cameras(spark, sf), 1)
    return n.where(F.col("distance_km") <= I.MATCH_KM).select("event_id", "cctv_id", r6("distance_km"))


SQL_VERIFY = S.SQL_TRIG + f""", {S.SQL_CAM}, {S.SQL_INC}, {S.SQL_POLLS}, {S.SQL_LISTED},
near AS (SELECT c.cctv_id, i.event_id AS incident_id, i.feed_pos, i.listed_from, i.listed_until, {KM} AS match_km
         FROM li i, cam c WHERE {KM} <= 10),
cp AS (SELECT DISTINCT cctv_id, poll_ts, arg_min(incident_id, feed_pos) AS incident_id, arg_min(match_km, feed_pos) AS match_km
       FROM near JOIN po ON feed_ok AND listed_from <= poll_ts AND poll_ts < listed_until GROUP BY 1, 2),
tp AS (SELECT t.*, poll_ts, coalesce(feed_ok, false) AS feed_ok FROM trig t ASOF LEFT JOIN po ON t.ts >= po.poll_ts)"""


@query("incident_verify", f"""
WITH {SQL_VERIFY}
SELECT event_id, camera_id, epoch_us(tp.poll_ts) AS poll_us,
       CASE WHEN NOT feed_ok THEN 'uncertain' WHEN incident_id IS NOT NULL THEN 'confirmed'
            ELSE 'not_confirmed' END AS outcome,
       CASE WHEN feed_ok THEN incident_id END AS incident_id,
       CASE WHEN feed_ok THEN round(match_km, 6) END AS match_km
FROM tp LEFT JOIN cp ON tp.camera_id = cp.cctv_id AND tp.poll_ts = cp.poll_ts""")
def incident_verify(spark, sf):
    """Every trigger against what the feed listed at its last poll before."""
    v = I.verify(S.triggers(spark, sf), S.cameras(spark, sf), S.polls(spark, sf), S.listed_incidents(spark, sf))
    return v.select("event_id", "camera_id", F.unix_micros("poll_ts").alias("poll_us"), "outcome", "incident_id", r6("match_km"))


def reported(spark, sf):
    """Triggers with the official id that a quarter of them carry."""
    return S.triggers(spark, sf).select(
        "event_id", "t", (F.col("camera_id") * 10 + F.col("track_id") % 10).alias("camera_id"),
        F.when(F.col("k") % 4 == 0, F.expr("event_id div 50")).alias("incident_id"))


@query("incident_groups")
def incident_groups(spark, sf):
    """Triggers of neighbouring cameras and shared incident ids grouped into incidents."""
    return I.group_triggers(reported(spark, sf), S.cameras(spark, sf))


HOT = "25"


@query("hotspot_ranking", f"""
WITH {S.SQL_CAM}, {S.SQL_INC},
hs AS (SELECT n_name AS name, 33 + (n_nationkey * 7919 % 6000) / 1000.0 AS lat,
              124 + (n_nationkey * 104729 % 8000) / 1000.0 AS lon FROM nation),
ei AS (SELECT c.name, count(*) AS n, count(*) FILTER (event_type = 'F') AS a
       FROM inc i, hs c WHERE {KM} <= {HOT} GROUP BY 1),
ec AS (SELECT c.name, count(*) AS n FROM cam i, hs c WHERE i.acctbal >= 0 AND {KM} <= {HOT} GROUP BY 1),
sc AS (SELECT hs.name, coalesce(ei.n, 0) AS incidents, coalesce(ei.a, 0) AS accidents,
              coalesce(ec.n, 0) AS cameras FROM hs LEFT JOIN ei USING (name) LEFT JOIN ec USING (name))
SELECT *, accidents * 50 + incidents * 5 + cameras * 2 + CASE WHEN cameras >= 4 THEN 10 ELSE 0 END AS score,
       row_number() OVER (ORDER BY accidents * 50 + incidents * 5 + cameras * 2
         + CASE WHEN cameras >= 4 THEN 10 ELSE 0 END DESC, name) AS rank FROM sc""")
def hotspot_ranking(spark, sf):
    n = S.table(spark, sf, "nation")
    h = n.select(F.col("n_name").alias("name"), S._lat("n_nationkey").alias("site_lat"),
                 S._lon("n_nationkey").alias("site_lon"))
    i = S.incidents(spark, sf).withColumn("is_accident", F.col("event_type") == "F")
    c = S.cameras(spark, sf).withColumn("stream_url", F.when(F.col("acctbal") >= 0, F.col("name")))
    s = I.hotspot_scores(h, i, c, float(HOT))
    from pyspark.sql import Window

    # one row per candidate hotspot: a configured list, not data
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "name"))
    return s.select("name", "incidents", "accidents", "cameras", "score", rank.alias("rank"))


@query("new_incidents", f"""
WITH {S.SQL_INC},
fresh AS (SELECT * FROM inc i WHERE event_type <> 'F' AND NOT EXISTS (
  SELECT 1 FROM inc s WHERE s.event_type = 'F' AND s.link_id = i.link_id
  AND s.occurred_at = i.occurred_at))
SELECT link_id, occurred_at, arg_min(event_id, feed_pos) AS event_id FROM fresh GROUP BY 1, 2""")
def new_incidents(spark, sf):
    i = S.incidents(spark, sf)
    n = I.new_incidents(i.where("event_type <> 'F'"), i.where("event_type = 'F'"))
    return n.select("link_id", "occurred_at", "event_id")


@query("patrol_caps", f"""
WITH {SQL_NEAR},
c AS (SELECT event_id, occurred_at, feed_pos, cctv_id, rk,
             row_number() OVER (PARTITION BY occurred_at ORDER BY feed_pos, rk) AS visit
      FROM inc JOIN rk USING (lat, lon) WHERE rk <= 2)
SELECT occurred_at, event_id, cctv_id, rk AS rank, visit FROM c WHERE visit <= 20""")
def patrol_caps(spark, sf):
    n = I.nearest_cameras(S.incidents(spark, sf), S.cameras(spark, sf), I.PATROL_PER_INCIDENT)
    return I.patrol(n, "occurred_at").select("occurred_at", "event_id", "cctv_id", "rank", "visit")


SQL_PROMOTED = f"""
WITH {SQL_NEAR},
pr AS (SELECT cctv_id, epoch(occurred_ts) AS s, epoch(occurred_ts) + 600 AS e, event_id, rm
       FROM inc JOIN mon USING (lat, lon) WHERE rm <= 3),
o AS (SELECT *, max(e) OVER (PARTITION BY cctv_id ORDER BY s, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM pr),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe < s THEN 1 ELSE 0 END) OVER
        (PARTITION BY cctv_id ORDER BY s, event_id) AS isl FROM o)
SELECT cctv_id, CAST(min(s) AS BIGINT) AS start_t, CAST(max(e) AS BIGINT) AS end_t, count(*) AS holds
FROM g GROUP BY cctv_id, isl"""


def holds(spark, sf):
    """The time for which each incident holds each of its nearest loaded cameras."""
    c = S.cameras(spark, sf)
    m = I.monitored_cameras(S.incidents(spark, sf), c, c.where("acctbal >= 0"))
    return m.select("cctv_id", "event_id", F.unix_timestamp("occurred_ts").alias("start_t"), (F.unix_timestamp("occurred_ts") + int(I.HOLD_SEC)).alias("end_t"))


@query("promotion_intervals", SQL_PROMOTED)
def promotion_intervals(spark, sf):
    return I.merge_holds(holds(spark, sf), ["cctv_id"], "start_t", "end_t", "event_id",
                         F.floor(F.col("start_t") / (86_400 * 30)))


@query("greedy_assignment", f"""
WITH RECURSIVE h AS (
  SELECT n_nationkey AS pos, n_name AS name, 33 + (n_nationkey * 7919 % 6000) / 1000.0 AS lat,
         124 + (n_nationkey * 104729 % 8000) / 1000.0 AS lon FROM nation),
s AS (SELECT c_custkey AS cctv_id, 33 + (c_custkey * 7919 % 6000) / 1000.0 AS lat,
             124 + (c_custkey * 104729 % 8000) / 1000.0 AS lon FROM customer),
d AS (SELECT pos, name, cctv_id, {KM} AS km FROM s i, h c),
g AS (
  SELECT CAST(-1 AS BIGINT) AS pos, '' AS name, CAST(-1 AS BIGINT) AS cctv_id, CAST(0 AS DOUBLE) AS distance_km,
         CAST([] AS BIGINT[]) AS used
  UNION ALL
  SELECT d.pos, any_value(d.name), arg_min(d.cctv_id, (km, d.cctv_id)), min(km),
         list_append(any_value(used), arg_min(d.cctv_id, (km, d.cctv_id)))
  FROM g JOIN d ON d.pos = g.pos + 1 WHERE NOT list_contains(used, d.cctv_id) GROUP BY d.pos)
SELECT pos, name, cctv_id, round(distance_km, 6) AS distance_km FROM g WHERE pos >= 0""")
def greedy_assignment(spark, sf):
    """Nations take, in order, the nearest customer site nobody took before."""
    h = S.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"),
        S._lat("n_nationkey").alias("lat"), S._lon("n_nationkey").alias("lon"))
    c = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cctv_id"), S._lat("c_custkey").alias("lat"),
        S._lon("c_custkey").alias("lon"))
    return I.assign_cameras(h, c).withColumn("distance_km", F.round("distance_km", 6))


@query("marker_match", """
WITH c AS (
  SELECT s_suppkey AS id, translate(s_name, '[] ', '') AS cn, n_name AS cr,
         33 + (s_suppkey * 7919 % 6000) / 1000.0 AS lat, 124 + (s_suppkey * 104729 % 8000) / 1000.0 AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (
  SELECT c_custkey AS id, 'Supplier#' || lpad(CAST(c_custkey % 300 AS VARCHAR), 9, '0') AS mn,
         'Supplier#' || lpad(CAST(c_custkey % 300 AS VARCHAR), 9, '0') || n_name AS mr,
         33 + (c_custkey * 7919 % 6000) / 1000.0 AS lat, 124 + (c_custkey * 104729 % 8000) / 1000.0 AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (
  SELECT c.id AS camera_id, m.id AS marker_id,
         CASE WHEN contains(mn, cn) THEN 0 ELSE 1 END AS name_penalty,
         CASE WHEN contains(mr, cr) THEN 0 ELSE 1 END AS route_penalty,
         pow(m.lon - c.lon, 2) + pow(m.lat - c.lat, 2) AS dist2 FROM c, m),
r AS (SELECT *, row_number() OVER (PARTITION BY camera_id
        ORDER BY name_penalty, route_penalty, dist2, marker_id) AS rank FROM p)
SELECT camera_id, marker_id, name_penalty, route_penalty, round(dist2, 6) AS dist2, rank
FROM r WHERE rank <= 5""")
def marker_match(spark, sf):
    n = S.table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = S.cameras(spark, sf).select(F.col("cctv_id").alias("id"), "name",
                                    F.col("road_name").alias("route"), "lat", "lon")
    m = S.table(spark, sf, "customer").join(
        F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 300).cast("string"), 9, "0"))
        .alias("name"), F.col("n_name").alias("route"), S._lat("c_custkey").alias("lat"),
        S._lon("c_custkey").alias("lon"))
    out = I.match_markers(c, m)
    return out.select("camera_id", "marker_id", "name_penalty", "route_penalty", r6("dist2"), "rank")


@query("catalog_changes", f"""
WITH {S.SQL_CAM},
o AS (SELECT cctv_id, 'u/' || (cctv_id % 9) AS url FROM cam),
n AS (SELECT cctv_id, CASE WHEN cctv_id % 11 = 0 THEN '' ELSE 'u/' || (cctv_id % 7) END AS new_url FROM cam)
SELECT cctv_id, url, new_url FROM o JOIN n USING (cctv_id) WHERE new_url <> '' AND url <> new_url""")
def catalog_changes(spark, sf):
    c = S.cameras(spark, sf)
    old = c.select("cctv_id", F.concat(F.lit("u/"), F.col("cctv_id") % 9).alias("url"))
    new = c.select("cctv_id", F.when(F.col("cctv_id") % 11 == 0, "").otherwise(
        F.concat(F.lit("u/"), F.col("cctv_id") % 7)).alias("url"))
    return I.link_change(old, new)


@query("haversine_matrix", f"""
WITH {S.SQL_CAM}, {S.SQL_INC}
SELECT event_id, cctv_id, round({KM}, 6) AS km FROM inc i
JOIN cam c ON c.cctv_id = i.link_id % (SELECT count(*) FROM cam)""")
def haversine_matrix(spark, sf):
    """Distance of every incident to the camera its link is assigned to."""
    c = S.cameras(spark, sf)
    n = c.agg(F.count("*").alias("n"))
    i = S.incidents(spark, sf).join(F.broadcast(n)).withColumn("cctv_id", F.col("link_id") % F.col("n"))
    site = I.sites(c)
    return i.join(site, "cctv_id").select(
        "event_id", "cctv_id", r6(haversine_km("lat", "lon", "site_lat", "site_lon"), "km"))


@query("hotspot_quota", f"""
WITH {S.SQL_CAM}, t AS (SELECT road_name, count(*) FILTER (acctbal >= 0) AS total FROM cam GROUP BY 1)
SELECT road_name, total, CASE WHEN total = 0 THEN 0 WHEN 3 < total
  THEN greatest(1, least(greatest(1, CAST(floor(3 * least(50.0 / total, 1.0)) AS BIGINT)), 2))
  ELSE least(50, total) END AS quota FROM t""")
def hotspot_quota(spark, sf):
    t = S.cameras(spark, sf).groupBy("road_name").agg(
        F.count_if(F.col("acctbal") >= 0).alias("total"))
    return t.withColumn("quota", F.when(F.col("total") == 0, F.lit(0).cast("long")).otherwise(
        I.hotspot_quota(F.nullif("total", F.lit(0)), 50, 3)))


def checks_sql(k):
    """Of recording r: what the latest poll in the half hour before its check k says, and whether it lists something near."""
    at = f"r.end_ts + INTERVAL {int(I.VERIFY_DELAY + k * I.RECHECK_SEC)} SECONDS"
    return f"""k{k} AS (SELECT r.event_id, coalesce(p.feed_ok, false) AS ok, coalesce(p.feed_ok, false) AND c.cctv_id IS NOT NULL AS seen
      FROM (SELECT *, {at} AS at FROM re r) r ASOF LEFT JOIN (SELECT poll_ts, feed_ok FROM po) p ON r.at >= p.poll_ts
      LEFT JOIN cp c ON c.cctv_id = r.camera_id AND c.poll_ts = p.poll_ts WHERE p.poll_ts >= r.at - INTERVAL 1800 SECONDS)"""


SQL_OUTCOMES = SQL_VERIFY + f""",
re AS (SELECT camera_id, event_id, severity, ts AS end_ts FROM trig), {', '.join(checks_sql(k) for k in range(I.RECHECKS + 1))},
fc AS (SELECT r.camera_id, r.event_id, r.severity, CASE WHEN k0.seen THEN 0 WHEN k1.seen THEN 1 WHEN k2.seen THEN 2 WHEN k3.seen THEN 3 END AS first_check,
              NOT coalesce(k0.ok, false) AS u
       FROM re r LEFT JOIN k0 USING (event_id) LEFT JOIN k1 USING (event_id) LEFT JOIN k2 USING (event_id) LEFT JOIN k3 USING (event_id)),
oc AS (SELECT camera_id, event_id, coalesce(first_check, -1) AS first_check, u AS uncertain, CASE WHEN first_check = 0 AND NOT u THEN 'confirmed'
    WHEN (severity >= 0.7 OR u) AND first_check BETWEEN 1 AND 3 THEN 'confirmed'
    WHEN (severity >= 0.7 OR u) AND (severity >= 0.8 OR u) THEN 'pending_preserved'
    ELSE 'deleted' END AS action FROM fc)"""


def recordings(spark, sf):
    return S.triggers(spark, sf).select("camera_id", "event_id", "severity", F.col("ts").alias("end_ts"))


def feed(spark, sf):
    near = I.listed_near(S.listed_incidents(spark, sf), I.watched(S.cameras(spark, sf), recordings(spark, sf)))
    return I.feed_rows(S.polls(spark, sf), near)


@query("collection_outcomes", f"""
WITH {SQL_OUTCOMES}
SELECT camera_id, action, count(*) AS n FROM oc GROUP BY 1, 2""")
def collection_outcomes(spark, sf):
    """What became of the recordings of each camera, by the polls current at their checks."""
    r = I.recording_outcomes(recordings(spark, sf), feed(spark, sf))
    return r.groupBy("camera_id", "action").agg(F.count("*").alias("n"))
