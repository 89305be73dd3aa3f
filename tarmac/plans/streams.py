"""Queries run as streams over all available rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators import episodes, incidents, motion, triggers
from tarmac.plans import places
from tarmac.plans.registry import query
from tarmac.plans.anomaly import SQL_ALARMS, SQL_FEATURES, alarm_events
from tarmac.plans.events import FAIL_LIMIT, SQL_EPISODES, SQL_HEALTH, failures
from tarmac.plans.traffic import PERIOD, SQL_DIRECTIONS, SQL_FLOW, r6
from tarmac.session import stage
from tarmac.sources import samples as S
from tarmac.streaming import live, runs

DELAY = 600


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("traffic_stream", f"""
WITH {SQL_FLOW}
SELECT ic_name, period_start, volume, round(avg_speed, 6) AS avg_speed, round(speed_std, 6) AS speed_std,
       round(truck_ratio, 6) AS truck_ratio FROM flow""")
def traffic_stream(spark, sf):
    """Interval flow as a stream; a heartbeat past the end closes the last windows."""
    e = event_stream(spark, sf)
    last = S.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    e = runs.heartbeat(e, f"{2 * PERIOD + DELAY + 1} seconds", last).select(
        (F.col("user_id") % 10).alias("ic_name"), "ts", F.expr("user_id div 10").alias("track_id"),
        F.col("value").alias("speed"), S.vehicle_class().alias("vehicle_cls"), "event_id")
    f = runs.drain(runs.traffic_flow(e, PERIOD, f"{DELAY} seconds"))
    return f.where("ic_name IS NOT NULL").select("ic_name", "period_start", "volume", r6("avg_speed"), r6("speed_std"), r6("truck_ratio"))


@query("dedupe_stream", """
SELECT DISTINCT user_id, event_type, strftime(ts, '%Y%m%d') AS day FROM events""")
def dedupe_stream(spark, sf):
    e = event_stream(spark, sf).select("user_id", "event_type", "ts", F.date_format("ts", "yyyyMMdd").alias("day"))
    return runs.drain(runs.first_seen(e, ["user_id", "event_type", "day"])).drop("ts")


def trigger_signals(spark, sf):
    m = stage(motion.motion(S.obs(spark, sf)))
    cars = m.where(~F.col("cls").isin("person", "pedestrian"))
    return triggers.signals(m, motion.pair_ttc(cars))


@query("trigger_detector")
def trigger_detector(spark, sf):
    """All triggers of all cameras, batch form."""
    t = triggers.detect(stage(trigger_signals(spark, sf)))
    return t.select("camera_id", "type", "frame_idx", "t", F.array_join("involved_tracks", ",").alias("involved"),
                    r6("severity"))


@query("trigger_stream")
def trigger_stream(spark, sf):
    f = triggers.stream_rows(trigger_signals(spark, sf), F.timestamp_seconds(F.lit(S.EPOCH_2024) + F.col("t")))
    s = runs.keyed_fold(runs.shuffled_stream(stage(f), "ts", late=9.0, beat="2 days"), ["camera_id", "type"], ["frame_idx"], triggers.stream_fold, triggers.SCHEMA, idle_sec=86_400)
    return runs.drain(s).select("camera_id", "type", "frame_idx", "t",
                                F.array_join("involved_tracks", ",").alias("involved"), r6("severity"))


@query("feature_state_stream", f"""
WITH {SQL_FEATURES}
SELECT camera_id, track_id, frame_idx, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in motion.FEATURES)} FROM features""")
def feature_state_stream(spark, sf):
    """All fifteen features of a feed whose rows come up to nine seconds late and in several micro-batches."""
    o = S.obs(spark, sf).select("camera_id", "track_id", "frame_idx", "t", "cx", "cy", "w", "h", "x1", "x2",
                                F.timestamp_seconds(F.lit(S.EPOCH_2024) + F.col("t")).alias("ts"))
    feed = runs.shuffled_stream(stage(o), "ts", late=9.0, beat="2 days")
    f = runs.drain(runs.feature_stream(feed, idle_sec=86_400))
    return f.select("camera_id", "track_id", "frame_idx", *[r6(c) for c in motion.FEATURES])


@query("alarm_stream", SQL_ALARMS)
def alarm_stream(spark, sf):
    """Alarm limiting as a stream; the same rows as `alarm_rate_limit`."""
    e = alarm_events(spark, sf).select("camera_id", "event_id", "t", "level", F.timestamp_seconds(F.lit(S.EPOCH_2024) + F.col("t")).alias("ts"))
    return runs.drain(runs.alarm_stream(runs.shuffled_stream(stage(e), "ts", late=9.0, beat="2 days")))


@query("episode_stream", f"""
WITH RECURSIVE {SQL_EPISODES}
SELECT s0.camera_id, s0.event_id, s0.type, s0.t AS start_t, CAST(end_t AS DOUBLE) AS end_t
FROM chain c JOIN s0 ON s0.camera_id = c.camera_id AND s0.rn = c.rn""")
def episode_stream(spark, sf):
    """Recordings as a stream, each put out when its time is over."""
    t = episodes.recordable(S.triggers(spark, sf)).select(
        "camera_id", "event_id", "type", "t", F.timestamp_seconds(F.lit(S.EPOCH_2024) + F.col("t")).alias("ts"))
    s = runs.keyed_fold(runs.shuffled_stream(stage(t), "ts", late=9.0, beat="2 days"), ["camera_id"], ["t", "event_id"], runs.episode_step,
                        runs.EPISODE, idle_sec=86_400, finish=runs.episode_finish, due=runs.episode_due(S.EPOCH_2024))
    return runs.drain(s).drop("seconds")


@query("retention_stream", f"""
WITH {places.SQL_OUTCOMES}
SELECT camera_id, event_id, first_check, uncertain, action FROM oc""")
def retention_stream(spark, sf):
    """Verify-then-retain: recordings and the feed as two streams, outer-joined in time; each is decided when its last check is over."""
    r = runs.shuffled_stream(stage(places.recordings(spark, sf)), "end_ts", late=300.0, beat="1 day")
    f = runs.shuffled_stream(stage(places.feed(spark, sf)), "seen_ts", late=300.0, beat="1 day")
    out = incidents.recording_outcomes(r.withWatermark("end_ts", runs.FEED_DELAY), f.withWatermark("seen_ts", runs.FEED_DELAY))
    return runs.drain(out).where("event_id IS NOT NULL").drop("end_ts")


@query("group_stream")
def group_stream(spark, sf):
    """Incident grouping as a stream keyed by area; which ids tie areas is known from the feed's list of incidents."""
    c = S.cameras(spark, sf)
    t = stage(places.reported(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(S.EPOCH_2024) + F.col("t"))))
    areas = stage(incidents.tied_areas(c, t.where("incident_id IS NOT NULL").select("camera_id", "incident_id").distinct()))
    feed = incidents.placed(runs.shuffled_stream(t, "ts", late=9.0, beat="2 days"), c, areas)
    out = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("group_id", T.LongType())])
    return runs.drain(runs.keyed_fold(feed, ["area"], ["t", "event_id"], incidents.group_step, out, idle_sec=86_400))


def _feed(rows, t: str = "t", epoch: float = S.EPOCH_2024, late: float = 9.0, beat: str = "4 days"):
    return runs.shuffled_stream(stage(rows.withColumn("ts", F.timestamp_seconds(F.lit(epoch) + F.col(t)))), "ts", late=late, beat=beat)


@query("health_stream", SQL_HEALTH)
def health_stream(spark, sf):
    """Failure runs and disabled streams as a stream; the same rows as `stream_health`."""
    return runs.drain(live.health_stream(_feed(failures(spark, sf)), FAIL_LIMIT, epoch=S.EPOCH_2024))


@query("promotion_stream", places.SQL_PROMOTED)
def promotion_stream(spark, sf):
    """Promotions and demotions as a stream of holds; the same rows as `promotion_intervals`."""
    return runs.drain(live.promotion_stream(_feed(places.holds(spark, sf), "start_t", 0.0, late=300.0)))


@query("line_count_stream", SQL_DIRECTIONS)
def line_count_stream(spark, sf):
    """Line counts flushed once a period as a stream; the same rows as `traffic_by_direction`."""
    o = S.obs(spark, sf).select("camera_id", "track_id", "frame_idx", "t", "cy", "cls")
    return runs.drain(live.line_counts(_feed(o), 648.0, (324.0, 918.0), up="up", down="down", epoch=S.EPOCH_2024))
