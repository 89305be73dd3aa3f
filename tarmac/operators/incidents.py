"""Official incidents against cameras: matching, verification, grouping, promotion, retention."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators import asof, folds
from tarmac.operators import sequence as seq
from tarmac.operators.geojoin import nearest, radius_join
from tarmac.operators.linked import components
from tarmac.operators.textjoin import contains_join
from tarmac.session import stage

# fixed values: radii, holds and retention limits
MATCH_KM, VERIFY_KM, GROUP_KM = 5.0, 10.0, 5.0
GROUP_SEC, HOLD_SEC = 180.0, 600.0
SEVERITY_PENDING, SEVERITY_KEEP, RECHECKS = 0.7, 0.8, 3
RECHECK_SEC, VERIFY_DELAY = 600.0, 60.0
FEED_FRESH, FEED_SLOT = 1800.0, 600  # how old a poll may be to count; the slots by which streams are settled
REACT_CAMERAS = 3
PATROL_PER_INCIDENT, PATROL_PER_CYCLE = 2, 20


def sites(cameras: DataFrame, *extra: str) -> DataFrame:
    return cameras.select("cctv_id", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"),
                          *extra)


def camera_matches(incidents: DataFrame, cameras: DataFrame, km: float = MATCH_KM) -> DataFrame:
    return radius_join(incidents, sites(cameras), km)


def nearest_cameras(incidents: DataFrame, cameras: DataFrame, k: int) -> DataFrame:
    """k nearest cameras per incident; distinct places are searched once and joined back."""
    near = nearest(incidents, sites(cameras), k)
    return incidents.join(near, ["lat", "lon"])


def monitored_cameras(incidents: DataFrame, cameras: DataFrame, loaded: DataFrame,
                      k: int = REACT_CAMERAS) -> DataFrame:
    """Of the 3k nearest cameras those being monitored, then the first k of them."""
    near = nearest(incidents, sites(cameras), 3 * k).join(
        loaded.select("cctv_id").distinct(), "cctv_id", "left_semi")
    w = Window.partitionBy("lat", "lon").orderBy("rank")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return incidents.join(near, ["lat", "lon"])


def choose_camera(requests: DataFrame, cameras: DataFrame) -> DataFrame:
    """Explicit id if known, else nearest to the given point, else the first camera with a stream."""
    first = cameras.where("stream_url is not null").agg(F.min("cctv_id").alias("_first"))
    known = cameras.select(F.col("cctv_id").alias("_known"))
    near = nearest(requests, sites(cameras), 1).select("lat", "lon", F.col("cctv_id").alias("_near"))
    r = requests.join(known, requests.wanted_id == F.col("_known"), "left").join(
        near, ["lat", "lon"], "left")
    return r.join(F.broadcast(first)).withColumn(
        "cctv_id", F.coalesce("_known", "_near", "_first")).drop("_known", "_near", "_first")


def listed_near(incidents: DataFrame, cameras: DataFrame, km: float = VERIFY_KM) -> DataFrame:
    """camera_id, incident_id, feed_pos, match_km, listed_from, listed_until: what the feed lists near each camera, and when.

    Places, not rows, are joined in space; incidents then meet the cameras of their place.
    """
    place = radius_join(incidents.select("lat", "lon").distinct(), sites(cameras), km).select(
        "lat", "lon", F.col("cctv_id").alias("camera_id"), F.col("distance_km").alias("match_km"))
    return incidents.join(place, ["lat", "lon"]).select(
        "camera_id", F.col("event_id").alias("incident_id"), "feed_pos", "match_km", "listed_from", "listed_until")


def first_listed(checks: DataFrame, listed: DataFrame, width: float = 21_600.0) -> DataFrame:
    """(camera_id, poll_ts) of `checks` with the first incident in feed order that was listed near the camera at that poll.

    An interval is filed under the time slots it touches, so the join is an equi-join on camera and slot.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / int(width * 1e6))
    filed = listed.where("listed_from < listed_until").withColumn("_slot", F.explode(F.sequence(slot("listed_from"), slot("listed_until"))))
    met = checks.select("camera_id", "poll_ts").distinct().withColumn("_slot", slot("poll_ts")).join(filed, ["camera_id", "_slot"])
    met = met.where((F.col("listed_from") <= F.col("poll_ts")) & (F.col("poll_ts") < F.col("listed_until")))
    return met.groupBy("camera_id", "poll_ts").agg(
        F.min_by(F.struct("incident_id", "match_km"), F.struct("feed_pos", "incident_id")).alias("_m")).select("camera_id", "poll_ts", "_m.*")


def verify(triggers: DataFrame, cameras: DataFrame, polls: DataFrame, incidents: DataFrame,
           ts: str = "ts", km: float = VERIFY_KM, width: float = 3600.0) -> DataFrame:
    """confirmed / not_confirmed / uncertain for each trigger, by the feed's poll that was current at its time.

    `polls` have poll_ts and feed_ok, `incidents` event_id, lat, lon, feed_pos and the time they were listed,
    [listed_from, listed_until). A trigger before any poll, or whose poll failed, is uncertain: that never means
    "no incident". What a later poll lists confirms nothing. Adds poll_ts, outcome, incident_id, match_km.
    """
    t = asof.last_before(triggers, polls, ts, "poll_ts", ["feed_ok"], width=width)
    ok = F.coalesce(F.col("feed_ok"), F.lit(False))
    cameras = watched(cameras, triggers)
    found = first_listed(t.where(ok), listed_near(incidents, cameras, km))
    out = t.join(found, ["camera_id", "poll_ts"], "left")
    return out.withColumn("outcome", F.when(~ok, "uncertain").when(F.col("incident_id").isNotNull(), "confirmed").otherwise("not_confirmed")).drop("feed_ok")


def watched(cameras: DataFrame, rows: DataFrame) -> DataFrame:
    """The cameras that `rows` have rows of: what is near the others can't matter to them."""
    return cameras.join(rows.select(F.col("camera_id").alias("cctv_id")).distinct(), "cctv_id", "left_semi")


def feed_rows(polls: DataFrame, listed: DataFrame, slot_sec: int = FEED_SLOT) -> DataFrame:
    """The feed as rows for recordings to meet: key, seen_ts, feed_ok, hit.

    Each poll gives a row under its time slot ("feed" rows); each incident listed near a camera one under the camera
    for every successful poll that lists it.
    """
    polls = polls.groupBy("poll_ts").agg(F.bool_or("feed_ok").alias("feed_ok"))  # one row for each time
    status = polls.select(_slot_key(F.unix_seconds("poll_ts"), slot_sec).alias("key"), F.col("poll_ts").alias("seen_ts"), "feed_ok", F.lit(False).alias("hit"))
    width = 21_600
    slot = lambda c: F.floor(F.unix_seconds(c) / width)
    filed = listed.where("listed_from < listed_until").withColumn("_slot", F.explode(F.sequence(slot("listed_from"), slot("listed_until"))))
    seen = polls.where("feed_ok").withColumn("_slot", slot("poll_ts")).join(filed, "_slot").where("listed_from <= poll_ts AND poll_ts < listed_until")
    seen = seen.select(F.concat(F.lit("camera:"), "camera_id").alias("key"), F.col("poll_ts").alias("seen_ts"), F.lit(True).alias("feed_ok"), F.lit(True).alias("hit"))
    return status.union(seen.distinct())


def _slot_key(seconds: Column, slot_sec: int) -> Column:
    return F.concat(F.lit("feed:"), F.floor(seconds / slot_sec))


def recording_outcomes(recordings: DataFrame, feed: DataFrame, fresh: float = FEED_FRESH, delay: float = VERIFY_DELAY, every: float = RECHECK_SEC,
                       slot_sec: int = FEED_SLOT) -> DataFrame:
    """action (confirmed / pending_preserved / deleted) of each recording; the same for tables and for streams.

    `recordings` have camera_id, event_id, severity and end_ts; `feed` is made by `feed_rows`. A recording is checked
    `delay` after its end and, while pending, RECHECKS times more, `every` seconds apart. The poll of a check is the latest
    at most `fresh` seconds old; without one, or if it failed, the check is uncertain. As streams, both sides need a
    watermark; a recording comes out when the watermarks have passed its last check, with or without a match.
    """
    if not recordings.isStreaming:
        per = _checked(recordings, feed, fresh, delay, every)
    else:
        per = _checked_as_streams(recordings, feed, fresh, delay, every, slot_sec)
    first = F.col("first")
    return per.select("camera_id", "event_id", "end_ts", F.coalesce(first, F.lit(-1)).alias("first_check"), "uncertain",
                      retention(F.col("severity"), first, F.col("uncertain")).alias("action"))


def _checked(recordings: DataFrame, feed: DataFrame, fresh: float, delay: float, every: float) -> DataFrame:
    """Each recording with `first`, the first check that saw an incident, and `uncertain`: an as-of join of checks and polls, then an equi-join with hits."""
    own = ["camera_id", "event_id", "severity", "end_ts"]
    span = lambda c: F.make_interval(secs=c)
    at = F.col("end_ts") + span(F.lit(delay) + F.col("_k") * F.lit(every))
    checks = recordings.select(*own, F.explode(F.sequence(F.lit(0), F.lit(RECHECKS))).alias("_k")).withColumn("_due", at)
    met = asof.last_before(checks, feed.where("NOT hit"), "_due", "seen_ts", ["feed_ok"])
    ok = F.coalesce(F.col("feed_ok") & (F.col("seen_ts") >= F.col("_due") - span(F.lit(fresh))), F.lit(False))
    hits = feed.where("hit").select(F.col("key").alias("_key"), F.col("seen_ts").alias("_hit")).distinct()
    met = met.join(hits, (F.concat(F.lit("camera:"), "camera_id") == F.col("_key")) & (F.col("seen_ts") == F.col("_hit")), "left")
    return met.groupBy(*own).agg(F.min(F.when(ok & F.col("_hit").isNotNull(), F.col("_k"))).alias("first"), (~F.bool_or((F.col("_k") == 0) & ok)).alias("uncertain"))


def _checked_as_streams(recordings: DataFrame, feed: DataFrame, fresh: float, delay: float, every: float, slot_sec: int) -> DataFrame:
    """`_checked` for streams: recordings are kept by slots of their end, the feed's rows go to the slots that can see them, and a slot
    is settled when its last check is over. A row travels once for each slot within reach, so pairs of recordings and polls are never built."""
    from tarmac.streaming import runs

    last = delay + RECHECKS * every
    slot = lambda c: F.floor(c / slot_sec)
    sec = lambda c: F.unix_micros(c) / 1e6
    text = lambda c: F.col(c).cast("string").alias(c)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    r = recordings.select(F.col("end_ts").alias("ts"), slot(sec("end_ts")).alias("slot"), F.concat(F.lit("camera:"), "camera_id").alias("key"), text("camera_id"),
                          text("event_id"), F.col("severity").cast("double").alias("severity"), none("boolean", "feed_ok"), none("boolean", "hit"))
    reach = F.sequence(slot(sec("seen_ts") - last), slot(sec("seen_ts") + (fresh - delay)))
    f = feed.select(F.col("seen_ts").alias("ts"), F.explode(reach).alias("slot"), "key", none("string", "camera_id"), none("string", "event_id"),
                    none("double", "severity"), "feed_ok", F.coalesce("hit", F.lit(False)).alias("hit"))

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        us = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        mine = rows["hit"].isna().to_numpy()
        hit = rows["hit"].fillna(False).to_numpy(bool)
        polls = pd.Series(rows["feed_ok"].fillna(False).to_numpy(bool)[~mine & ~hit]).groupby(us[~mine & ~hit]).max()
        times, good = polls.index.to_numpy(np.int64), polls.to_numpy(bool)
        hits = pd.MultiIndex.from_arrays([rows["key"].to_numpy()[hit], us[hit]])
        own = rows[mine].drop_duplicates(["camera_id", "event_id", "severity", "ts"])
        end = own["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        first, unsure = np.full(len(own), -1), np.ones(len(own), bool)
        for k in range(RECHECKS, -1, -1):
            due = end + int((delay + k * every) * 1e6)
            i = np.searchsorted(times, due, side="right") - 1
            ok = i >= 0
            ok[ok] = good[i[ok]] & (times[i[ok]] >= due[ok] - int(fresh * 1e6))
            at = np.where(ok, times[np.maximum(i, 0)] if len(times) else 0, -1)
            seen = ok & pd.MultiIndex.from_arrays([own["key"].to_numpy(), at]).isin(hits) if len(hits) else np.zeros(len(own), bool)
            first[seen], unsure = k, ~ok
        return pd.DataFrame({"camera_id": own["camera_id"], "event_id": own["event_id"], "severity": own["severity"], "end_ts": own["ts"], "first": first, "uncertain": unsure})

    done = runs.settled(r.union(f), "slot", settle, "camera_id string, event_id string, severity double, end_ts timestamp, first int, uncertain boolean",
                        lambda key: (int(key) + 1) * slot_sec + last)
    kinds = dict(recordings.dtypes)
    return done.select(F.col("camera_id").cast(kinds["camera_id"]).alias("camera_id"), F.col("event_id").cast(kinds["event_id"]).alias("event_id"), "severity",
                       "end_ts", F.when(F.col("first") >= 0, F.col("first")).alias("first"), "uncertain")


def retention(severity: Column, first_check: Column, uncertain: Column) -> Column:
    """What happens to a recording: `first_check` is the check (0 = right after the recording,
    1..3 = re-checks) at which an incident was first seen nearby, null if never."""
    pending = (severity >= SEVERITY_PENDING) | uncertain
    seen_late = first_check.between(1, RECHECKS)
    keep = (severity >= SEVERITY_KEEP) | uncertain
    return (
        F.when((first_check == 0) & ~uncertain, "confirmed")
        .when(pending & seen_late, "confirmed")
        .when(pending & keep, "pending_preserved").otherwise("deleted")
    )


def new_incidents(current: DataFrame, seen: DataFrame, key=("link_id", "occurred_at")) -> DataFrame:
    """Rows whose key was never seen, first in feed order per key."""
    key = list(key)
    fresh = current.join(seen.select(*key).distinct(), key, "left_anti")
    rest = [c for c in current.columns if c not in key]
    return fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), "feed_pos").alias("_r")).select(
        *key, "_r.*")


def hotspot_scores(hotspots: DataFrame, incidents: DataFrame, cameras: DataFrame,
                   km: float = 5.0, busy: int = 4) -> DataFrame:
    """50 per accident, 5 per incident, 2 per streaming camera, 10 more with four cameras.

    Input hotspots: name, site_lat, site_lon; incidents: lat, lon, is_accident; cameras: lat, lon,
    stream_url. Incidents are counted per place before the radius join.
    """
    place = incidents.groupBy("lat", "lon").agg(
        F.count("*").alias("n"), F.count_if("is_accident").alias("a"))
    ev = radius_join(place, hotspots, km).groupBy("name").agg(
        F.sum("n").alias("incidents"), F.sum("a").alias("accidents"))
    cam = radius_join(cameras.where("stream_url is not null").select("lat", "lon"), hotspots, km)
    cam = cam.groupBy("name").agg(F.count("*").alias("cameras"))
    h = hotspots.join(ev, "name", "left").join(cam, "name", "left").fillna(
        0, ["incidents", "accidents", "cameras"])
    score = (F.col("accidents") * 50 + F.col("incidents") * 5 + F.col("cameras") * 2
             + F.when(F.col("cameras") >= busy, 10).otherwise(0))
    return h.withColumn("score", score)


def hotspot_quota(total: Column, wanted: int, max_cameras: int) -> Column:
    """How many hotspot cameras to run when only `max_cameras` may run at all."""
    share = F.floor(F.lit(max_cameras) * F.least(F.lit(wanted) / total, F.lit(1.0)))
    limited = F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), share), F.lit(max_cameras - 1)))
    cut = F.lit(max_cameras > 0) & (F.lit(max_cameras) < total)
    return F.when(total == 0, F.lit(0)).when(cut, limited).otherwise(
        F.least(F.lit(wanted), total)).cast("long")


def patrol(candidates: DataFrame, cycle: str, per_incident: int = PATROL_PER_INCIDENT,
           per_cycle: int = PATROL_PER_CYCLE) -> DataFrame:
    """Camera visits of each patrol cycle: a few per incident, in feed order, up to the cycle cap."""
    c = candidates.where(F.col("rank") <= per_incident)
    w = Window.partitionBy(cycle).orderBy("feed_pos", "rank")
    return c.withColumn("visit", F.row_number().over(w)).where(F.col("visit") <= per_cycle)


def merge_holds(holds: DataFrame, keys, start: str, end: str, tie: str, chunk: Column,
                size: int = seq.BLOCK) -> DataFrame:
    """Union of overlapping or touching [start, end) holds per key."""
    r = folds.reset_runs(holds, keys, [start, tie], chunk, F.col(end), F.col(start), size)
    return r.groupBy(*keys, "_run").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("holds")).drop("_run")


def assign_cameras(hotspots: DataFrame, cameras: DataFrame, first: int = 8) -> DataFrame:
    """Each hotspot in order takes the nearest camera nobody took before.

    Deferred acceptance: every hotspot without a camera asks its next nearest, a camera keeps the
    earliest hotspot that has asked. As all cameras rank hotspots alike this ends in exactly what
    taking turns gives, in rounds over tables. A hotspot starts with its `first` nearest cameras;
    when all have turned it down the list of candidates doubles. Input hotspots: pos, name, lat, lon.
    """
    spots, total = stage(hotspots), cameras.select("cctv_id").distinct().count()

    def candidates(k):
        near = nearest(spots, sites(cameras), k).select("lat", "lon", "cctv_id", "distance_km", "rank")
        return stage(spots.join(near, ["lat", "lon"]).select("pos", "name", "cctv_id", "distance_km", "rank"))

    k = min(first, total)
    cand = candidates(k)
    asks = stage(spots.select("pos", F.lit(1).alias("rank")))  # the candidate each hotspot is at
    while True:
        if k < total and not asks.where(F.col("rank") > k).isEmpty():
            k = min(2 * k, total)
            cand = candidates(k)
        now = cand.join(asks, ["pos", "rank"])
        kept = now.groupBy("cctv_id").agg(F.min("pos").alias("kept"))
        lost = stage(now.join(kept, "cctv_id").where("pos <> kept").select("pos", F.lit(1).alias("step")))
        if lost.isEmpty() and (k == total or asks.where(F.col("rank") > k).isEmpty()):
            return now.select("pos", "name", "cctv_id", "distance_km")
        asks = stage(asks.join(lost, "pos", "left").select("pos", (F.col("rank") + F.coalesce("step", F.lit(0))).alias("rank")))


def camera_areas(cameras: DataFrame, km: float = GROUP_KM) -> DataFrame:
    """Cameras linked by chains of `km` steps share an area id (smallest camera id in it).

    Places, each named by its smallest camera, are joined in space; every camera is linked to its place.
    """
    c = cameras.select("cctv_id", "lat", "lon")
    known = c.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    places = stage(known.groupBy("lat", "lon").agg(F.min("cctv_id").alias("a")))
    near = radius_join(places, places.select(F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), F.col("a").alias("b")), km)
    own = known.join(places, ["lat", "lon"]).select("a", F.col("cctv_id").alias("b"))
    roots = components(near.where("a < b").select("a", "b").union(own))
    return c.select("cctv_id").distinct().join(roots, F.col("cctv_id") == F.col("node"), "left").select(
        "cctv_id", F.coalesce("root", "cctv_id").alias("area"))


_GROUPED = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("group_id", T.LongType())])


def group_step(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Put triggers, in time order, into incident groups named after their first trigger.

    A group is its leading trigger: candidates for a row are the leaders in reach in time and space,
    in the order they began, whose cameras don't include the row's. State: leaders as columns, the
    (leader, camera) pairs taken, and which leader an official id stands for.
    """
    lead = [tuple(x) for x in state.get("lead", [])]  # (event_id, t, lat, lon)
    taken, official = {tuple(x) for x in state.get("taken", [])}, dict(state.get("official", {}))
    spots, standing, reach = [], {}, {}  # places of leaders, the leaders at each (as numbers in `lead`), places in reach of a row's place

    def stand(k):
        at = lead[k][2:]
        if any(x != x for x in at):
            return  # no place: in nobody's reach
        if at not in standing:
            standing[at] = deque()
            spots.append(at)
        standing[at].append(k)

    def near(at):
        if any(x != x for x in at):
            return []
        seen, found = reach.get(at, (0, []))
        if seen < len(spots):
            p, q = np.radians(np.array(spots[seen:])), np.radians(at)
            half = np.sin((q[0] - p[:, 0]) / 2) ** 2 + np.cos(p[:, 0]) * np.cos(q[0]) * np.sin((q[1] - p[:, 1]) / 2) ** 2
            close = np.flatnonzero(2 * 6371.0 * np.arcsin(np.minimum(1.0, np.sqrt(half))) <= GROUP_KM)
            found = found + [standing[spots[seen + k]] for k in close]
            reach[at] = len(spots), found
        return found

    for k in range(len(lead)):
        stand(k)
    times, places = rows["t"].astype(float).tolist(), list(zip(rows["lat"].astype(float).tolist(), rows["lon"].astype(float).tolist()))
    cams, events = rows["camera_id"].astype("int64").tolist(), rows["event_id"].astype("int64").tolist()
    ids = [None if pd.isna(x) else str(int(x)) for x in rows["incident_id"]]
    group = []
    for t, at, cam, event, official_id in zip(times, places, cams, events, ids):
        mine = official.get(official_id) if official_id else None
        if mine is None:
            best = len(lead)
            for queue in near(at):
                while queue and t - lead[queue[0]][1] > GROUP_SEC:
                    queue.popleft()
                for k in queue:
                    if k >= best:
                        break
                    if t - lead[k][1] <= GROUP_SEC and (lead[k][0], cam) not in taken:
                        best = k
                        break
            if best == len(lead):
                lead.append((event, t, *at))
                stand(best)
                if official_id:
                    official[official_id] = event
            mine = lead[best][0]
        taken.add((mine, cam))
        group.append(mine)
    last = times[-1] if times else -np.inf
    alive = [x for x in lead if last - x[1] <= GROUP_SEC]
    keep = {x[0] for x in alive}
    return ({"lead": alive, "taken": sorted(x for x in taken if x[0] in keep), "official": official},
            pd.DataFrame({"event_id": events, "group_id": group}, dtype="int64"))


def tied_areas(cameras: DataFrame, ties: DataFrame) -> DataFrame:
    """camera_id, area of every camera of the catalogue or of `ties` (camera_id, incident_id): areas that share an official id are one.

    A camera the catalogue lacks is an area of its own.
    """
    own = cameras.select(F.col("cctv_id").alias("camera_id")).union(ties.select("camera_id")).distinct()
    areas = own.join(camera_areas(cameras).withColumnRenamed("cctv_id", "camera_id"), "camera_id", "left").withColumn(
        "area", F.coalesce("area", -1 - F.col("camera_id")))
    tied = ties.where("incident_id IS NOT NULL").select("camera_id", "incident_id").distinct().join(areas, "camera_id")
    merged = _merge_labels(tied.select("area", F.col("incident_id").alias("tie")))
    return areas.join(merged, "area", "left").select("camera_id", F.coalesce("root", "area").alias("area"))


def placed(triggers: DataFrame, cameras: DataFrame, areas: DataFrame) -> DataFrame:
    """Triggers with lat, lon and area; both sides of the joins are catalogues, so `triggers` may be a stream."""
    where = cameras.select(F.col("cctv_id").alias("camera_id"), "lat", "lon")
    return triggers.join(where, "camera_id", "left").join(areas, "camera_id", "left").withColumn(
        "area", F.coalesce("area", -1 - F.col("camera_id")))


def group_triggers(triggers: DataFrame, cameras: DataFrame,
                   size: int = folds.FOLD_BLOCK) -> DataFrame:
    """Triggers of several cameras joined into incidents.

    A trigger joins the group of its official incident id, else a group at most 180 s old whose
    first camera is within 5 km and which does not hold this camera yet, else starts one. Only
    triggers of one camera area interact, unless an official id ties areas together; areas sharing
    an id are merged. An area's history is split wherever every group has aged out and no id spans
    the gap. A camera the catalogue lacks is an area of its own, near nothing, tied to others by
    official ids only. Input: event_id, camera_id, t, incident_id (nullable).
    """
    ids = triggers.where("incident_id is not null")
    t = placed(triggers, cameras, stage(tied_areas(cameras, ids.select("camera_id", "incident_id").distinct())))
    t = t.join(ids.groupBy("incident_id").agg(F.max("t").alias("_last")), "incident_id", "left")
    ends = F.greatest(F.col("t"), F.coalesce("_last", "t")) + GROUP_SEC
    runs = folds.reset_runs(t, ["area"], ["t", "event_id"], F.floor(F.col("t") / 86_400), ends,
                            F.col("t"))
    slim = runs.select("area", "_run", "_g", "event_id", "camera_id", "t", "lat", "lon",
                       "incident_id")
    return folds.chained_fold(slim, ["area"], group_step, _GROUPED, size=size)


def _merge_labels(edges: DataFrame) -> DataFrame:
    """Smallest area reachable from each area through shared ties: every area of a tie is linked to the tie's smallest. Areas tied to no other are left out."""
    edges = stage(edges.distinct())
    low = edges.groupBy("tie").agg(F.min("area").alias("b"))
    roots = components(edges.join(low, "tie").select(F.col("area").alias("a"), "b"))
    return roots.select(F.col("node").alias("area"), "root")


def match_markers(cameras: DataFrame, markers: DataFrame, top: int = 5) -> DataFrame:
    """Map markers per camera by (name mismatch, route mismatch, squared degree distance).

    Text containment is resolved once per distinct camera name and route, then each class of
    markers - same name, same route, both, any - is searched for its nearest `top` in degrees. A
    marker of the final `top` is among those of its own class. Both sides need id, name, route, lat, lon.
    """
    def clean(c):
        return F.translate(c, "[] ", "")

    c = cameras.select(F.col("id").alias("camera_id"), clean("name").alias("cn"),
                       F.regexp_replace("route", " ", "").alias("cr"), "lat", "lon")
    m = markers.select(
        F.col("id").alias("marker_id"), clean("name").alias("mn"),
        F.regexp_replace(F.concat("name", "route"), " ", "").alias("mr"),
        F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    spot = m.select("marker_id", "site_lat", "site_lon")
    names = contains_join(m.select("marker_id", "mn"), "mn", c.select("cn"), "cn")
    routes = contains_join(m.select("marker_id", "mr"), "mr", c.select("cr"), "cr")
    names, routes = stage(names.select("marker_id", "cn")), stage(routes.select("marker_id", "cr"))
    by_name = names.select("marker_id", "cn").join(spot, "marker_id")
    by_route = routes.select("marker_id", "cr").join(spot, "marker_id")
    both = by_name.join(routes.select("marker_id", "cr"), "marker_id")
    keys = ["camera_id", "cn", "cr", "marker_id", "site_lat", "site_lon", "lat", "lon"]

    def closest(s, by):
        return c.join(nearest(c, s, top, "marker_id", by, planar=True), ["lat", "lon", *by]).select(*keys)

    cand = closest(spot, ()).unionByName(closest(by_name, ("cn",))).unionByName(
        closest(by_route, ("cr",))).unionByName(closest(both, ("cn", "cr"))).distinct()
    # looked up for the candidates alone: a route has many cameras and many markers
    nm, rm = names.withColumn("name_penalty", F.lit(0)), routes.withColumn("route_penalty", F.lit(0))
    out = cand.join(nm, ["marker_id", "cn"], "left").join(rm, ["marker_id", "cr"], "left").fillna(
        1, ["name_penalty", "route_penalty"])
    d2 = F.pow(F.col("site_lon") - F.col("lon"), F.lit(2)) + F.pow(
        F.col("site_lat") - F.col("lat"), F.lit(2))
    w = Window.partitionBy("camera_id").orderBy("name_penalty", "route_penalty", "dist2", "marker_id")
    return out.drop("cn", "cr").withColumn("dist2", d2).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= top)


def link_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue entries whose url changed."""
    n = new.where("url is not null and url <> ''").select("cctv_id", F.col("url").alias("new_url"))
    return old.join(n, "cctv_id").where(~F.col("url").eqNullSafe(F.col("new_url")))

