"""Blocks, folds and spatial joins against brute force, with blocks small enough to be crossed."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarmac.operators import clips, ensemble, episodes, flow, folds, incidents, motion, rules, signals, triggers
from tarmac.operators import sequence as seq
from tarmac.operators.geojoin import nearest, radius_join
from tarmac.operators.quantiles import percentiles
from tarmac.operators.smoothing import ema
from tarmac.sources import samples as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def close(a, b):
    return len(a) == len(b) and all(
        x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9)
        for r, s in zip(a, b) for x, y in zip(r, s))


def test_one_hot_key_is_cut_into_blocks(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") % 97).alias("v"))
    b = seq.blocks(df, ["k"], ["id"], F.floor(F.col("id") / 300), size=100, halo=3)
    w = seq.block_window(["k"])
    out = seq.body(b.withColumn("p", F.lag("v", 3).over(w)))
    assert out.where((F.col("id") >= 3) & (F.col("p") != (F.col("id") - 3) % 97)).count() == 0
    assert out.count() == 5000
    assert b.groupBy("_blk").count().agg(F.max("count")).first()[0] <= 103


def test_motion_does_not_depend_on_block_size_or_row_order(spark, small):
    o = S.obs(spark, small).cache()
    big, tiny = motion.motion(o), motion.motion(o.orderBy(F.rand(3)), size=7)
    cols = ["camera_id", "track_id", "frame_idx", "speed_kmh", "acceleration", "heading", "heading_change",
            "lateral_speed", "stop_duration", "area_change_rate"]
    assert close(rows(big.select(cols)), rows(tiny.select(cols)))


def test_rules_and_signals_do_not_depend_on_block_size(spark, small):
    o = S.obs(spark, small).cache()
    f = motion.features(o).cache()
    cols = ["camera_id", "frame_idx", "rule_id", "score", "involved_tracks"]
    assert close(rows(rules.violations(f).select(cols)), rows(rules.violations(f, size=9).select(cols)))
    for fn, size in ((lambda n: signals.runs_below(o, "speed", 5.0, n), 3),
                     (lambda n: signals.speed_variance(o, history=20, size=n), 25)):
        assert close(rows(fn(16_384)), rows(fn(size)))


def test_cluster_braking_equals_brute_force(spark, small):
    f = motion.features(S.obs(spark, small))
    rule = {**rules.RULES[8], "threshold": 0.0}
    got = {(r.camera_id, r.frame_idx, tuple(r.involved_tracks))
           for r in rules.cluster_violations(f, rule, 8).collect()}
    ma = seq.body(motion.moving_average(f, ["acceleration"])).where("acceleration_ma <= 0").toPandas()
    want = set()
    for (c, fr), g in ma.groupby(["camera_id", "frame_idx"]):
        left = [(r.track_id, r.cx, r.cy) for r in g.sort_values("track_id").itertuples()]
        while left:
            seed = left[0]
            near = [x for x in left if ((x[1] - seed[1]) ** 2 + (x[2] - seed[2]) ** 2) ** 0.5 <= 200]
            left = [x for x in left if x not in near]
            if len(near) >= 3:
                want.add((c, fr, tuple(x[0] for x in near)))
    assert got == want


def brute_cooldown(ts, sec):
    out, last = [], None
    for t in ts:
        if last is None or t - last >= sec:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_cooldown_in_blocks(spark, size):
    rnd = random.Random(size)
    ts = sorted(rnd.uniform(0, 4000) for _ in range(400))
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "camera_id long, event_id long, t double")
    got = [r.t for r in episodes.cooldown(df, ["camera_id"], 60.0, size=size).orderBy("t").collect()]
    assert got == brute_cooldown(ts, 60.0)


def test_cooldown_and_recording_fixtures(spark):
    df = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 30, 60, 119, 120])],
                               "camera_id long, event_id long, t double")
    assert [r.t for r in episodes.cooldown(df, ["camera_id"]).orderBy("t").collect()] == [0.0, 60.0, 120.0]
    tr = spark.createDataFrame(
        [(1, i, float(t), "T5", 0.9) for i, t in enumerate([0, 100, 150, 170, 500, 899, 901])],
        "camera_id long, event_id long, t double, type string, severity double")
    got = [(r.start_t, r.end_t) for r in episodes.recording_episodes(tr, size=2).orderBy("start_t").collect()]
    assert got == [(0.0, 300.0), (901.0, 1081.0)]


def test_consensus_fixture(spark):
    def accepted(items):
        df = spark.createDataFrame([(1, i, t, k, 0.9) for i, (k, t) in enumerate(items)],
                                   "camera_id long, event_id long, t double, type string, severity double")
        return [r.accepted for r in episodes.consensus(df).orderBy("event_id").collect()]

    assert accepted([("T1", 0.0), ("T2", 5.0)]) == [False, False]
    assert accepted([("T1", 0.0), ("T2", 4.9)]) == [False, True]
    assert accepted([("T5", 0.0)]) == [True]


@pytest.mark.parametrize("size", [4, 10_000])
def test_alarm_limit_equals_brute_force(spark, size):
    rnd = random.Random(5)
    ts = sorted(round(rnd.uniform(0, 40_000), 3) for _ in range(300)) + [90_000.0]
    df = spark.createDataFrame([(1, i, t, "ALARM") for i, t in enumerate(ts)],
                               "camera_id long, event_id long, t double, level string")
    got = [r.level for r in ensemble.limit_alarms(df, F.floor(F.col("t") / 86_400), size=size)
           .orderBy("event_id").collect()]
    kept, want = [], []
    for t in ts:
        ok = sum(1 for x in kept if x > t - 3600) < 10
        want.append("ALARM" if ok else "ALERT")
        if ok:
            kept.append(t)
    assert got == want


def test_trigger_fold_in_blocks(spark, small):
    m = motion.motion(S.obs(spark, small))
    f = triggers.signals(m, motion.pair_ttc(m.where(~F.col("cls").isin("person", "pedestrian")))).cache()
    assert rows(triggers.detect(f, 9).drop("involved_tracks")) == rows(triggers.detect(f).drop("involved_tracks"))


def test_grouping_in_blocks(spark, small):
    c = S.cameras(spark, small)
    n = c.count()
    t = S.triggers(spark, small).select("event_id", "t", (F.col("event_id") % n).alias("camera_id"), F.when(
        F.col("k") % 4 == 0, F.expr("event_id div 50")).alias("incident_id"))
    whole = rows(incidents.group_triggers(t, c))
    assert whole == rows(incidents.group_triggers(t, c, size=400))
    assert len(whole) == t.count()


def test_radius_and_nearest_equal_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(-70, 70), rnd.uniform(-179, 179)) for i in range(60)]
    near = [(i + 1000, 37 + rnd.uniform(-1, 1), 127 + rnd.uniform(-1, 1)) for i in range(60)]
    site = [(i, 37 + rnd.uniform(-1.5, 1.5), 127 + rnd.uniform(-1.5, 1.5)) for i in range(150)] + \
           [(i + 500, rnd.uniform(-80, 80), rnd.uniform(-179, 179)) for i in range(40)]
    p = spark.createDataFrame(pts + near, "id long, lat double, lon double")
    s = spark.createDataFrame(site, "cctv_id long, site_lat double, site_lon double")

    def km(lat1, lon1, lat2, lon2):
        a, b, dx = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(dx / 2) ** 2))

    want = {(a[0], b[0]) for a in pts + near for b in site if km(a[1], a[2], b[1], b[2]) <= 30}
    assert {(r.id, r.cctv_id) for r in radius_join(p, s, 30.0).collect()} == want
    got = {(r.lat, r.lon, r["rank"]): r.cctv_id for r in nearest(p, s, 4).collect()}
    for a in pts + near:
        best = sorted(site, key=lambda b: (km(a[1], a[2], b[1], b[2]), b[0]))[:4]
        assert [got[(a[1], a[2], i + 1)] for i in range(4)] == [b[0] for b in best]


def test_percentiles_and_ema(spark):
    rnd = random.Random(2)
    vals = [rnd.choice([1.0, 1.0, rnd.uniform(0, 1e6)]) for _ in range(999)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k long, i long, v double")
    got = percentiles(df, ["k"], {"v": [(0.5, "m"), (0.95, "p")]}).first()
    s = pd.Series(vals)
    assert abs(got.m - s.quantile(0.5)) < 1e-6 and abs(got.p - s.quantile(0.95)) < 1e-6
    out = ema(df, ["k"], ["i"], F.floor(F.col("i") / 100), "v", 0.45, "e").orderBy("i").collect()
    e = vals[0]
    for r, v in zip(out[1:], vals[1:]):
        e = 0.45 * v + 0.55 * e
        assert abs(r.e - e) <= 1e-9 * max(1, abs(e))


def test_flow_fixture(spark):
    df = spark.createDataFrame(
        [("A", "2024-01-01 00:00:01", 1, 60.0, "T1"), ("A", "2024-01-01 00:00:02", 1, 90.0, "T1"),
         ("A", "2024-01-01 00:00:03", 2, 80.0, "T4"), ("A", "2024-01-01 00:00:04", 3, None, "T13"),
         ("B", "2024-01-01 00:00:04", 1, None, "T1")],
        "ic_name string, ts string, track_id long, speed double, vehicle_cls string").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    got = {r.ic_name: (r.volume, r.avg_speed, r.speed_std, round(r.truck_ratio, 4))
           for r in flow.traffic_flow(df).collect()}
    assert got == {"A": (3, 70.0, 10.0, 0.3333), "B": (1, 0.0, 0.0, 0.0)}


def test_lateral_axis_tie_and_close_pairs(spark):
    t = spark.createDataFrame([(1, 1, i, i * 0.1, i * 0.1) for i in range(5)],
                              "clip_id long, track_id long, frame long, x double, y double")
    k = clips.kinematics(t).first()
    assert k.min_inter_dist == 1.0 and k.close_pair_frac == 0.0
    assert clips.lateral_axis(clips.steps(t)).first().lat_axis == 1
    rnd = random.Random(4)
    many = spark.createDataFrame([(1, i, 0, rnd.random(), rnd.random()) for i in range(60)],
                                 "clip_id long, track_id long, frame long, x double, y double")
    a = clips.closest_in_frame(many, ["clip_id", "frame"]).first().d
    p = [(r.x, r.y) for r in many.collect()]
    assert abs(a - min(math.dist(u, v) for i, u in enumerate(p) for v in p[:i])) < 1e-12
    same = many.union(many.limit(1).withColumn("track_id", F.lit(99).cast("long")))
    assert clips.closest_in_frame(same, ["clip_id", "frame"]).first().d == 0
    assert clips.closest_in_frame(many.limit(1), ["clip_id", "frame"]).count() == 0


def test_folds_summary_is_exact():
    import numpy as np

    ready = np.array([0.0, 5.0, 61.0, 70.0, 130.0])
    thr, ext = folds._summarise(ready, ready + 60, 60.0)
    assert thr and ext[0] == 190.0
