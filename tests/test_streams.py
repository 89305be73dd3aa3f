"""Streams whose rows come late, in other micro-batches, give what their tables give."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import motion
from tarmac.plans import catalogue
from tarmac.streaming import live, runs

T0 = 1_704_067_200


def at(s):
    return dt.datetime.fromtimestamp(T0 + s, dt.timezone.utc)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    x, y = (sorted(map(repr, d.select(cols).collect())) for d in (a, b))
    assert x == y and x


def test_trigger_stream_equals_batch(spark, small):
    same(catalogue.QUERIES["trigger_stream"](spark, small), catalogue.QUERIES["trigger_detector"](spark, small))


def test_group_stream_equals_batch(spark, small):
    same(catalogue.QUERIES["group_stream"](spark, small), catalogue.QUERIES["incident_groups"](spark, small))


@pytest.mark.parametrize("late", [0.0, 9.0])
def test_features_of_a_shuffled_feed(spark, late):
    rnd = random.Random(4)
    rows, place = [], {}
    for f in range(400):
        for i in range(6):
            if rnd.random() < 0.8:
                p = place.setdefault(i, [rnd.uniform(0, 900), rnd.uniform(0, 600)])
                p[0] += rnd.choice((0.0, 0.1, rnd.uniform(-9, 9)))
                p[1] += rnd.choice((0.0, 0.1, rnd.uniform(-9, 9)))
                rows.append((1 + f % 2, i, f, float(f), *p, 30.0 + i, 20.0 + f % 3, p[0] - 15, p[0] + 15 + i, at(f)))
    names = "camera_id long, track_id long, frame_idx long, t double, cx double, cy double, w double, h double, x1 double, x2 double, ts timestamp"
    o = spark.createDataFrame(rows, names)
    got = runs.drain(runs.feature_stream(runs.shuffled_stream(o, "ts", parts=5, late=late, beat="2 days"), idle_sec=86_400))
    want = motion.features(o)
    key = lambda r: (r.camera_id, r.track_id, r.frame_idx)
    a, b = ({key(r): r for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and len(a) == len(rows)
    for k, r in a.items():
        off = {c: (r[c], b[k][c]) for c in motion.FEATURES if abs(r[c] - b[k][c]) > 1e-6 * max(1, abs(r[c]))}
        assert not off, (k, off)


def test_tracks_are_forgotten(spark):
    rows = [(1, i, int(t), float(t), 5.0 * t, 1.0, 9.0, 9.0, 0.0, 9.0, at(t)) for i, ts in ((1, (0, 1, 2, 500, 501)), (2, range(0, 502, 20))) for t in ts]
    names = "camera_id long, track_id long, frame_idx long, t double, cx double, cy double, w double, h double, x1 double, x2 double, ts timestamp"
    feed = runs.shuffled_stream(spark.createDataFrame(rows, names), "ts", parts=25, beat="2 days", files=1)
    got = {(r.track_id, r.frame_idx): r.track_age for r in runs.drain(runs.feature_stream(feed, idle_sec=100)).collect()}
    assert got[1, 2] == 3 and got[1, 500] == 1 and got[1, 501] == 2 and got[2, 500] == 26


def test_alarm_limit_of_a_shuffled_feed(spark):
    rnd = random.Random(5)
    rows = [(c, 1000 * c + k, t, rnd.choice(["ALARM", "ALARM", "ALERT"]), at(t)) for c in (1, 2) for k, t in enumerate(sorted(rnd.uniform(0, 30_000) for _ in range(200)))]
    feed = runs.shuffled_stream(spark.createDataFrame(rows, "camera_id long, event_id long, t double, level string, ts timestamp"), "ts", parts=6, late=9.0, beat="2 days")
    got = {r.event_id: r.level for r in runs.drain(runs.alarm_stream(feed)).collect()}
    kept, want = {1: [], 2: []}, {}
    for c, e, t, level, _ in sorted(rows, key=lambda r: r[2]):
        if level == "ALARM":
            if sum(x > t - 3600 for x in kept[c]) < 10:
                kept[c].append(t)
            else:
                level = "ALERT"
        want[e] = level
    assert got == want


def test_health_of_a_shuffled_feed(spark):
    rnd = random.Random(6)
    rows = []
    for cam in (1, 2, 3):
        t = 0.0
        for k in range(150):
            t += rnd.choice((0.0, 1.0, 40.0, 700.0))
            rows.append((cam, 1000 * cam + k, t, rnd.choice((True, True, False, None)), at(t)))
    h = spark.createDataFrame(rows, "camera_id long, event_id long, t double, failed boolean, ts timestamp")
    feed = runs.shuffled_stream(h, "ts", parts=6, late=9.0, beat="4 days")
    got = sorted(tuple(r) for r in runs.drain(live.health_stream(feed, limit=4, epoch=T0)).collect())
    want = []
    for cam in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == cam), key=lambda r: (r[2], r[1]))
        for failed, run in itertools.groupby(enumerate(own, 1), lambda x: bool(x[1][3])):
            run = list(run)
            if failed:
                off = run[3][1][2] if len(run) >= 4 else None
                want.append((cam, run[0][0], len(run), run[0][1][2], off, off is not None, None if off is None else off + 1800))
    assert got == sorted(want) and any(w[5] for w in want)


def test_a_silent_stream_ends_its_run(spark):
    rows = [(1, i, t, True, at(t)) for i, t in enumerate((0.0, 10.0, 900.0))]
    h = spark.createDataFrame(rows, "camera_id long, event_id long, t double, failed boolean, ts timestamp")
    got = runs.drain(live.health_stream(runs.shuffled_stream(h, "ts", parts=3, beat="4 days", files=1), limit=2, quiet_sec=300, epoch=T0)).collect()
    assert sorted((r.failures, r.first_t, r.disabled) for r in got) == [(1, 900.0, False), (2, 0.0, True)]


def test_promotions_of_a_shuffled_feed(spark):
    rnd = random.Random(8)
    rows = [(c, k, T0 + (s := rnd.randrange(40_000)), T0 + s + rnd.choice((60, 600)), at(s)) for c in (1, 2) for k in range(80)]
    rows += [(3, 1, T0 + 100, T0 + 700, at(100)), (3, 2, T0 + 700, T0 + 800, at(700)), (3, 3, T0 + 801, T0 + 900, at(801))]
    h = spark.createDataFrame(rows, "cctv_id long, event_id long, start_t long, end_t long, ts timestamp")
    got = sorted(tuple(r) for r in runs.drain(live.promotion_stream(runs.shuffled_stream(h, "ts", parts=6, late=300.0, beat="4 days"))).collect())
    want = []
    for c, _, s, e, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if want and want[-1][0] == c and s <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((c, s, e, 1))
    assert got == sorted(want) and len(want) > 20


def test_line_counts_keep_counted_tracks_over_flushes(spark):
    ys = {1: [0, 20, 0, 20, 0, 20, 0, 20], 2: [20, 20, 20, 20, 0, 0, 0, 0], 3: [0, 0, 0, 0, 0, 0, 0, 20], 4: [5, 5]}
    kinds = {1: ["T2", "T1", "T1"], 2: ["T3"], 3: [None, "person"], 4: ["T1"]}
    rows = [(1, i, f, float(f), float(y), kinds[i][f % len(kinds[i])], at(f)) for i, own in ys.items() for f, y in enumerate(own)]
    o = spark.createDataFrame(rows, "camera_id long, track_id long, frame_idx long, t double, cy double, cls string, ts timestamp")
    got = runs.drain(live.line_counts(runs.shuffled_stream(o, "ts", parts=4, late=3.0, beat="4 days", files=1), 10.0, frames=3, up="up", down="down", epoch=T0)).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, "down", 1, "버스=1"), (1, "up", 1, "화물차=1"), (2, "down", 1, "미분류=1")]
