"""Verification against the feed as it was: as-of polls, re-checks, and the same as a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tarmac.operators import asof, incidents
from tarmac.streaming import runs

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
CAM = "cctv_id long, lat double, lon double"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_last_before_equals_brute_force(spark):
    rnd = random.Random(2)
    left = [(i, rnd.choice("ab"), rnd.uniform(0, 9000)) for i in range(300)] + [(900, "c", 5.0), (901, "a", -7.0)]
    right = [(rnd.choice("ab"), rnd.uniform(0, 9000), rnd.randrange(99)) for _ in range(60)] + [("a", 100.0, 1), ("a", 100.0, 2)]
    lf = spark.createDataFrame([(i, k, at(s)) for i, k, s in left] + [(902, "a", None)], "id long, k string, ts timestamp")
    rf = spark.createDataFrame([(k, at(s), v) for k, s, v in right] + [("a", None, 7)], "k string, rts timestamp, v long")
    for keys, width in ((["k"], 60.0), (["k"], 100_000.0), ([], 500.0)):
        r = rf if keys else rf.drop("k")
        got = {x.id: (x.rts and x.rts.timestamp(), x.v) for x in asof.last_before(lf, r, "ts", "rts", ["v"], keys, width).collect()}
        assert len(got) == len(left) + 1 and got[902] == (None, None)
        for i, k, s in left:
            old = [(round(at(x).timestamp(), 6), v) for q, x, v in right if (not keys or q == k) and at(x) <= at(s)]
            want = max(old, default=(None, None))
            assert got[i] == want, (keys, width, i)


def test_a_later_incident_confirms_nothing(spark):
    cams = spark.createDataFrame([(1, 37.0, 127.0), (2, 35.0, 128.0)], CAM)
    polls = spark.createDataFrame([(at(0), True), (at(100), True), (at(200), False), (at(300), True)], "poll_ts timestamp, feed_ok boolean")
    inc = spark.createDataFrame([(7, 37.01, 127.0, 2, at(90), at(1000)), (6, 37.02, 127.0, 1, at(250), at(1000))],
                                "event_id long, lat double, lon double, feed_pos long, listed_from timestamp, listed_until timestamp")
    t = spark.createDataFrame([(k, c, at(s)) for k, (c, s) in enumerate([(1, -5), (1, 50), (1, 150), (1, 250), (1, 350), (2, 350), (9, 350)])], "event_id long, camera_id long, ts timestamp")
    got = {r.event_id: (r.outcome, r.incident_id) for r in incidents.verify(t, cams, polls, inc).collect()}
    assert got == {0: ("uncertain", None), 1: ("not_confirmed", None), 2: ("confirmed", 7), 3: ("uncertain", None), 4: ("confirmed", 6),
                   5: ("not_confirmed", None), 6: ("not_confirmed", None)}


def cases(spark):
    cams = spark.createDataFrame([(1, 37.0, 127.0), (2, 35.0, 128.0)], CAM)
    rnd = random.Random(8)
    polls, s = [], 0.0
    while s < 200_000:
        s += rnd.choice((300, 700, 2500))
        polls.append((s, rnd.random() < 0.8))
    inc = [(i, *((37.0, 127.0) if i % 2 else (35.0, 128.0)), i, a := rnd.uniform(0, 200_000), a + rnd.uniform(10, 9000)) for i in range(40)]
    recs = [(1 + i % 2, i, rnd.choice((0.1, 0.75, 0.9)), rnd.uniform(0, 200_000)) for i in range(200)]
    want = {}
    for c, i, sev, end in recs:
        checks = []
        for k in range(4):
            t = end + 60 + 600 * k
            p = max((p for p in polls if t - 1800 <= p[0] <= t), default=None)
            ok = bool(p and p[1])
            checks.append((ok, ok and any(x[0] % 2 == c % 2 and x[4] <= p[0] < x[5] for x in inc)))
        unsure, hits = not checks[0][0], [k for k in range(4) if checks[k][1]]
        pending = sev >= 0.7 or unsure
        want[i] = "confirmed" if hits[:1] == [0] or (pending and hits) else "pending_preserved" if pending and (sev >= 0.8 or unsure) else "deleted"
    p = spark.createDataFrame([(at(s), ok) for s, ok in polls], "poll_ts timestamp, feed_ok boolean")
    i = spark.createDataFrame([(*x[:4], at(x[4]), at(x[5])) for x in inc], "event_id long, lat double, lon double, feed_pos long, listed_from timestamp, listed_until timestamp")
    r = spark.createDataFrame([(c, i, sev, at(end)) for c, i, sev, end in recs], "camera_id long, event_id long, severity double, end_ts timestamp")
    return r, incidents.feed_rows(p, incidents.listed_near(i, cams)), want


def test_outcomes_in_batch_and_as_a_stream(spark):
    r, feed, want = cases(spark)
    got = {x.event_id: x.action for x in incidents.recording_outcomes(r, feed).collect()}
    assert got == want and set(want.values()) == {"confirmed", "pending_preserved", "deleted"}
    rs = runs.shuffled_stream(r, "end_ts", late=300.0, beat="1 day")
    fs = runs.shuffled_stream(feed, "seen_ts", late=300.0, beat="1 day")
    out = runs.drain(incidents.recording_outcomes(rs.withWatermark("end_ts", "10 minutes"), fs.withWatermark("seen_ts", "10 minutes")))
    assert {x.event_id: x.action for x in out.where(F.col("event_id").isNotNull()).collect()} == want
