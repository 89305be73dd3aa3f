"""Matching, grouping and assignment against plain versions."""

import json
import math
import random

import pandas as pd

from tarmac.operators import incidents as I
from tarmac.operators import questions
from tarmac.operators.geojoin import nearest
from tarmac.operators.textjoin import contains_join


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def test_contains_join_has_no_limit_on_lengths(spark):
    needles = ["ab" * i + "x" for i in range(300)] + ["q", "xyz", "né"]
    texts = ["ab" * 250 + "x", "wxyz né", "", "q", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    n = spark.createDataFrame([(x,) for x in needles] + [(None,), ("",)], "n string")
    got = {(r.i, r.n) for r in contains_join(t, "text", n, "n").collect()}
    assert got == {(i, x) for i, s in enumerate(texts) if s for x in needles if x in s}


def test_longest_line_of_many(spark):
    q = spark.createDataFrame([(1, "line 70 05 closed?"), (2, "none"), (3, None)], "id int, question string")
    lines = spark.createDataFrame([(f"line {i}",) for i in range(8000)], "line_name string")
    assert {r.id: r.line for r in questions.with_line(q, lines).collect()} == {1: "line 7005", 2: None, 3: None}


def test_markers_are_nearest_in_degrees(spark):
    c = spark.createDataFrame([(1, "cam", "r1", 37.0, 127.0)], "id long, name string, route string, lat double, lon double")
    far = [(i, "m", "x", 37.10 + i / 1e4, 127.0) for i in range(1, 6)]
    near = [(100 + i, "m", "x", 37.0, 127.12 + i / 1e5) for i in range(60)]
    m = spark.createDataFrame(far + near, "id long, name string, route string, lat double, lon double")
    assert [r.marker_id for r in I.match_markers(c, m).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_assignment_equals_taking_turns(spark):
    rng = random.Random(3)
    cams = [(i, 37 + rng.random() / 5, 127 + rng.random() / 5) for i in range(14)]
    hot = [(p, f"h{p}", 37.1 + rng.random() / 50, 127.1 + rng.random() / 50) for p in range(16)]
    used, want = set(), {}
    for p, _, lat, lon in hot:
        free = sorted((round(km(lat, lon, c[1], c[2]), 9), c[0]) for c in cams if c[0] not in used)
        if free:
            want[p] = free[0][1]
            used.add(free[0][1])
    h = spark.createDataFrame(hot, "pos long, name string, lat double, lon double")
    c = spark.createDataFrame(cams, "cctv_id long, lat double, lon double")
    assert {r.pos: r.cctv_id for r in I.assign_cameras(h, c, first=4).collect()} == want


def test_groups_equal_plain_rule():
    rng = random.Random(8)
    rows, t = [], 0.0
    for e in range(400):
        t += rng.choice((0, 5, 40, 200))
        cam = rng.randrange(12)
        rows.append((e, t, cam, 37 + cam * 0.02, 127.0, rng.choice((None, None, None, 1 + e // 40))))
    groups, named, want = [], {}, {}
    for e, t, cam, lat, lon, inc in rows:
        live = [g for g in groups if t - g["t"] <= I.GROUP_SEC]
        g = next((x for x in groups if x["id"] == named.get(inc)), None) if inc in named else next(
            (x for x in live if cam not in x["cams"] and km(lat, lon, x["lat"], x["lon"]) <= I.GROUP_KM), None)
        if g is None:
            g = {"id": e, "t": t, "lat": lat, "lon": lon, "cams": set()}
            groups.append(g)
            if inc is not None:
                named[inc] = e
        g["cams"].add(cam)
        want[e] = g["id"]
    df = pd.DataFrame(rows, columns=["event_id", "t", "camera_id", "lat", "lon", "incident_id"])
    state, got = {}, {}
    for a in range(0, len(df), 37):
        state, out = I.group_step(json.loads(json.dumps(state)), df[a : a + 37])
        got.update(zip(out.event_id.tolist(), out.group_id.tolist()))
    assert got == want


def test_contains_join_by_rarest_gram(spark):
    rnd = random.Random(3)
    names = [f"EV0000{i:06d}" for i in range(20_000)] + ["a", "zz", "long needle with words", "x" * 40, "missing!", ""]
    texts = [(i, " ".join([f"EV0000{rnd.randrange(40_000):06d}", rnd.choice(["a", "b", "zzz", "long needle with words", "x" * 41]), "EV0000"])) for i in range(300)] + [(900, None), (901, "")]
    t = spark.createDataFrame(texts, "id long, text string")
    n = spark.createDataFrame([(x,) for x in names] + [(None,)], "name string")
    known = set(names)
    want = {(i, x) for i, s in texts if s for x in {s[a:b] for a in range(len(s)) for b in range(a + 1, min(len(s), a + 45) + 1)} & known}
    assert {(r.id, r.name) for r in contains_join(t, "text", n, "name").collect()} == want
    some = n.where("length(name) <> 12")
    short = {(i, x) for i, x in want if len(x) != 12}
    for few in (0, 64):
        assert {(r.id, r.name) for r in contains_join(t, "text", some, "name", few).collect()} == short


def test_nearest_far_away_and_at_the_poles(spark):
    rnd = random.Random(6)
    site = [(i, 36 + rnd.uniform(-1, 1), 127 + rnd.uniform(-1, 1)) for i in range(400)] + [(900, 89.9, 10.0), (901, -89.5, 0.0), (902, 10.0, 179.99), (903, 10.0, -179.99), (904, 90.0, 0.0)]
    pts = [(90.0, 77.0), (-90.0, 0.0), (10.0, 180.0), (10.0, -180.0), (-36.0, -53.0), (0.0, 0.0), (36.0, 127.0), (89.95, -170.0)]
    s = spark.createDataFrame(site, "cctv_id long, site_lat double, site_lon double")
    p = spark.createDataFrame(pts + pts[:2] + [(None, 1.0)], "lat double, lon double")

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    for k in (1, 3, 10):
        got = {}
        for r in nearest(p, s, k).collect():
            got.setdefault((r.lat, r.lon), []).append((r["rank"], r.distance_km))
        for a in pts:
            best = sorted(km(*a, b[1], b[2]) for b in site)[:k]
            assert all(abs(d - w) < 1e-6 for (_, d), w in zip(sorted(got[a]), best, strict=True)), (a, k)
    assert nearest(p, s.limit(0), 3).count() == 0
    assert nearest(p, s.where("cctv_id >= 903"), 5).count() == 2 * len(set(pts))
