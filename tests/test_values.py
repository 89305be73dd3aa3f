"""Hand-computed values of scalar functions and readers."""

import json

from pyspark.sql import functions as F

from tarmac.functions import clock as K
from tarmac.functions import geo
from tarmac.functions import text as X
from tarmac.operators import clips, ensemble, incidents, normalise, risk, scoring
from tarmac.sinks import tables
from tarmac.sources import cameras, feeds, files
from tarmac.sources.rules import rules_frame


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(r)


def lit(x):
    return F.lit(x)


def test_geometry(spark):
    square = F.array(*[F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y"))
                       for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    d, inside, out = one(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0)),
                         geo.in_polygon(lit(0.5), lit(0.5), square), geo.in_polygon(lit(2.0), lit(0.5), square))
    assert round(d, 4) == 111.1949 and inside and not out


def test_clock_and_text(spark):
    got = one(
        spark, K.closure_minutes(lit("23:50"), lit("00:20")), K.closure_minutes(lit("10:00"), lit("10:00")),
        K.closure_minutes(lit("x"), lit("10:00")), K.spaced_date(lit("2024. 1. 5"), lit("09:07")),
        K.duration_seconds(lit("24h")), K.valid_day(lit("20240230")), X.slug(lit("[경부] 수원 IC")),
        X.road_in_text(lit("[경부선] 사고")), X.closure_in_text(lit("차단/처리시간 약 42분")),
        X.file_slug(lit("[A] b/c (d)")))
    assert got == [30, None, None, "2024-01-05 09:07", 86400.0, None, "경부__수원_IC", "경부선", 42, "A_b_c_d"]


def test_levels_and_quota(spark):
    got = one(spark, *[risk.risk_level(lit(p)) for p in (0.7, 0.5, 0.3, 0.29)],
              incidents.hotspot_quota(lit(100), 50, 10), incidents.hotspot_quota(lit(20), 50, 0))
    assert got == ["critical", "high", "medium", "low", 5, 20]


def test_retention(spark):
    r = incidents.retention
    got = one(spark, r(lit(0.1), lit(0), lit(False)), r(lit(0.1), lit(None).cast("int"), lit(True)),
              r(lit(0.75), lit(2), lit(False)), r(lit(0.75), lit(None).cast("int"), lit(False)),
              r(lit(0.1), lit(2), lit(False)))
    assert got == ["confirmed", "pending_preserved", "confirmed", "deleted", "deleted"]


def test_ensemble_branches(spark):
    v = "array<struct<rule_id:string,rule_pos:int,label:string,severity:string,weight:double,score:double,involved_tracks:array<bigint>>>"
    med = [("R3", 2, "x", "MEDIUM", 0.5, 0.5, [1])]
    df = spark.createDataFrame(
        [(1, med, {"a": 0.4}), (2, [], {"a": 0.6, "b": 0.6}), (3, [], {"a": 0.95}), (4, [], {"a": 0.35}),
         (5, [], {}), (6, med, {})], f"id int, violations {v}, ml_scores map<string,double>")
    got = {r.id: (round(r.final_score, 6), r.trigger, r.trigger_reason) for r in ensemble.score(df).collect()}
    assert got == {1: (0.45, True, "rule_medium_ml_support"), 2: (0.6, True, "ml_vote_2"),
                   3: (0.95, True, "ml_high_conf_a"), 4: (0.35, True, "ml_only"),
                   5: (0.0, False, "no_signal"), 6: (0.5, False, "below_threshold")}


def test_responses(spark):
    df = spark.createDataFrame([('```json\n{"accident_detected":"yes","confidence":1.7,"accident_type":"x"}\n```',),
                                ('so {"accident_detected": false, "involved_vehicles":[1]} ok',), ("plain",)], "t string")
    got = [(r.accident_detected, r.confidence, r.accident_type, r.involved_vehicles, r.parse_error)
           for r in normalise.accident(df, "t").collect()]
    assert got == [(True, 1.0, "none", "[]", False), (False, 0.0, "none", "[]", False),
                   (False, 0.0, "none", "[]", True)]


def test_thresholds_first_wins(spark):
    df = spark.createDataFrame([(1, 0.95), (1, 0.9), (0, 0.05), (0, 0.02)], "y int, prob double")
    assert abs(scoring.best_threshold(df).first().threshold - 0.1) < 1e-9
    assert scoring.auc(df).first().auc == 1.0


def test_blink_array_form_equals_table_form(spark):
    vals = [float((i // 3) % 2 * 10) for i in range(40)]
    a = one(spark, clips.blink_score(F.array(*[lit(x) for x in vals])))[0]
    t = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(vals)],
                              "clip_id long, track_id long, frame long, intensity double")
    assert abs(a - clips.blink(t, size=12).first().blink_score) < 1e-9 and a > 0


def test_upsert_and_replay(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, seq int")
    assert {(r.id, r.v) for r in tables.latest_by_key(df, ["id"], "seq").collect()} == {(1, "b"), (2, "c")}
    good, bad = tables.split_valid(df, {"v": F.col("v") != "c"})
    assert good.count() == 2 and bad.count() == 1
    p = str(tmp_path / "t")
    tables.upsert(df.withColumn("d", lit(1)), p, ["id"], "seq", "d")
    tables.upsert(spark.createDataFrame([(2, "z", 9, 1)], "id int, v string, seq int, d int"), p, ["id"], "seq", "d")
    assert {(r.id, r.v) for r in spark.read.parquet(p).collect()} == {(1, "b"), (2, "z")}


def test_feeds(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"name": "A", "x": 127.0, "y": 37.0},
                                                {"cctv_name": "B", "coordx": "127.5", "coordy": "37.5"}]))
    c = feeds.camera_catalogue(spark, str(tmp_path / "c.json")).orderBy("name").collect()
    assert [(r.name, r.lon) for r in c] == [("A", 127.0), ("B", 127.5)]
    d = tmp_path / "polls"
    d.mkdir()
    (d / "1.json").write_text(json.dumps({"body": {"items": [
        {"linkId": "L1", "coordX": "127.1", "coordY": "bad", "startDate": "20240101120000"}]}}))
    (d / "2.json").write_text(json.dumps({"header": {"resultCode": "4001"}, "body": {"items": []}}))
    (d / "3.json").write_text(json.dumps({"body": {"items": []}}))
    i = feeds.incident_feed(spark, str(d)).collect()
    assert len(i) == 1 and i[0].lat is None and i[0].lon == 127.1
    st = {r.poll[-6:]: (r.feed_ok, r.n_items) for r in feeds.feed_status(spark, str(d)).collect()}
    assert st == {"1.json": (True, 1), "2.json": (False, None), "3.json": (True, 0)}
    (tmp_path / "cc.json").write_text(json.dumps({"response": {"data": [
        {"roadsectionid": "", "cctvname": "[a] b", "coordx": "1", "coordy": "2"}]}}))
    assert feeds.camera_feed(spark, str(tmp_path / "cc.json")).first().cctv_id == "a__b"


def test_files(spark, tmp_path):
    t = tmp_path / "traj"
    t.mkdir()
    (t / "clip_an3.txt").write_text("0 1 1 0.5 0.5\n1 1 1 0.6 x\nshort\n2 1 1 0.7 0.7 9\n")
    r = files.labelled_split(spark, str(t)).orderBy("frame").collect()
    assert [(x.frame, x.type, x.y) for x in r] == [(0, "an3", 0.5), (2, "an3", 0.7)] or \
        [(x.frame, x.type) for x in r] == [(0, "an3"), (2, "an3")]
    root = tmp_path / "labels" / "정상" / "s" / "c1"
    root.mkdir(parents=True)
    (root / "img_0007.json").write_text(json.dumps({"annotation": [{"id": 4, "bbox": [0, 0, 10, 20]}]}))
    b = files.clip_boxes(files.label_clips(spark, str(tmp_path / "labels"))).first()
    assert (b.label, b.clip_id, b.frame, b.track_id, b.cx, b.cy) == ("정상", "c1", 7, 4, 5.0, 10.0)
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, bad = files.json_log(spark, str(tmp_path / "log.jsonl"), "a int")
    assert [r.a for r in good.orderBy("a").collect()] == [1, 2] and bad.first().line == "not json"
    rec = tmp_path / "rec" / "20240101" / "cam1_hls"
    rec.mkdir(parents=True)
    (rec / "x.ts").write_bytes(b"12345")
    f = files.recordings(spark, str(tmp_path / "rec")).first()
    assert (f.camera, f.day, f.length) == ("cam1", "20240101", 5)


def test_dimensions_and_probe(spark):
    assert cameras.vehicle_classes(spark).count() == 13 and cameras.hotspots(spark).count() == 7
    assert rules_frame(spark).count() == 10
    assert cameras.config_frame(spark, [cameras.default_config("c")]).count() == 1
    kb = spark.createDataFrame([("1", "t", "a, b")], "id string, content string, keywords string")
    s = cameras.probe(kb)
    assert s["chunk_text"] == "content" and s["vectors_in"] is None
    assert cameras.knowledge_rows(kb, s).first().keywords == ["a", "b"]
    d = spark.createDataFrame([("SUV",), ("boat",)], "cat string")
    ok, bad = cameras.map_category(d, "cat", "kind")
    assert ok.first().kind == "승용" and bad.first().cat == "boat"
