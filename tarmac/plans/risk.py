"""Queries on accident risk and on score evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import clips as C
from tarmac.operators import ensemble, flow, learners, risk, scoring
from tarmac.plans.clips import amber, boxes
from tarmac.plans.registry import query
from tarmac.plans.traffic import PERIOD, SQL_FLOW, r6
from tarmac.session import stage
from tarmac.sources import samples as S

NOW = S.EPOCH_2024 + 31 * 86_400


def agg_table(spark, sf):
    e = S.ev(spark, sf)
    obs = e.select(F.concat(F.lit("NATION_"), "camera_id").alias("ic_name"), "ts", "track_id", "speed",
                   F.col("cls").alias("vehicle_cls"), "event_id")
    f = flow.traffic_flow(obs, PERIOD, "event_id")
    r = e.groupBy(F.concat(F.lit("NATION_"), "camera_id").alias("ic_name"),
                  flow.floor_to("ts", PERIOD).alias("period_start")).agg(
        (F.avg("k") / 100.0).alias("risk_score"))
    return f.join(r, ["ic_name", "period_start"])


def responses(spark, sf):
    e = S.ev(spark, sf)
    return e.select((F.col("camera_id") * 100_000 + F.col("track_id")).alias("video_id"),
                    F.unix_timestamp("ts").alias("created_t"),
                    F.concat(F.lit("T"), 1 + F.col("event_id") % 7).alias("trigger_type"),
                    (F.col("k") >= 90).alias("is_anomaly"),
                    F.concat(F.lit("NATION_"), "camera_id").alias("ic_name"))


def acc_table(spark, sf):
    a = S.accidents(spark, sf)
    kind = F.when(F.col("accident_type") == "F", "IC").when(
        F.col("accident_type") == "O", "JC").otherwise("TG")
    return a.select(
        F.concat(F.lit("OB_"), "event_id", F.lit("_NATION_"), F.col("o_custkey") % 10).alias("event_id"),
        "road_name", kind.alias("point_type"),
        (F.lit(S.EPOCH_2024) + F.col("event_id") * 4099 % 2_592_000).alias("report_t"))


SQL_AGG = SQL_FLOW + f""",
rsk AS (SELECT camera_id, CAST(floor(epoch(ts) / {PERIOD}) AS BIGINT) * {PERIOD} AS period_start,
               avg(k) / 100.0 AS risk_score FROM ev GROUP BY 1, 2),
agg AS (SELECT 'NATION_' || flow.ic_name AS ic_name, flow.period_start, volume, avg_speed, speed_std,
               truck_ratio, risk_score
        FROM flow JOIN rsk ON flow.ic_name = camera_id AND flow.period_start = rsk.period_start),
{S.SQL_ACC.strip()},
ac AS (SELECT 'OB_' || event_id || '_NATION_' || (o_custkey % 10) AS event_id, road_name,
              CASE accident_type WHEN 'F' THEN 'IC' WHEN 'O' THEN 'JC' ELSE 'TG' END AS point_type,
              {S.EPOCH_2024} + event_id * 4099 % 2592000 AS report_t FROM acc),
lnk AS (SELECT DISTINCT ic_name, ac.event_id, report_t, point_type FROM ac
        JOIN (SELECT DISTINCT ic_name FROM agg) i ON road_name = ic_name OR contains(ac.event_id, ic_name))"""

SQL_RISK = SQL_AGG + f""",
tf AS (SELECT *, avg(avg_speed) OVER p AS ps, avg(volume) OVER p AS pv,
              avg(risk_score) OVER (PARTITION BY ic_name ORDER BY period_start
                                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS risk_score_ma3
       FROM agg WINDOW p AS (PARTITION BY ic_name ORDER BY period_start
                             ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
rp AS (SELECT 'NATION_' || camera_id AS ic_name, CAST(floor(epoch(ts) / {PERIOD}) AS BIGINT) * {PERIOD} AS period_start,
              count(*) FILTER (k >= 90) AS an, count(*) FILTER (event_id % 7 = 0) AS t1,
              count(*) FILTER (event_id % 7 = 1) AS t2, count(*) FILTER (event_id % 7 = 2) AS t3
       FROM ev GROUP BY 1, 2),
hs AS (SELECT ic_name, count(*) AS periods,
              coalesce(avg(volume) FILTER (period_start >= {NOW} - 30 * 86400), 0.0) AS hist_avg_volume
       FROM agg GROUP BY 1),
la AS (SELECT ic_name, count(*) AS accidents, arg_min(point_type, event_id) AS pt FROM lnk GROUP BY 1),
risk AS (
  SELECT tf.ic_name, tf.period_start, CAST(volume AS DOUBLE) AS volume, avg_speed, speed_std, truck_ratio,
         CASE WHEN ps > 0 THEN (avg_speed - ps) / ps ELSE 0.0 END AS speed_change_rate,
         CASE WHEN pv > 0 THEN (volume - pv) / pv ELSE 0.0 END AS volume_change_rate,
         risk_score, risk_score_ma3, CAST(coalesce(an, 0) AS DOUBLE) AS anomaly_count,
         CAST(coalesce(t1, 0) AS DOUBLE) AS trigger_ttc_count,
         CAST(coalesce(t2, 0) AS DOUBLE) AS trigger_decel_count,
         CAST(coalesce(t3, 0) AS DOUBLE) AS trigger_stop_count,
         CAST(hour(to_timestamp(tf.period_start) AT TIME ZONE 'UTC') AS DOUBLE) AS hour,
         CAST(isodow(to_timestamp(tf.period_start) AT TIME ZONE 'UTC') - 1 AS DOUBLE) AS day_of_week,
         CASE pt WHEN 'IC' THEN 0.0 WHEN 'JC' THEN 1.0 WHEN 'TG' THEN 2.0 END AS ic_type_encoded,
         coalesce(accidents, 0) / greatest(periods, 1) AS hist_accident_rate, hist_avg_volume
  FROM tf LEFT JOIN rp USING (ic_name, period_start) JOIN hs USING (ic_name) LEFT JOIN la USING (ic_name)),
risk2 AS (
  SELECT *, CASE WHEN day_of_week >= 5 THEN 1.0 ELSE 0.0 END AS is_weekend,
         CASE WHEN day_of_week < 5 AND (hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19) THEN 1.0
              ELSE 0.0 END AS is_rush_hour FROM risk)"""


def risk_table(spark, sf):
    r = responses(spark, sf)
    a = stage(agg_table(spark, sf))
    return risk.features(a, r, r, acc_table(spark, sf), PERIOD, F.lit(NOW))


@query("risk_features", f"""
WITH {SQL_RISK}
SELECT ic_name, period_start, {', '.join(f'round({c}, 6) AS {c}' for c in risk.FEATURES)} FROM risk2""")
def risk_features(spark, sf):
    return risk_table(spark, sf).select("ic_name", "period_start", *[r6(c) for c in risk.FEATURES])


@query("risk_labels", f"""
WITH {SQL_AGG}
SELECT a.ic_name, a.period_start, CAST(EXISTS (SELECT 1 FROM lnk l WHERE l.ic_name = a.ic_name
  AND l.report_t >= a.period_start AND l.report_t < a.period_start + 1800) AS INTEGER) AS label FROM agg a""")
def risk_labels(spark, sf):
    a = stage(agg_table(spark, sf))
    return risk.labels(a, risk.accident_links(acc_table(spark, sf), a), PERIOD)


LEVEL_SQL = ("CASE WHEN risk_score >= 0.7 THEN 'critical' WHEN risk_score >= 0.5 THEN 'high' "
             "WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END")


@query("risk_heatmap", f"""
WITH {SQL_AGG},
h AS (SELECT *, hour(to_timestamp(period_start) AT TIME ZONE 'UTC') AS hour_of_day FROM agg),
l AS (SELECT ic_name, hour_of_day, max(period_start) AS period_start FROM h GROUP BY 1, 2)
SELECT l.ic_name, l.hour_of_day, l.period_start, round(risk_score, 6) AS risk_score, {LEVEL_SQL} AS risk_level
FROM l JOIN agg USING (ic_name, period_start)""")
def risk_heatmap(spark, sf):
    h = risk.heatmap(agg_table(spark, sf))
    return h.select("ic_name", F.col("hour_of_day").cast("long").alias("hour_of_day"), "period_start",
                    r6("risk_score"), risk.risk_level(F.col("risk_score")).alias("risk_level"))


@query("ic_ranking", f"""
WITH {SQL_RISK},
l AS (SELECT *, row_number() OVER (PARTITION BY ic_name ORDER BY period_start DESC) AS b FROM risk2),
u AS (SELECT ic_name, f.name, f.v, f.i FROM l, LATERAL (VALUES {', '.join(
    f"('{c}', {c}, {i})" for i, c in enumerate(x for x in risk.FEATURES if x not in risk.CATEGORICAL))}) f(name, v, i)
  WHERE b = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY ic_name ORDER BY abs(v) DESC, i) AS rk FROM u)
SELECT l.ic_name, round(risk_score_ma3, 6) AS risk, row_number() OVER (ORDER BY risk_score_ma3 DESC, l.ic_name) AS rank,
       (SELECT string_agg(name, ',' ORDER BY rk) FROM o WHERE o.ic_name = l.ic_name AND rk <= 3) AS factors
FROM l WHERE b = 1""")
def ic_ranking(spark, sf):
    """Interchanges by smoothed risk with their three strongest factors."""
    t = risk.latest(risk_table(spark, sf), ["ic_name"])
    # one row per interchange
    rank = F.row_number().over(Window.orderBy(F.desc("risk_score_ma3"), "ic_name"))
    return t.select("ic_name", r6("risk_score_ma3", "risk"), rank.alias("rank"), F.array_join(
        F.transform(risk.top_factors(), lambda f: f["feature"]), ",").alias("factors"))


@query("risk_report", f"""
WITH {SQL_AGG},
l AS (SELECT ic_name, arg_max(risk_score, period_start) AS risk_score FROM agg GROUP BY 1),
v AS (SELECT *, {LEVEL_SQL} AS lv FROM l)
SELECT count(*) AS total_ics, count(*) FILTER (lv = 'critical') AS critical_count,
       count(*) FILTER (lv = 'high') AS high_count,
       (SELECT count(*) FROM (SELECT DISTINCT ic_name, hour(to_timestamp(period_start) AT TIME ZONE 'UTC') FROM agg))
         AS heat_cells FROM v""")
def risk_report(spark, sf):
    a = agg_table(spark, sf)
    ranking = risk.latest(a, ["ic_name"]).withColumn(
        "risk_level", risk.risk_level(F.col("risk_score")))
    return risk.report(ranking, risk.heatmap(a)).drop("rankings", "heatmap")


@query("risk_report_entries", f"""
WITH {SQL_AGG},
l AS (SELECT ic_name, arg_max(risk_score, period_start) AS risk_score FROM agg GROUP BY 1),
h AS (SELECT ic_name, hour(to_timestamp(period_start) AT TIME ZONE 'UTC') AS hour_of_day, arg_max(risk_score, period_start) AS risk_score FROM agg GROUP BY 1, 2)
SELECT 'ranking' AS part, row_number() OVER (ORDER BY risk_score DESC, ic_name) AS place, ic_name, CAST(NULL AS INT) AS hour_of_day,
       round(risk_score, 6) AS risk_score, {LEVEL_SQL} AS risk_level FROM l
UNION ALL SELECT 'heatmap', row_number() OVER (ORDER BY ic_name, hour_of_day), ic_name, CAST(hour_of_day AS INT), round(risk_score, 6), NULL FROM h""")
def risk_report_entries(spark, sf):
    """What the report's two JSON texts say, entry by entry in their order."""
    a = agg_table(spark, sf)
    ranking = risk.latest(a, ["ic_name"]).withColumn("risk_level", risk.risk_level(F.col("risk_score")))
    r = stage(risk.report(ranking, risk.heatmap(a)))
    kind = dict(a.dtypes)["ic_name"]

    def entries(part):
        rows = r.select(F.posexplode(F.from_json(part, f"array<struct<ic_name: {kind}, hour_of_day: int, risk_score: double, risk_level: string>>")).alias("p", "e"))
        return rows.select(F.lit(part.removesuffix("s")).alias("part"), (F.col("p") + 1).cast("long").alias("place"), "e.ic_name", "e.hour_of_day", r6("e.risk_score", "risk_score"), "e.risk_level")

    return entries("rankings").unionByName(entries("heatmap"))


def scores(spark, sf):
    lab = S.table(spark, sf, "labels")
    d = S.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("y"), F.col("lang").alias("type"),
        ((F.col("n_chars") % 100) / 100.0).alias("prob"), "n_chars", "quality")


SQL_SCORES = """
sc AS (SELECT l.doc_id AS id, toxic AS y, lang AS type, (n_chars % 100) / 100.0 AS prob, n_chars, quality
       FROM labels l JOIN documents d USING (doc_id))"""


@query("threshold_search", f"""
WITH {SQL_SCORES},
g AS (SELECT i, 0.1::DOUBLE + 0.025::DOUBLE * i AS threshold FROM range(33) t(i)),
m AS (SELECT i, threshold, count(*) FILTER (y = 1 AND prob::DOUBLE >= threshold) / count(*) FILTER (y = 1) AS recall,
             count(*) FILTER (y <> 1 AND prob::DOUBLE >= threshold) / count(*) FILTER (y <> 1) AS fpr
      FROM sc, g GROUP BY 1, 2),
b AS (SELECT * FROM m WHERE fpr <= 0.10 ORDER BY recall DESC, i LIMIT 1),
a AS (SELECT sum(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0 END) / count(*) AS auc
      FROM sc p JOIN sc n ON p.y = 1 AND n.y <> 1)
SELECT round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr,
       round(auc, 6) AS auc FROM b, a""")
def threshold_search(spark, sf):
    s = scores(spark, sf)
    return scoring.best_threshold(s).join(scoring.auc(s)).select(
        r6("threshold"), r6("recall"), r6("fpr"), r6("auc"))


@query("per_type_recall", f"""
WITH {SQL_SCORES}
SELECT type, y, count(*) AS n, round(avg(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM sc GROUP BY 1, 2""")
def per_type_recall(spark, sf):
    return scoring.per_type(scores(spark, sf)).select("type", "y", "n", r6("rate"))


@query("classification_metrics", f"""
WITH {SQL_SCORES},
c AS (SELECT count(*) FILTER (prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (prob >= 0.5 AND y <> 1) AS fp,
             count(*) FILTER (prob < 0.5 AND y = 1) AS fn, count(*) FILTER (prob < 0.5 AND y <> 1) AS tn FROM sc)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def classification_metrics(spark, sf):
    c = scoring.confusion(scores(spark, sf))
    return c.select("tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("f1"), r6("accuracy"))


@query("feature_importance", f"""
WITH {SQL_SCORES}
SELECT 'n_chars' AS feature, round(abs(corr(n_chars, -prob)), 6) AS weight FROM sc
UNION ALL SELECT 'quality', round(abs(corr(quality, -prob)), 6) FROM sc
UNION ALL SELECT 'y', round(abs(corr(y, -prob)), 6) FROM sc""")
def feature_importance(spark, sf):
    s = scores(spark, sf)
    return scoring.importance(s, ["n_chars", "quality", "y"], "prob").select("feature", r6("weight"))


@query("score_bands", f"""
WITH {SQL_SCORES},
s AS (SELECT count(*) AS n, count(*) FILTER (prob < 0.3) AS low, count(*) FILTER (prob >= 0.3 AND prob < 0.5) AS mid,
             count(*) FILTER (prob >= 0.5 AND prob < 0.7) AS high, count(*) FILTER (prob >= 0.7) AS top,
             avg(prob) AS mean, avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END) AS flag_rate,
             quantile_cont(prob::DOUBLE, 0.5) AS median FROM sc WHERE y = 0)
SELECT n, low, mid, high, top, round(mean, 6) AS mean, round(flag_rate, 6) AS flag_rate,
       round(median, 6) AS median, CASE WHEN flag_rate < 0.1 THEN 'fit' WHEN flag_rate < 0.3 THEN 'caution'
       ELSE 'retrain' END AS verdict FROM s""")
def score_bands(spark, sf):
    b = scoring.bands(scores(spark, sf).where("y = 0"))
    return b.select("n", "low", "mid", "high", "top", r6("mean"), r6("flag_rate"), r6("median"), "verdict")


@query("class_weight", """
WITH w AS (SELECT count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic <> 1) AS negatives FROM labels)
SELECT positives, negatives, round(negatives / greatest(positives, 1), 6) AS weight FROM w""")
def class_weight(spark, sf):
    return scoring.class_weight(S.table(spark, sf, "labels"), "toxic").select(
        "positives", "negatives", r6("weight"))


@query("model_gate", """
WITH e AS (SELECT 'm' || doc_id % 5 AS model, doc_id // 100 AS epoch, avg(quality) AS auroc FROM labels GROUP BY 1, 2),
b AS (SELECT model, max(auroc) AS auroc FROM e GROUP BY 1),
m AS (SELECT DISTINCT 'm' || doc_id % 6 AS model, doc_id % 6 <> 1 AS enabled, doc_id % 6 <> 2 AS present FROM labels)
SELECT model, round(auroc, 6) AS auroc, enabled AND present AND NOT coalesce(auroc < 0.6, false) AS active,
       CASE WHEN enabled AND present AND NOT coalesce(auroc < 0.6, false) THEN 'ok' ELSE
       concat_ws(',', CASE WHEN NOT enabled THEN 'config disabled' END, CASE WHEN NOT present THEN 'model missing' END,
                 CASE WHEN auroc < 0.6 THEN 'auroc below bar' END) END AS reasons
FROM m LEFT JOIN b USING (model)""")
def model_gate(spark, sf):
    lab = S.table(spark, sf, "labels")
    e = lab.groupBy(F.concat(F.lit("m"), F.col("doc_id") % 5).alias("model"),
                    F.expr("doc_id div 100").alias("epoch")).agg(F.avg("quality").alias("auroc"))
    m = lab.select(F.concat(F.lit("m"), F.col("doc_id") % 6).alias("model"),
                   (F.col("doc_id") % 6 != 1).alias("enabled"),
                   (F.col("doc_id") % 6 != 2).alias("present")).distinct()
    return ensemble.gate(m, e).select("model", r6("auroc"), "active",
                                      F.array_join("reasons", ",").alias("reasons"))


def clip_table(spark, sf):
    k = C.kinematics(S.traj(spark, sf))
    return k.withColumn("label", (F.col("clip_id") % 3 == 0).cast("int"))


@query("clip_detector")
def clip_detector(spark, sf):
    """Forest on the 28 clip features: trained on a stratified 70 %, scored on the rest."""
    df = stage(clip_table(spark, sf))
    train, test = learners.holdout(df)
    model = learners.train_forest(train, C.KINEMATIC)
    return learners.predict(model, test).select("clip_id", "label", r6("prob"))


@query("detector_selection")
def detector_selection(spark, sf):
    """The clip detector chosen among models by folds, with its threshold: verdicts on the clips held out."""
    _, _, out = learners.select_detector(stage(clip_table(spark, sf)), C.KINEMATIC, folds=3)
    return out.select("clip_id", "label", "model", r6("prob"), r6("threshold"), "flagged")


@query("lane_specialist")
def lane_specialist(spark, sf):
    """The lane-change specialist: a forest on the 28 clip features, blink and lateral movement of the clips with a lane change."""
    f = C.specialist_features(S.traj(spark, sf), amber(spark, sf))
    df = stage(f.withColumn("label", (F.col("clip_id") % 3 == 0).cast("int")))
    train, test = learners.holdout(df)
    model = learners.train_forest(train, C.SPECIALIST)
    return learners.predict(model, test).select("clip_id", "label", r6("blink"), r6("changer_lat"), r6("prob"))


@query("iforest_scores")
def iforest_scores(spark, sf):
    df = stage(clip_table(spark, sf))
    s = learners.isolation_scores(df, F.col("label") == 0, C.KINEMATIC)
    return s.select("clip_id", "label", r6("anomaly_score"), "is_anomaly")


@query("recon_threshold")
def recon_threshold(spark, sf):
    cols = ["f_cx", "f_cy", "f_w", "f_h", "f_dx", "f_dy", "f_speed", "f_hsin", "f_hcos", "f_lat",
            "f_area", "f_aspect"]
    w = stage(C.sequence_windows(C.sequence_features(boxes(spark, sf)), cols))
    e = learners.reconstruction_errors(w, F.col("clip_id") % 3 != 0)
    return e.select("clip_id", "track_id", "win", r6("error"), "is_anomaly")


def trained(spark, sf):
    """The periods' features and labels with the probability of a model trained on them."""
    f = risk_table(spark, sf)
    a = agg_table(spark, sf).select("ic_name", "period_start")
    lab = risk.labels(a, risk.accident_links(acc_table(spark, sf), a), PERIOD)
    df = stage(f.join(lab, ["ic_name", "period_start"]))
    return learners.predict(learners.train_risk(df, risk.FEATURES, ["ic_name", "period_start"]), df)


@query("risk_model")
def risk_model(spark, sf):
    """Boosted trees on the nineteen features and 30-minute labels, scored on every period."""
    return trained(spark, sf).select("ic_name", "period_start", "label", r6("prob"),
                                     risk.risk_level(F.col("prob")).alias("risk_level"))


@query("risk_model_ranking")
def risk_model_ranking(spark, sf):
    """All interchanges ranked by the trained model on their latest period."""
    t = risk.score_places(trained(spark, sf))
    return t.select("ic_name", r6("risk_score"), "risk_level", "rank", F.array_join(F.transform("factors", lambda f: f["feature"]), ",").alias("factors"))
