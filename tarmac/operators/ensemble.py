"""Rules and model scores combined per frame, then turned into alerts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators import folds

MIN_AUROC = 0.60
ALERT_AT = 0.3
ALARM_AT = 0.7
ALARMS_PER_HOUR = 10
HOUR = 3600.0
ML_VOTE_AT, ML_VOTES, ML_SURE, ML_SUPPORT = 0.5, 2, 0.9, 0.3


def gate(models: DataFrame, evaluations: DataFrame, min_auroc: float = MIN_AUROC) -> DataFrame:
    """Which models may vote: enabled, present, and best evaluated AUROC not below the bar.

    models(model, enabled, present); evaluations(model, epoch, auroc) may lack a model.
    """
    best = evaluations.groupBy("model").agg(F.max("auroc").alias("auroc"))
    m = models.join(best, "model", "left")
    reasons = F.array_compact(F.array(
        F.when(~F.col("enabled"), "config disabled"),
        F.when(~F.col("present"), "model missing"),
        F.when(F.col("auroc") < min_auroc, "auroc below bar"),
    ))
    return m.select("model", "auroc", (F.size(reasons) == 0).alias("active"),
                    F.when(F.size(reasons) == 0, F.array(F.lit("ok"))).otherwise(reasons)
                    .alias("reasons"))


def keep_models(scores: Column, active: Column) -> Column:
    return F.map_filter(scores, lambda k, _: F.array_contains(active, k))


def dropped_models(scores: Column, active: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(scores), active))


def involved(vs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(vs, lambda v: v["involved_tracks"])))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def _max_score(vs: Column) -> Column:
    return F.array_max(F.transform(vs, lambda v: v["score"]))


_NO_V = ("array<struct<rule_id:string,rule_pos:int,label:string,severity:string,weight:double,"
         "score:double,involved_tracks:array<bigint>>>")


def score(frames: DataFrame, violations: str = "violations", ml: str = "ml_scores") -> DataFrame:
    """Six ordered branches; `frames` has the ordered violation array and gated model scores."""
    vs = F.coalesce(F.col(violations), F.array().cast(_NO_V))
    scores = F.coalesce(F.col(ml), F.create_map().cast("map<string,double>"))
    f = frames.withColumn("_vs", vs).withColumn("_ml", scores)
    vs, vals = F.col("_vs"), F.map_values("_ml")
    f = f.withColumn("_ch", F.filter(vs, lambda v: v["severity"].isin("CRITICAL", "HIGH")))
    f = f.withColumn("_med", F.filter(vs, lambda v: v["severity"] == "MEDIUM"))
    f = f.withColumn("_vote", F.filter(vals, lambda s: s >= ML_VOTE_AT))
    ch, med, vote = F.col("_ch"), F.col("_med"), F.col("_vote")
    sure = F.filter(F.map_entries("_ml"), lambda e: e["value"] >= ML_SURE)
    best = F.get(F.array_sort(F.transform(sure, lambda e: F.struct(
        (-e["value"]).alias("s"), e["key"].alias("k")))), F.lit(0))
    f = f.withColumn("_best", F.when(F.size(sure) > 0, best))
    support = F.exists(vals, lambda s: s >= ML_SUPPORT)
    top_ch = F.get(ch, F.lit(0))
    no_tracks = F.array().cast("array<bigint>")
    one = F.lit(1.0)

    def branch(s, trig, reason, top, tracks):
        return F.struct(F.round(s, 12).alias("final_score"), trig.alias("trigger"),
                        reason.alias("trigger_reason"), top.alias("top_violations"),
                        tracks.alias("involved_tracks"))

    yes, no = F.lit(True), F.lit(False)
    none = F.array().cast(_NO_V)
    result = (
        F.when((F.size(vs) == 0) & (F.size(vals) == 0),
               branch(F.lit(0.0), no, F.lit("no_signal"), none, no_tracks))
        .when(F.size(ch) > 0, branch(
            F.least(one, _max_score(ch)), yes,
            F.concat_ws("_", F.lit("rule"), top_ch["rule_id"], top_ch["severity"]),
            F.slice(ch, 1, 5), involved(ch)))
        .when(F.size(vote) >= ML_VOTES, branch(
            F.least(one, _mean(vote)), yes, F.concat(F.lit("ml_vote_"), F.size(vote)),
            F.slice(vs, 1, 3), involved(vs)))
        .when(F.col("_best").isNotNull(), branch(
            -F.col("_best.s"), yes, F.concat(F.lit("ml_high_conf_"), F.col("_best.k")),
            F.slice(vs, 1, 3), involved(vs)))
        .when((F.size(med) > 0) & support, branch(
            F.least(one, (_max_score(med) + _mean(vals)) / 2), yes,
            F.lit("rule_medium_ml_support"), F.slice(med, 1, 3), involved(med)))
        .when(F.size(vs) > 0, branch(
            _max_score(vs), no, F.lit("below_threshold"), F.slice(vs, 1, 3), involved(vs)))
        .otherwise(branch(F.array_max(vals), F.array_max(vals) >= ALERT_AT, F.lit("ml_only"),
                          none, no_tracks))
    )
    return f.withColumn("_r", result).drop("_vs", "_ch", "_med", "_vote", "_best").select(
        "*", "_r.*").drop("_r").withColumnRenamed("_ml", "gated_scores")


def alert_candidates(scored: DataFrame) -> DataFrame:
    """Events a frame asks for before rate limiting."""
    s = F.col("final_score")
    wanted = (F.col("trigger") | (s >= ALERT_AT)) & (s >= ALERT_AT)
    return scored.where(wanted).withColumn("level", F.when(s >= ALARM_AT, "ALARM").otherwise("ALERT"))


_LIMITED = T.StructType([
    T.StructField("camera_id", T.LongType()), T.StructField("_g", T.LongType()),
    T.StructField("level", T.StringType())])


def limit_alarms(events: DataFrame, chunk: Column, t: str = "t", per_hour: int = ALARMS_PER_HOUR,
                 size: int = folds.FOLD_BLOCK) -> DataFrame:
    """Alarms beyond `per_hour` within an hour of each other become alerts (and do not count)."""
    alarms = events.where("level = 'ALARM'")
    runs = folds.reset_runs(alarms, ["camera_id"], [t, "event_id"], chunk,
                            F.col(t) + HOUR, F.col(t))

    def step(state, rows):
        recent = list(state.get("recent", []))
        levels = []
        for now in rows[t].to_numpy():
            recent = [x for x in recent if x > now - HOUR]
            ok = len(recent) < per_hour
            levels.append("ALARM" if ok else "ALERT")
            if ok:
                recent.append(float(now))
        return {"recent": recent}, pd.DataFrame({
            "camera_id": rows["camera_id"], "_g": rows["_g"], "level": levels})

    decided = folds.chained_fold(
        runs.select("camera_id", "_run", "_g", t), ["camera_id"], step, _LIMITED, size=size)
    limited = runs.drop("level", "_run").join(decided, ["camera_id", "_g"]).drop("_g")
    return events.where("level <> 'ALARM'").unionByName(limited)


def shadow_rows(scored: DataFrame, min_score: float = ALERT_AT) -> DataFrame:
    """Diagnostic rows: dropped only when score, violations and models are all silent."""
    quiet = ((F.col("final_score") < min_score)
             & (F.coalesce(F.size("violations"), F.lit(0)) <= 0) & (F.size("gated_scores") == 0))
    return scored.where(~quiet).withColumn("violations", F.slice(
        F.coalesce("violations", F.array().cast(_NO_V)), 1, 5))
