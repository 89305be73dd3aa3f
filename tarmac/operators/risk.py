"""Accident-risk features, labels, levels and rankings per interchange and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.textjoin import contains_join

# fixed values: feature names
FEATURES = [
    "volume", "avg_speed", "speed_std", "truck_ratio", "speed_change_rate", "volume_change_rate",
    "risk_score", "risk_score_ma3", "anomaly_count", "trigger_ttc_count", "trigger_decel_count",
    "trigger_stop_count", "hour", "day_of_week", "is_weekend", "is_rush_hour",
    "ic_type_encoded", "hist_accident_rate", "hist_avg_volume",
]
CATEGORICAL = ["is_weekend", "is_rush_hour", "ic_type_encoded", "hour", "day_of_week"]
# fixed values: point types and risk cut-offs
POINT_TYPES = {"IC": 0, "JC": 1, "TG": 2, "SA": 3, "본선": 4}
LEVELS = [(0.7, "critical"), (0.5, "high"), (0.3, "medium")]
LABEL_SEC = 1800
HISTORY_DAYS = 30


def risk_level(p: Column) -> Column:
    out = F.when(p >= LEVELS[0][0], LEVELS[0][1])
    for at, name in LEVELS[1:]:
        out = out.when(p >= at, name)
    return out.otherwise("low")


def traffic_part(agg: DataFrame, seconds: int, compat_lookahead: bool = False) -> DataFrame:
    """Change against the mean of the previous three periods and the three-period risk mean."""
    w = Window.partitionBy("ic_name").orderBy("period_start")
    prev = w.rowsBetween(-3, -1)
    zero = F.lit(0.0)

    def change(c):
        base = F.avg(F.coalesce(F.col(c), zero)).over(prev)
        return F.when(base > 0, (F.col(c) - base) / base).otherwise(zero)

    risk = F.coalesce("risk_score", zero)
    ma = F.avg(risk).over(w.rowsBetween(-2, 0))
    if compat_lookahead:
        touching = F.lead("period_start").over(w) == F.col("period_start") + seconds
        ma = F.when(touching, F.avg(risk).over(w.rowsBetween(-1, 1))).otherwise(ma)
    return agg.select(
        "ic_name", "period_start",
        *[F.coalesce(F.col(c), zero).cast("double").alias(c)
          for c in ("volume", "avg_speed", "speed_std", "truck_ratio")],
        change("avg_speed").alias("speed_change_rate"), change("volume").alias("volume_change_rate"),
        risk.alias("risk_score"), ma.alias("risk_score_ma3"))


def response_part(responses: DataFrame, videos: DataFrame, seconds: int) -> DataFrame:
    """Model responses counted per interchange and period.

    Responses are counted per video and period before the interchange of the video is looked up.
    Input: responses(video_id, created_t, trigger_type, is_anomaly), videos(ic_name, video_id).
    """
    r = responses.groupBy(
        "video_id", (F.floor(F.col("created_t") / seconds) * seconds).alias("period_start")).agg(
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if(F.col("trigger_type") == "T1").alias("trigger_ttc_count"),
        F.count_if(F.col("trigger_type") == "T2").alias("trigger_decel_count"),
        F.count_if(F.col("trigger_type") == "T3").alias("trigger_stop_count"))
    names = ["anomaly_count", "trigger_ttc_count", "trigger_decel_count", "trigger_stop_count"]
    return (r.join(videos.select("ic_name", "video_id").distinct(), "video_id")
            .groupBy("ic_name", "period_start")
            .agg(*[F.sum(n).cast("double").alias(n) for n in names]))


def time_part(period_start: Column) -> list[Column]:
    ts = F.timestamp_seconds(period_start)
    hour, day = F.hour(ts), F.weekday(ts)
    rush = (day < 5) & (hour.between(7, 9) | hour.between(17, 19))
    return [hour.cast("double").alias("hour"), day.cast("double").alias("day_of_week"),
            (day >= 5).cast("double").alias("is_weekend"), rush.cast("double").alias("is_rush_hour")]


def accident_links(accidents: DataFrame, ics: DataFrame) -> DataFrame:
    """Accidents of each interchange: same road name, or its name inside the event id."""
    a = accidents.select("event_id", "road_name", "report_t", "point_type")
    names = ics.select("ic_name").distinct()
    same = a.join(names, a.road_name == names.ic_name)
    inside = contains_join(a, "event_id", names, "ic_name")
    cols = ["ic_name", "event_id", "report_t", "point_type"]
    return same.select(*cols).unionByName(inside.select(*cols)).distinct()


def place_part(agg: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    n = agg.groupBy("ic_name").agg(
        F.count("*").alias("periods"),
        F.coalesce(F.avg(F.when(F.col("period_start") >= now - HISTORY_DAYS * 86_400, F.col("volume"))),
                   F.lit(0.0)).alias("hist_avg_volume"))
    acc = links.groupBy("ic_name").agg(
        F.count("*").alias("accidents"), F.min_by("point_type", "event_id").alias("point_type"))
    codes = F.create_map(*[x for k, v in POINT_TYPES.items() for x in (F.lit(k), F.lit(float(v)))])
    fallback = F.pmod(F.crc32(F.col("ic_name").cast("binary")), F.lit(len(POINT_TYPES))).cast("double")
    return n.join(acc, "ic_name", "left").select(
        "ic_name", F.coalesce(F.try_element_at(codes, F.col("point_type")), fallback)
        .alias("ic_type_encoded"),
        (F.coalesce("accidents", F.lit(0)) / F.greatest("periods", F.lit(1))).alias("hist_accident_rate"),
        "hist_avg_volume")


def features(agg: DataFrame, responses: DataFrame, videos: DataFrame, accidents: DataFrame,
             seconds: int, now: Column, compat_lookahead: bool = False) -> DataFrame:
    """All nineteen features of every (interchange, period)."""
    t = traffic_part(agg, seconds, compat_lookahead)
    r = response_part(responses, videos, seconds)
    links = accident_links(accidents, agg)
    out = t.join(r, ["ic_name", "period_start"], "left").fillna(0.0)
    out = out.join(place_part(agg, links, now), "ic_name")
    return out.select("ic_name", "period_start", *[
        c for c in out.columns if c not in ("ic_name", "period_start")],
        *time_part(F.col("period_start"))).select("ic_name", "period_start", *FEATURES)


def labels(agg: DataFrame, links: DataFrame, seconds: int, within: int = LABEL_SEC) -> DataFrame:
    """1 when an accident happens in [start, start + 30 min).

    Each accident names the few aligned period starts it can label, so this is an equi-join.
    """
    back = F.sequence(F.lit(0), F.lit((within - 1) // seconds))
    s = links.select("ic_name", "report_t", F.explode(back).alias("k")).select(
        "ic_name", "report_t",
        ((F.floor(F.col("report_t") / seconds) - F.col("k")) * seconds).alias("period_start"))
    hit = s.where(F.col("report_t") < F.col("period_start") + within).select(
        "ic_name", "period_start").distinct().withColumn("label", F.lit(1))
    return agg.select("ic_name", "period_start").join(
        hit, ["ic_name", "period_start"], "left").fillna(0, ["label"])


def top_factors(k: int = 3) -> Column:
    """The k continuous features of largest magnitude, in feature order on ties."""
    names = [f for f in FEATURES if f not in CATEGORICAL]
    items = F.array(*[F.struct((-F.abs(F.col(n))).alias("o"), F.lit(i).alias("i"),
                               F.lit(n).alias("feature"), F.col(n).alias("value"))
                      for i, n in enumerate(names)])
    return F.transform(F.slice(F.array_sort(items), 1, k),
                       lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value")))


def latest(df: DataFrame, keys, order: str = "period_start") -> DataFrame:
    """The row with the largest `order` of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def score_places(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Each interchange's latest period by a trained model's probability, riskiest first: risk_score, risk_level, factors, rank.

    `scored` holds the features and the model's `prob` of every period, as `learners.predict` gives them.
    """
    t = latest(scored, ["ic_name"])
    rank = F.row_number().over(Window.orderBy(F.desc(prob), "ic_name"))  # one row per interchange
    return t.select("ic_name", "period_start", F.col(prob).alias("risk_score"), risk_level(F.col(prob)).alias("risk_level"),
                    top_factors().alias("factors"), rank.alias("rank"))


def heatmap(feats: DataFrame) -> DataFrame:
    """Latest period of every (interchange, hour of day)."""
    h = feats.withColumn("hour_of_day", F.hour(F.timestamp_seconds("period_start")))
    return latest(h, ["ic_name", "hour_of_day"])


def report(ranking: DataFrame, heat: DataFrame) -> DataFrame:
    """One row: counts by level and the ranking and heat map as JSON. One entry per interchange."""
    r = ranking.agg(
        F.count("*").alias("total_ics"), F.count_if(F.col("risk_level") == "critical")
        .alias("critical_count"), F.count_if(F.col("risk_level") == "high").alias("high_count"),
        F.to_json(F.sort_array(F.collect_list(F.struct(
            (-F.col("risk_score")).alias("order"), "ic_name", "risk_score", "risk_level"))))
        .alias("rankings"))
    h = heat.agg(F.count("*").alias("heat_cells"), F.to_json(F.sort_array(F.collect_list(
        F.struct("ic_name", "hour_of_day", "risk_score")))).alias("heatmap"))
    return r.join(h)
