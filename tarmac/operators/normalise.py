"""Free-text model responses to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: accepted answers
STATES = ["free_flow", "congested", "incident", "stopped"]
RISKS = ["low", "medium", "high", "critical"]
ACCIDENTS = ["rear_end", "sideswipe", "rollover", "head_on", "fixed_object", "none"]
SEVERITIES = ["minor", "moderate", "severe", "fatal"]
T_CODES = [f"T{i}" for i in range(1, 14)]
SECTIONS = ["시간", "위치", "사고 특성", "피해차량", "인명피해", "차로 피해", "교통 영향", "추론"]
WEEKDAYS = ["월", "화", "수", "목", "금", "토", "일"]


def with_json(df: DataFrame, text: str) -> DataFrame:
    """Adds `json` and `doc` (variant): the object in a response's fenced block, whole text or
    outermost braces, else null. Does nothing when they are there already."""
    if "doc" in df.columns:
        return df
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    d = df.withColumn("_fenced", fenced)
    d = d.withColumn("_whole", F.trim(F.when(F.col("_fenced") != "", F.col("_fenced")).otherwise(F.col(text))))
    d = d.withColumn("_v", F.try_parse_json("_whole"))
    d = d.withColumn("_braces", F.when(F.col("_v").isNull(), F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    d = d.withColumn("doc", F.coalesce("_v", F.try_parse_json("_braces")))
    found = F.when(F.col("_v").isNotNull(), F.col("_whole")).when(F.col("doc").isNotNull(), F.col("_braces"))
    return d.withColumn("json", found).drop("_fenced", "_whole", "_v", "_braces")


def _added(df: DataFrame) -> list[str]:
    return [] if "doc" in df.columns else ["json", "doc"]


def _path(path: str) -> str:
    return f"${path}" if path.startswith("[") else f"$.{path}"


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("doc", _path(path), kind)


def kind_of(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("doc", _path(path), "variant"))


def text_of(path: str) -> Column:
    return F.coalesce(get(path), F.lit(""))


def one_of(path: str, allowed: list[str], default: str) -> Column:
    v = get(path)
    return F.when(v.isin(allowed), v).otherwise(default)


def is_list(path: str) -> Column:
    return F.coalesce(kind_of(path).startswith("ARRAY"), F.lit(False))


def list_of(path: str) -> Column:
    """JSON text of a list, [] for anything else."""
    return F.when(is_list(path), F.to_json(F.try_variant_get("doc", _path(path), "variant"))).otherwise("[]")


def truth(path: str, default: Column, words: bool = True) -> Column:
    """Booleans as they are; the words true, yes, 1 if allowed; anything else the default."""
    k, v = kind_of(path), F.lower(get(path))
    out = F.when(k == "BOOLEAN", get(path, "boolean"))
    if words:
        out = out.when(k == "STRING", v.isin("true", "yes", "1"))
    return out.otherwise(default)


def share(path: str, missing: float, broken: float) -> Column:
    """Number clamped to 0..1; separate defaults for absent and unreadable."""
    absent = F.try_variant_get("doc", _path(path), "variant").isNull()
    v = get(path).try_cast("double")
    ok = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.when(absent, missing).when(v.isNull(), broken).otherwise(ok)


def whole_in(path: str, low: int, high: int, default: int) -> Column:
    v = get(path).try_cast("double").cast("int")
    return F.when(v.between(low, high), v).otherwise(default)


def scene(df: DataFrame, text: str) -> DataFrame:
    d = with_json(df, text)
    bad = F.col("doc").isNull()
    return d.withColumns({
        "scene_description": F.when(bad, F.col(text)).otherwise(text_of("scene_description")),
        "traffic_state": one_of("traffic_state", STATES, "free_flow"),
        "anomalies": list_of("anomalies"),
        "risk_level": one_of("risk_level", RISKS, "low")}).drop(*_added(df))


def accident(df: DataFrame, text: str) -> DataFrame:
    d = with_json(df, text)
    bad = F.col("doc").isNull()
    d = d.withColumn("accident_detected", truth("accident_detected", F.lit(False)))
    seen = F.col("accident_detected")
    return d.withColumns({
        "confidence": share("confidence", 0.0, 0.0),
        "accident_type": F.when(seen, one_of("accident_type", ACCIDENTS, "none")).otherwise("none"),
        "severity": one_of("severity", SEVERITIES, "minor"),
        "involved_vehicles": F.when(seen, list_of("involved_vehicles")).otherwise("[]"),
        "timestamp_estimated": text_of("timestamp_estimated"),
        "reasoning": F.when(bad, F.col(text)).otherwise(text_of("reasoning")),
        "parse_error": bad}).drop(*_added(df))


def vehicle_class(df: DataFrame, text: str, vision: str) -> DataFrame:
    d = with_json(df, text)
    bad = F.col("doc").isNull()
    raw = get("corrected_class")
    tidy = F.trim(F.upper(raw))
    code = F.when(raw.isin(T_CODES), raw).when(tidy.isin(T_CODES), tidy).otherwise(F.col(vision))
    d = d.withColumn("corrected_class", F.when(bad, F.col(vision)).otherwise(code))
    same = F.col("corrected_class") == F.col(vision)
    return d.withColumns({
        "confidence": F.when(bad, 0.5).otherwise(share("confidence", 0.5, 0.5)),
        "unit_count": whole_in("unit_count", 1, 2, 1), "axle_count": whole_in("axle_count", 2, 6, 2),
        "vision_agreed": F.when(bad, True).otherwise(truth("vision_agreed", same)),
        "reasoning": F.when(bad, F.col(text)).otherwise(text_of("reasoning"))}).drop(*_added(df))


def outbreak(df: DataFrame, text: str) -> DataFrame:
    """Roadside incident analysis; blocked lanes become a lane -> state map."""
    d = with_json(df, text)
    bad = F.col("doc").isNull()
    lanes = F.from_json(list_of("blocked_lanes"), "array<string>")
    lane_map = F.when(F.size(lanes) > 0, F.map_from_arrays(
        F.transform(lanes, lambda n: F.concat(F.lit("차로_"), n)), F.transform(lanes, lambda _: F.lit("유"))))
    return d.withColumns({
        "weather": get("weather"), "blockage_type": get("blockage_type"), "lane_damage": lane_map,
        "vehicles": list_of("vehicles"), "facility_damage": list_of("facility_damage"),
        "fire": truth("fire", F.lit(False), False), "rollover": truth("rollover", F.lit(False), False),
        "cargo_spill": truth("cargo_spill", F.lit(False), False), "cause_estimated": get("cause_estimated"),
        "severity": get("severity"),
        "description": F.when(bad, F.col(text)).otherwise(get("description")),
        "confidence": F.when(bad, 0.3).otherwise(share("confidence", 0.5, 0.5))}).drop(*_added(df))


def accident_row(outbreaks: DataFrame) -> DataFrame:
    """Outbreak analysis plus capture metadata as accident-table rows."""
    return outbreaks.select(
        F.concat_ws("_", F.lit("OB"), F.date_format("analysed_at", "yyyyMMdd_HHmmss"),
                    F.coalesce("cctv_id", F.lit("unknown"))).alias("event_id"),
        F.coalesce("cctv_id", F.lit("")).alias("video_id"), "road_name", "direction",
        F.try_to_timestamp("incident_time", F.lit("yyyy-MM-dd HH:mm:ss")).alias("report_time"),
        "weather", F.lit("CCTV_outbreak").alias("report_source"),
        F.col("incident_type").alias("accident_type"), F.col("cause_estimated").alias("cause"), "fire",
        "rollover", F.col("cargo_spill").alias("spill"), "vehicles", "lane_damage", "severity",
        "blockage_type", "description", "facility_damage", F.lit("outbreak").alias("source"),
        F.col("confidence").alias("mllm_confidence"))


def report(df: DataFrame, text: str) -> DataFrame:
    """Eight-section report: location filled from road, direction, km and branch columns, source
    always CCTV, a skeleton carrying the text when there is no JSON."""
    d = with_json(df, text)
    bad = F.col("doc").isNull()

    def fill(path, col):
        v = F.nullif(get(path), F.lit(""))
        return F.coalesce(v, F.col(col).cast("string"), F.lit(""))

    present = F.array(*[F.when(F.try_variant_get("doc", f"$['{s}']", "variant").isNotNull(), s)
                        for s in SECTIONS])
    return d.withColumns({
        "sections": F.lit(len(SECTIONS)), "given_sections": F.when(bad, 0).otherwise(
            F.size(F.array_compact(present))),
        "line": fill("['위치']['노선명']", "road_name"), "way": fill("['위치']['방향']", "direction"),
        "km_post": fill("['위치']['이정']", "km"), "branch_name": fill("['위치']['사고 관할 지사']", "branch"),
        "reported_by": F.lit("CCTV"),
        "cause_primary": F.coalesce(get("['추론']['cause_primary']"), F.lit("")),
        "narrative": F.when(bad, F.col(text)).otherwise(
            F.coalesce(get("['추론']['narrative']"), F.lit(""))),
        "confidence": F.when(bad, 0.3).otherwise(share("['추론']['confidence']", 0.5, 0.5)),
        "needs_review": bad}).drop(*_added(df))


def vehicles_text(vehicles: Column) -> Column:
    """One line per array<struct<track_id,cls,role,speed>> entry. Fixed format."""
    def q(c):
        return F.coalesce(c.cast("string"), F.lit("?"))

    lines = F.transform(vehicles, lambda v: F.concat(
        F.lit("  - Track "), q(v["track_id"]), F.lit(": "), q(v["cls"]), F.lit(" ("), q(v["role"]),
        F.lit("), 속도 "), q(v["speed"]), F.lit(" km/h")))
    return F.when(F.size(vehicles) > 0, F.array_join(lines, "\n")).otherwise("정보 없음")


def tracks_text(tracks: Column, calibrated: Column) -> Column:
    """Track summary lines; speeds are hidden unless calibrated. Fixed format."""
    def q(c):
        return F.coalesce(c.cast("string"), F.lit("?"))

    lines = F.transform(tracks, lambda t: F.concat(
        F.lit("  - Track "), q(t["track_id"]), F.lit(": "), q(t["cls"]), F.when(
            calibrated, F.concat(F.lit(", 평균속도 "), q(t["speed"]), F.lit(" km/h")))
        .otherwise(", 평균속도 측정불가(미보정)")))
    return F.when(F.size(tracks) > 0, F.array_join(lines, "\n")).otherwise("없음")


def evaluate(results: DataFrame, by=()) -> DataFrame:
    """Latency and anomaly decisions against labels. Input: label, anomaly, latency, vehicles."""
    bad, hit = F.col("label") == "abnormal", F.col("anomaly")
    return results.groupBy(*by).agg(
        F.count("*").alias("clips"), F.avg("latency").alias("mean_latency"),
        F.count_if(F.col("vehicles") > 0).alias("with_vehicles"),
        F.count_if(bad & hit).alias("tp"), F.count_if(~bad & hit).alias("fp"),
        F.count_if(bad & ~hit).alias("fn"), F.count_if(~bad & ~hit).alias("tn"))
