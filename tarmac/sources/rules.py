"""Rule definitions: the built-in set and a YAML reader producing the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# fixed values: severity weights
SEVERITY = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.3}

# fixed values: the default rules
RULES = [
    {"id": "R1", "name": "sudden_braking", "label": "급정거", "severity": "HIGH", "type": "single",
     "feature": "acceleration", "operator": "<=", "threshold": -6.0,
     "filters": {"min_track_age": 5, "min_speed": 20.0}},
    {"id": "R2", "name": "wrong_way", "label": "역주행", "severity": "CRITICAL", "type": "single",
     "feature": "heading_deviation", "operator": ">=", "threshold": 150.0,
     "filters": {"min_track_age": 10, "persistence": 3}},
    {"id": "R3", "name": "long_stop", "label": "장기정지", "severity": "MEDIUM", "type": "single",
     "feature": "stop_duration", "operator": ">=", "threshold": 30.0,
     "filters": {"min_track_age": 30}},
    {"id": "R4", "name": "ttc_critical", "label": "TTC 임계", "severity": "HIGH", "type": "pair",
     "feature": "ttc_min", "operator": "<=", "threshold": 3.0},
    {"id": "R5", "name": "sudden_lane_change", "label": "급차로변경", "severity": "HIGH",
     "type": "single", "feature": "lateral_speed", "operator": ">=", "threshold": 3.0,
     "filters": {"min_track_age": 5, "min_speed": 30.0}},
    {"id": "R6", "name": "pedestrian_on_road", "label": "보행자 차도 진입", "severity": "CRITICAL",
     "type": "special", "handler": "pedestrian_road_intrusion", "filters": {"min_track_age": 3}},
    {"id": "R7", "name": "slow_wrong_direction", "label": "역방향 저속", "severity": "MEDIUM",
     "type": "single",
     "conditions": [{"feature": "heading_deviation", "operator": ">=", "threshold": 120.0},
                    {"feature": "speed_kmh", "operator": "<=", "threshold": 20.0}],
     "filters": {"min_track_age": 10}},
    {"id": "R8", "name": "sudden_acceleration", "label": "급가속", "severity": "LOW",
     "type": "single", "feature": "acceleration", "operator": ">=", "threshold": 4.0,
     "filters": {"min_track_age": 5}},
    {"id": "R9", "name": "cluster_braking", "label": "군집 급감속", "severity": "CRITICAL",
     "type": "group", "feature": "acceleration", "operator": "<=", "threshold": -4.0,
     "min_count": 3, "spatial_radius": 200.0},
    {"id": "R10", "name": "approach_stopped", "label": "정지 차량 접근", "severity": "HIGH",
     "type": "pair", "handler": "approach_stopped_vehicle",
     "params": {"stop_speed": 5.0, "ttc_threshold": 5.0}, "filters": {"min_track_age": 5}},
]

SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("operator", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("conditions", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("operator", T.StringType()),
        T.StructField("threshold", T.DoubleType())]))),
    T.StructField("handler", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("filters", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("min_count", T.IntegerType()), T.StructField("spatial_radius", T.DoubleType()),
])


def load_rules(path: str) -> list[dict]:
    """Rules from a YAML document with a top-level `rules` list."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return list((yaml.safe_load(f) or {}).get("rules", []))


def rules_frame(spark: SparkSession, rules: list[dict] = RULES) -> DataFrame:
    def num(d):
        return {k: float(v) for k, v in (d or {}).items()}

    rows = [(
        r["id"], r["name"], r["label"], r["severity"], r["type"], r.get("feature"),
        r.get("operator"), None if r.get("threshold") is None else float(r["threshold"]),
        [(c["feature"], c["operator"], float(c["threshold"])) for c in r["conditions"]]
        if r.get("conditions") else None,
        r.get("handler"), num(r.get("params")), num(r.get("filters")),
        int(r.get("min_count", 1)), float(r.get("spatial_radius", 200.0)),
    ) for r in rules]
    return spark.createDataFrame(rows, SCHEMA)
