"""Declarative rules compiled to Column predicates over averaged features."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators import motion
from tarmac.operators import sequence as seq
from tarmac.session import stage
from tarmac.sources.rules import RULES, SEVERITY

COMPARE = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt,
           "==": operator.eq}
HANDLERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
_ID = ["camera_id", "frame_idx"]


def register_handler(name: str, fn: Callable[[DataFrame, dict], DataFrame]) -> None:
    """Add a custom rule handler: (feature rows, rule) -> violation rows (see `violation`)."""
    HANDLERS[name] = fn


def compare(feature: str, op: str, threshold: float, suffix: str = "_ma") -> Column:
    return COMPARE[op](F.col(feature + suffix), F.lit(float(threshold)))


def passes_filters(rule: dict, suffix: str = "_ma") -> Column:
    f = rule.get("filters") or {}
    ok = F.col("track_age" + suffix) >= float(f.get("min_track_age", 0))
    if "min_speed" in f:
        ok = ok & (F.col("speed_kmh" + suffix) >= float(f["min_speed"]))
    return ok


def predicate(rule: dict) -> Column:
    if rule.get("conditions"):
        return reduce(operator.and_, [compare(c["feature"], c["operator"], c["threshold"])
                                      for c in rule["conditions"]])
    return compare(rule["feature"], rule["operator"], rule["threshold"])


def excess_score(rule: dict) -> Column:
    """Severity weight, raised by half of how far the value exceeds the threshold, at most 1."""
    base = SEVERITY.get(rule["severity"], 0.5)
    if not rule.get("feature") or not rule.get("threshold"):
        return F.lit(base)
    ratio = F.abs(F.col(rule["feature"] + "_ma") / float(rule["threshold"]))
    excess = F.greatest(F.lit(0.0), ratio - 1.0)
    return F.least(F.lit(1.0), F.lit(base) * (F.lit(1.0) + excess * 0.5))


def nearness_score(ttc: Column, limit: float, severity: str) -> Column:
    s = F.greatest(F.lit(0.0), F.lit(1.0) - ttc / limit)
    return F.least(F.lit(1.0), s * SEVERITY[severity])


def details(rule: dict) -> Column:
    parts = []
    if rule.get("feature"):
        parts += [F.lit(rule["feature"]), F.col(rule["feature"] + "_ma"),
                  F.lit("threshold"), F.lit(float(rule["threshold"]))]
    for c in rule.get("conditions") or []:
        if c["feature"] != "speed_kmh":
            parts += [F.lit(c["feature"]), F.col(c["feature"] + "_ma")]
    parts += [F.lit("speed_kmh"), F.col("speed_kmh_ma"),
              F.lit("track_age"), F.floor("track_age_ma").cast("double")]
    return F.create_map(*parts)


def violation(rule: dict, pos: int, score: Column, tracks: Column, extra: Column) -> Column:
    return F.struct(
        F.lit(rule["id"]).alias("rule_id"), F.lit(pos).alias("rule_pos"),
        F.lit(rule["name"]).alias("rule_name"), F.lit(rule["label"]).alias("label"),
        F.lit(rule["severity"]).alias("severity"),
        F.lit(SEVERITY[rule["severity"]]).alias("weight"), score.alias("score"),
        tracks.cast("array<bigint>").alias("involved_tracks"),
        extra.cast("map<string,double>").alias("details"),
    )


def track_violations(feats: DataFrame, rules: list[dict] = RULES,
                     size: int = seq.BLOCK) -> DataFrame:
    """Single-vehicle, TTC and pedestrian rules in one pass over the feature rows."""
    needed = 1
    for r in rules:
        needed = max(needed, int((r.get("filters") or {}).get("persistence", 1)))
    ma = motion.moving_average(feats, size=size, extra_halo=needed - 1)
    w = seq.block_window(motion.KEYS, "track_age")
    hits = []
    for pos, r in enumerate(rules):
        own = F.array("track_id")
        if r["type"] == "single":
            hit = passes_filters(r) & predicate(r)
            n = int((r.get("filters") or {}).get("persistence", 1))
            ma = ma.withColumn(f"_hit_{r['id']}", hit)
            run = reduce(operator.and_, [F.col(f"_hit_{r['id']}")] + [
                F.coalesce(F.lag(f"_hit_{r['id']}", i).over(w), F.lit(False)) for i in range(1, n)])
            ma = ma.withColumn(f"_hit_{r['id']}", run)
            v = violation(r, pos, excess_score(r), own, details(r))
        elif r.get("feature") == "ttc_min":
            ttc = F.col("ttc_min_ma")
            hit = passes_filters(r) & (ttc < motion.NO_TTC) & predicate(r)
            ma = ma.withColumn(f"_hit_{r['id']}", hit)
            v = violation(r, pos, nearness_score(ttc, float(r["threshold"]), r["severity"]), own,
                          F.create_map(F.lit("ttc"), ttc))
        elif r.get("handler") == "pedestrian_road_intrusion":
            ma = ma.withColumn(f"_hit_{r['id']}",
                               F.col("cls").isin("person", "pedestrian") & passes_filters(r, ""))
            v = violation(r, pos, F.lit(SEVERITY[r["severity"]]), own,
                          F.map_from_arrays(F.array(F.lit("pedestrian")), F.array(F.lit(1.0))))
        else:
            continue
        hits.append(F.when(F.col(f"_hit_{r['id']}"), v))
    found = seq.body(ma).select(*_ID, F.explode(F.array_compact(F.array(*hits))).alias("v"))
    return found.select(*_ID, "v.*")


def approach_stopped(feats: DataFrame, rule: dict, pos: int) -> DataFrame:
    """A moving vehicle about to reach a stopped one anywhere in the frame."""
    p = {"stop_speed": 5.0, "ttc_threshold": 5.0, **(rule.get("params") or {})}
    halted = (F.col("speed_kmh") <= p["stop_speed"]) & (F.col("stop_duration") >= 5.0)
    stopped = feats.where(halted).groupBy(*_ID).agg(
        F.min("track_id").alias("stopped_id"), F.count("*").alias("stopped_count"))
    hit = feats.where((F.col("speed_kmh") > p["stop_speed"]) & passes_filters(rule, "")
                      & (F.col("ttc_min") < p["ttc_threshold"])).join(stopped, _ID)
    v = violation(rule, pos, nearness_score(F.col("ttc_min"), p["ttc_threshold"], rule["severity"]),
                  F.array("track_id", "stopped_id"),
                  F.create_map(F.lit("ttc"), F.col("ttc_min"), F.lit("stopped_count"),
                               F.col("stopped_count").cast("double")))
    return hit.select(*_ID, v.alias("v")).select(*_ID, "v.*")


def greedy_clusters(items: Column, radius: float) -> Column:
    """Seeded clusters over array<struct<id,x,y>>: each unused item in turn gathers unused items
    within `radius` of itself. The array holds the violators of one frame."""
    init = F.struct(F.array().cast("array<bigint>").alias("used"),
                    F.array().cast("array<array<bigint>>").alias("clusters"))

    def absorb(acc, seed):
        near = F.filter(items, lambda o: ~F.array_contains(acc["used"], o["id"]) & (
            F.hypot(o["x"] - seed["x"], o["y"] - seed["y"]) <= radius))
        ids = F.transform(near, lambda o: o["id"])
        grown = F.struct(F.concat(acc["used"], ids).alias("used"),
                         F.concat(acc["clusters"], F.array(ids)).alias("clusters"))
        return F.when(F.array_contains(acc["used"], seed["id"]), acc).otherwise(grown)

    return F.aggregate(items, init, absorb, lambda acc: acc["clusters"])


def cluster_violations(feats: DataFrame, rule: dict, pos: int, size: int = seq.BLOCK) -> DataFrame:
    """At least `min_count` violators around one seed in the same frame."""
    ma = seq.body(motion.moving_average(feats, [rule["feature"]], size=size))
    bad = ma.where(predicate(rule)).groupBy(*_ID).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("track_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))))
        .alias("items"))
    need = int(rule["min_count"])
    c = bad.where(F.size("items") >= need).select(
        *_ID, F.explode(greedy_clusters(F.col("items"), rule["spatial_radius"])).alias("tracks"))
    n = F.size("tracks").cast("double")
    v = violation(rule, pos, F.least(F.lit(1.0), n / (need * 2)) * SEVERITY[rule["severity"]],
                  F.col("tracks"), F.create_map(F.lit("count"), n, F.lit("radius"),
                                                F.lit(float(rule["spatial_radius"]))))
    return c.where(F.size("tracks") >= need).select(*_ID, v.alias("v")).select(*_ID, "v.*")


def violations(feats: DataFrame, rules: list[dict] = RULES, size: int = seq.BLOCK) -> DataFrame:
    """Every violation of every rule."""
    feats = stage(feats)
    out = track_violations(feats, rules, size)
    for pos, r in enumerate(rules):
        if r.get("handler") == "approach_stopped_vehicle":
            out = out.unionByName(approach_stopped(feats, r, pos))
        elif r["type"] == "group":
            out = out.unionByName(cluster_violations(feats, r, pos, size))
        elif r.get("handler") in HANDLERS:
            out = out.unionByName(HANDLERS[r["handler"]](feats, {**r, "pos": pos}))
    return out


def by_frame(viol: DataFrame) -> DataFrame:
    """All violations of a frame as one ordered array."""
    row = F.struct("rule_id", "rule_pos", "label", "severity", "weight", "score",
                   "involved_tracks")
    grouped = viol.groupBy(*_ID).agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("weight")).alias("a"), F.col("rule_pos").alias("b"),
            F.col("involved_tracks").alias("c"), row.alias("v")))).alias("s"))
    return grouped.select(*_ID, F.transform("s", lambda x: x["v"]).alias("violations"))
