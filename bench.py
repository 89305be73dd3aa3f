"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarmac.plans import catalogue  # noqa: E402
from tarmac.session import local_session  # noqa: E402

HEADLINE = [
    "traffic_flow", "traffic_by_direction", "motion_features", "pair_ttc", "neighbours_gaps",
    "rule_violations", "ensemble_alerts", "trigger_cooldown", "trigger_consensus", "recording_episodes",
    "speed_variance", "incident_camera_radius", "nearest_cameras", "incident_verify", "risk_features",
    "clip_kinematics", "blink_score", "keyword_search", "vector_search", "tfidf_search",
    "question_routing", "response_normalise", "threshold_search", "recording_health",
    "hybrid_search", "batch_qa", "trigger_detector", "incident_groups", "pair_ttc_world", "change_frames",
    "collection_outcomes", "feature_state_stream", "retention_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = 2 * int(cpus) if cpus.isdigit() else 16
    spark = local_session(cpus, parts, "bench")
    spark.sparkContext.setLogLevel("OFF")
    catalogue.QUERIES["distinct_keys"](spark, sf_dir).count()  # start the workers before the clock
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
