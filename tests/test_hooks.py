"""User hooks: alert callbacks that survive a retried batch, and a user's embedder in search."""

import pytest
from pyspark.sql import functions as F

from tarmac.operators import retrieval
from tarmac.sinks import alerts
from tarmac.streaming import runs


def events(spark, lo, hi):
    rows = [(1 + i % 2, i, float(i), "ALARM" if i % 3 == 0 else "ALERT", 0.5 + i / 100, f"why {i}") for i in range(lo, hi)]
    return spark.createDataFrame(rows, "camera_id long, event_id long, t double, level string, final_score double, trigger_reason string")


def test_a_retried_batch_counts_once(spark, tmp_path):
    called, fail = [], [True]

    def on_alarm(rows):
        if fail and fail.pop():
            raise RuntimeError("the receiver is down")
        called.extend(r.t for r in rows.collect())

    run = alerts.handle_batch(str(tmp_path), {"ALARM": on_alarm})
    with pytest.raises(RuntimeError):
        run(events(spark, 0, 10), 0)
    for batch in (0, 0, 1):
        run(events(spark, 10 * batch, 10 * batch + 10), batch)
    log = alerts.read_log(spark, str(tmp_path)).collect()
    assert sorted(r.t for r in log) == [float(i) for i in range(20)]
    assert sorted(called) == [float(i) for i in range(20) if i % 3 == 0]
    assert log[0].details and "event_id" in log[0].details and log[0].involved_tracks is None


def test_alerts_of_a_stream(spark, tmp_path):
    feed = runs.shuffled_stream(events(spark, 0, 40).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)), "ts", files=2)
    seen = []
    q = alerts.write_alerts(feed, str(tmp_path / "a"), str(tmp_path / "c"), {"ALERT": lambda rows: seen.append(rows.count())}).trigger(availableNow=True).start()
    q.awaitTermination()
    log = alerts.read_log(spark, str(tmp_path / "a"))
    assert log.count() == 40 and sum(seen) == log.where("level = 'ALERT'").count() == 26
    assert log.select("batch_id").distinct().count() > 1


def test_a_user_embedder(spark):
    def embed(texts):
        return [[float(t.count(c)) for c in "abc"] if t else None for t in texts]

    q = retrieval.embed(spark.createDataFrame([(1, "aab"), (2, "ccc"), (3, None), (4, "aab")], "question_id long, question string"), "question", embed)
    assert {r.question_id: r.vector for r in q.collect()} == {1: [2.0, 1.0, 0.0], 2: [0.0, 0.0, 3.0], 3: None, 4: [2.0, 1.0, 0.0]}
    c = retrieval.embed(spark.createDataFrame([(7, "aaab"), (8, "c")], "chunk_id long, chunk_text string"), "chunk_text", embed, "embedding")
    got = {(r.question_id, r["rank"]): r.chunk_id for r in retrieval.vector_search(c, q.where("vector IS NOT NULL"), 1).collect()}
    assert got == {(1, 1): 7, (2, 1): 8, (4, 1): 7}
