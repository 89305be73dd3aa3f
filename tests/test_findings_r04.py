"""Faults found in review, fourth round: each case failed before its mend."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarmac.operators import clips, retrieval
from tarmac.session import stage
from tarmac.sinks import tables
from tarmac.streaming import live, runs


def plain(values):
    """Sum from left to right (Python's own sum corrects its errors)."""
    total = 0.0
    for v in values:
        total += v
    return total


def test_lane_changer_sums_movement_in_the_order_of_frames(spark):
    """of two tracks that move alike but for the last bit, the larger depended on how their rows lay in files."""
    rnd = random.Random(4)
    xs = {k: [rnd.randrange(50) / 50 for _ in range(60)] for k in range(40)}
    traj = spark.createDataFrame([(k, 7, f, x, f % 2 * 9.0) for k, v in xs.items() for f, x in enumerate(v)], "clip_id long, track_id long, frame long, x double, y double")
    for size in (64, 25):
        st = clips.steps(traj, size).withColumn("_o", F.xxhash64("frame", "clip_id")).repartition(7, "_o").sortWithinPartitions("_o")
        want = {}
        for k, v in xs.items():
            moves = [abs(b - a) for a, b in zip([v[0], *v], v)]
            want[k] = plain(plain(moves[at:at + size]) for at in range(0, 60, size))
        assert {r.clip_id: r.lat_total for r in clips.lane_changers(traj, size=size, st=st).collect()} == want


def test_promotions_of_a_group_of_cameras_settle_together(spark):
    """each camera was woken, read and stored by itself in each micro-batch, and each micro-batch read the whole feed."""
    holds = spark.sql("SELECT id % 5 AS cctv_id, id AS event_id, 1000000 + id * 9770 % 40009 AS start_t, 1000600 + id * 9770 % 40009 AS end_t FROM range(40)")
    rows = stage(holds.withColumn("ts", F.timestamp_seconds("start_t")))
    feed = runs.shuffled_stream(rows, "ts", late=300.0, beat="4 days", rows=10)
    got = sorted(tuple(r) for r in runs.drain(live.promotion_stream(feed, groups=2)).collect())
    want = []
    for cam in range(5):
        open_ = None
        for s, e in sorted((r.start_t, r.end_t) for r in rows.collect() if r.cctv_id == cam):
            if open_ and s <= open_[2]:
                open_ = [cam, open_[1], max(e, open_[2]), open_[3] + 1]
            else:
                want += [tuple(open_)] if open_ else []
                open_ = [cam, s, e, 1]
        want.append(tuple(open_))
    assert got == sorted(want) and len(want) > 5


def test_all_that_has_run_out_is_put_out_at_once():
    """a group put its ended promotions out one by one, with its state read and written for each."""
    class State:
        text, puts = None, 0

        def exists(self):
            return self.text is not None

        def get(self):
            return (self.text,)

        def update(self, row):
            self.text, self.puts = row[0], self.puts + 1

    fold = live.Promotions()
    fold.state = State()
    fold.step(pd.DataFrame({"cctv_id": range(50), "start_t": range(50), "end_t": range(600, 650)}))
    out = list(fold.settle(640_000.0))
    assert len(out) == 1 and out[0]["cctv_id"].tolist() == list(range(40)) and fold.state.puts == 2 and fold.due() == 641.0
    at = runs._millis(pd.Series([pd.Timestamp("2024-01-01 00:00:00.123456"), pd.NaT]))
    assert at[0] == pd.Timestamp("2024-01-01 00:00:00.123456").timestamp() * 1000 and np.isnan(at[1])


def test_tfidf_shuffles_no_postings_but_those_asked_for(spark):
    """all postings were shuffled four times and stored; those of frequent terms and of terms nobody asks for now stay where they are."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(40))) for i in range(300)] + [(7, "w1 w2 again"), (None, None)]
    corpus = spark.createDataFrame(docs, "chunk_id long, chunk_text string")
    counts = {}
    for i, t in docs:
        for w in (t or "").split():
            counts[i, w] = counts.get((i, w), 0) + 1
    assert {(r.chunk_id, r.term): r.tf for r in retrieval.term_counts(corpus).collect()} == counts
    unique = corpus.where("chunk_id <> 7")
    assert "Exchange" not in retrieval.term_counts(unique)._jdf.queryExecution().optimizedPlan().toString()
    asked = spark.createDataFrame([("w1",), ("w3",), ("nobody",)], "term string")
    lists, terms = retrieval.postings(unique, asked)
    assert {r.term for r in terms.collect()} == {"w1", "w3"} == {r.term for r in lists.select("term").distinct().collect()}
    questions = spark.createDataFrame([(1, "w1 w3 w44"), (2, "w2 w2 w90 w1"), (3, "none")], "question_id long, question string")
    rows = [sorted((r.question_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in retrieval.tfidf_search(unique, questions, 4, few=n, near=m).collect()) for n, m in ((200_000, 0), (6, 0), (200_000, 9), (6, 9))]
    assert all(r == rows[0] for r in rows) and len(rows[0]) == 12


def test_export_has_a_file_for_many_clips(spark, tmp_path):
    """each clip had a folder and a file of its own, whose making took 19 ms each."""
    boxes = spark.sql("SELECT id % 300 AS clip_id, id div 300 AS frame, id % 7 AS track_id, id * 1.5D AS x, 2.0D AS y, 0.0D AS w, 0.0D AS h, '차선 물기' AS driving FROM range(900)")
    rows = tables.trajectory_rows(boxes).withColumn("split", F.when(F.col("clip_id") % 3 == 0, "test").otherwise("train"))
    tables.write_trajectories(rows, f"{tmp_path}/export")
    assert len(list((tmp_path / "export").glob("split=*/clips=*/*.csv"))) == 4
    back = tables.read_trajectories(spark, f"{tmp_path}/export")
    assert sorted(map(tuple, back.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_questions_that_no_chunk_tells_apart_are_asked_once(spark):
    """each 20,000 questions met all chunks, however many of them differed in nothing that chunks have."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    chunks = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4)), rng.sample(["w1", "w5", "tail", ""], 2)) for i in range(80)], "chunk_id long, chunk_text string, keywords array<string>")
    asked = [(i, " ".join(rng.choices(words[:4], k=2) + [f"x{i}" * 9, rng.choice(["tail", "end"])])) for i in range(150)]
    asked += [(900 + i, t) for i, t in enumerate(["w1 w2", "w2 w3 w1 w1", " ".join(words[:4]), "W1 W2", "nothing", "w1", "?!", ""])]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    rows = [sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in retrieval.keyword_search(chunks, questions, 3, few=n, limit=50).collect()) for n in (10**6, 0)]
    assert rows[0] == rows[1] and len(rows[0]) > 300
    own, first = retrieval._one_of_each(retrieval.prepare_chunks(chunks), retrieval.prepare_questions(questions))
    assert own.count() == 157 and first.count() < 60
