import random

from tarmac.operators.keyframes import nearest_frame


def test_nearest_frame_near_and_far(spark):
    rng = random.Random(2)
    frames = sorted({("a", rng.choice((rng.randrange(400), 5000 + rng.randrange(300), 90_000))) for _ in range(60)} | {("b", 7)})
    triggers = [(i, rng.choice("abc"), rng.randrange(100_000)) for i in range(200)] + [(500, "a", 256), (501, "b", 263)]
    want = {}
    for i, c, t in triggers:
        own = [x for k, x in frames if k == c]
        if own:
            want[i] = min((abs(x - t), x) for x in own)[1]
    f = spark.createDataFrame(frames, "camera_id string, frame_idx long")
    t = spark.createDataFrame(triggers, "event_id long, camera_id string, trigger_frame long")
    assert {r.event_id: r.frame_idx for r in nearest_frame(t, f, ["camera_id"]).collect()} == want
