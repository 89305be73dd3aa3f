"""The trigger folds: cut anywhere they give the same, and each kind obeys its rule on a small case."""

import json
import random

import pandas as pd
import pytest

from tarmac.operators import triggers as N


def item(a, b=None, x=None, y=None, v=None):
    return {"a": a, "b": b, "x": x, "y": y, "v": v}


def rows(kind, frames):
    return pd.DataFrame([{"camera_id": 1, "type": kind, "frame_idx": k, "t": float(t), "items": i} for k, (t, i) in enumerate(frames)])


def run(df, size):
    state, out = {}, []
    for a in range(0, len(df), size):
        state, found = N.fold(json.loads(json.dumps(state)), df[a : a + size])
        out += [[*r[:5], round(r[5], 9), r[6]] for r in found.values.tolist()]
    return out


def frames(kind, rng, n=300):
    cars = {i: [rng.uniform(0, 900), rng.choice((-1, 1, 1, 1)) * rng.uniform(2, 9), 0.0] for i in range(7)}
    t = 0.0
    for _ in range(n):
        t += rng.choice((1, 1, 1, 5, 700 if rng.random() < 0.01 else 1))
        for c in cars.values():
            c[0] += c[1]
            c[2] = rng.choice((0.0, 2.0, 40.0)) if rng.random() < 0.1 else c[2]
        if kind == "T1":
            yield t, [item(a, b, a, b, rng.uniform(0.5, 2)) for a, b in ((1, 2), (2, 3), (4, 6)) if rng.random() < 0.7]
        elif kind == "T3":
            yield t, [item(i, v=c[2]) for i, c in cars.items() if rng.random() < 0.9]
        elif kind == "T4":
            yield t, [item(i, x=c[0], y=100.0 * i) for i, c in cars.items() if rng.random() < 0.9]
        else:
            yield t, [item(None, v=rng.gauss(50, 5))]


@pytest.mark.parametrize("kind", ["T1", "T3", "T4", "T6"])
def test_blocks_do_not_matter(kind):
    for seed in range(6):
        df = rows(kind, frames(kind, random.Random(seed)))
        whole = run(df, len(df))
        assert whole and all(run(df, size) == whole for size in (1, 7, 64))
        assert all(b[3] - a[3] >= N.COOLDOWN for a, b in zip(whole, whole[1:]))


def test_rules():
    band = [item(2, 5, 5, 2, 1.0)]
    fired = run(rows("T1", [(t, band) for t in (0, 1, 2)] + [(3, [])] + [(t, band) for t in range(4, 9)]), 99)
    assert [(r[2], r[4], r[5]) for r in fired] == [(7, [5, 2], 0.5)]
    fired = run(rows("T3", [(t, [item(9, v=0.0 if t else 30.0)]) for t in range(0, 20)]), 99)
    assert [(r[3], r[4]) for r in fired] == [(11.0, [9])]
    lanes = [(t, [item(i, x=(900 - 20 * t if i == 0 else 20.0 * t), y=50.0 * i) for i in range(5)]) for t in range(6)]
    assert [(r[3], r[4], r[5]) for r in run(rows("T4", lanes), 99)] == [(3.0, [0], 1.0)]
    flow = [(t, [item(None, v=50.0 + (t % 2) * 4)]) for t in range(20)] + [(20, [item(None, v=5.0)])]
    assert [r[3] for r in run(rows("T6", flow), 99)] == [20.0]


def test_batch_equals_stream(spark, small):
    from tarmac.plans import catalogue

    got = {tuple(r) for r in catalogue.QUERIES["trigger_detector"](spark, small).collect()}
    assert got and got == {tuple(r) for r in catalogue.QUERIES["trigger_stream"](spark, small).collect()}
