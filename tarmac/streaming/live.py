"""Health of streams, camera promotions and line counts as streams: folds for `runs.keyed_fold`.

Each keeps a small dict for a camera, puts a row out as soon as it can't change any more, and gives over all rows what the
table form gives (`episodes.failure_runs`, `incidents.merge_holds`, `flow.line_crossings` counted by period).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators import episodes, flow
from tarmac.streaming import runs

_KINDS = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def _schema(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


HEALTH = _schema("camera_id long, run long, failures long, first_t double, disabled_t double, disabled boolean, reprobe_t double")
HOLDS = _schema("cctv_id long, start_t long, end_t long, holds long")
COUNTS = _schema("camera_id long, period long, direction string, volume long, by_class string")


def _table(rows: list, schema: T.StructType) -> pd.DataFrame:
    doubles = {f.name: "float64" for f in schema.fields if isinstance(f.dataType, T.DoubleType)}  # also where all are null
    return pd.DataFrame(rows, columns=schema.names).astype(doubles)


def health_stream(health: DataFrame, limit: int = episodes.MAX_FAILURES, reprobe: float = episodes.REPROBE_SEC,
                  quiet_sec: float = 86_400.0, epoch: float = 0.0) -> DataFrame:
    """Failure runs of each camera, put out when a success ends them or nothing has been heard for `quiet_sec`.

    Input: camera_id, event_id, t (seconds since `epoch`), failed (null: not failed), ts. A run of `limit` failures disables the stream at
    that event, to be probed again after `reprobe`. `run` is the number of the run's first event of that camera.
    """

    def close(run: dict) -> tuple:
        off = run["off"]
        return run["cam"], run["at"], run["n"], run["t"], off, off is not None, None if off is None else off + reprobe

    def step(state, rows):
        n, run, out = state.get("n", 0), state.get("run"), []
        for cam, t, failed in zip(rows["camera_id"], rows["t"], rows["failed"]):
            n += 1
            if failed is True or failed == 1:
                run = run or {"cam": int(cam), "at": n, "n": 0, "t": float(t), "off": None}
                run["n"] += 1
                run["last"] = float(t)
                if run["n"] == limit:
                    run["off"] = float(t)
            elif run:
                out.append(close(run))
                run = None
        return {"n": n, "run": run}, _table(out, HEALTH)

    def finish(state):
        return {**state, "run": None}, _table([close(state["run"])] if state.get("run") else [], HEALTH)

    def due(state):
        return epoch + state["run"]["last"] + quiet_sec if state.get("run") else None

    return runs.keyed_fold(health, ["camera_id"], ["t", "event_id"], step, HEALTH, idle_sec=2 * quiet_sec, finish=finish, due=due)


class Promotions(runs.Fold):
    """Open promotions of the cameras of one group: {camera: [start, end, holds]}. All that have run out are put out at once."""

    def open(self, handle):
        self.state = handle.getValueState("state", "json string")

    def _get(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def step(self, rows):
        held, out = self._get(), []
        for cam, s, e in zip(rows["cctv_id"].tolist(), rows["start_t"].tolist(), rows["end_t"].tolist(), strict=True):
            s, e, own = int(s), int(e), held.get(key := str(int(cam)))
            if own and s <= own[1]:
                own[1], own[2] = max(own[1], e), own[2] + 1
            else:
                out += [(int(cam), *own)] if own else []
                held[key] = [s, e, 1]
        self.state.update((json.dumps(held),))
        return _table(out, HOLDS)

    def due(self):  # a hold that starts in the very second of the end still belongs to it
        return min((own[1] + 1.0 for own in self._get().values()), default=None)

    def settle(self, now):
        held = self._get()
        over = {cam: own for cam, own in held.items() if (own[1] + 1) * 1000 <= now}
        if over:
            self.state.update((json.dumps({cam: own for cam, own in held.items() if cam not in over}),))
            yield _table([(int(cam), *own) for cam, own in over.items()], HOLDS)

    def forget(self):
        self.state.clear()


def promotion_stream(holds: DataFrame, delay: str = runs.FEED_DELAY, groups: int = 256) -> DataFrame:
    """Promotions of each camera: overlapping or touching holds are one, put out when the last has run out and the camera is demoted.

    Input: cctv_id, event_id, start_t, end_t (whole seconds since 1970), ts (the start). Cameras are folded in `groups` groups (by a hash),
    as waking and storing a camera by itself costs far more than its holds of a micro-batch do.
    """
    group = F.when(F.col("cctv_id").isNotNull(), F.pmod(F.xxhash64("cctv_id"), F.lit(groups)))
    return runs.in_order(holds.withColumn("_group", group), ["_group"], ["start_t", "event_id"], Promotions(), HOLDS, delay=delay, idle_sec=86_400)


def line_counts(obs: DataFrame, y_line: float, band: tuple[float, float] | None = None, frames: int = 60, up: str = "방향A", down: str = "방향B",
                forget: int = 86_400, epoch: float = 0.0) -> DataFrame:
    """Vehicles over the counting line by direction, flushed once a period of `frames` frames; a track counts once in its life.

    The flush empties the counts alone: where tracks were and which have been counted stays, until a track has not been seen
    for `forget` frames. Input: camera_id, track_id, frame_idx, t (one second a frame, since `epoch`), cy, cls, ts.
    """

    def flush(cam, state, out):
        for direction, classes in sorted(state["counts"].items()):
            out.append((cam, state["period"], direction, sum(classes.values()), ",".join(f"{c}={n}" for c, n in sorted(classes.items()))))
        state["counts"] = {}

    def step(state, rows):
        state = state or {"tracks": {}, "counts": {}, "period": None, "swept": 0}
        tracks, out, cam = state["tracks"], [], None
        for cam, track, frame, y, kind in zip(rows["camera_id"], rows["track_id"], rows["frame_idx"], rows["cy"], rows["bucket"]):
            cam, frame, y, period = int(cam), int(frame), float(y), int(frame) // frames
            if period != state["period"]:
                flush(cam, state, out)
                state["period"] = period
            if frame - state["swept"] > forget:
                for k in [k for k, v in tracks.items() if frame - v[1] > forget]:
                    del tracks[k]
                state["swept"] = frame
            before, _, counted, seen = tracks.get(str(track), (None, frame, False, {}))
            if not counted:
                if kind:
                    seen[kind] = seen.get(kind, 0) + 1  # in order of first sight, which decides ties
                if before is not None and (before < y_line) != (y < y_line) and (band is None or band[0] <= y <= band[1]):
                    best = max(seen, key=seen.get) if seen else "미분류"
                    classes = state["counts"].setdefault(down if y > before else up, {})
                    classes[best] = classes.get(best, 0) + 1
                    counted, seen = True, {}
            tracks[str(track)] = [y, frame, counted, seen]
        return {**state, "cam": cam if cam is not None else state.get("cam")}, _table(out, COUNTS)

    def finish(state):
        out = []
        state = dict(state)
        flush(state["cam"], state, out)
        return state, _table(out, COUNTS)

    def due(state):
        return epoch + (state["period"] + 1) * frames if state.get("counts") else None

    rows = obs.withColumn("bucket", flow.bucket(F.col("cls")))
    return runs.keyed_fold(rows, ["camera_id"], ["frame_idx", "track_id"], step, COUNTS, idle_sec=forget, finish=finish, due=due)
