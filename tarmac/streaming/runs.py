"""Streaming forms of the flow, de-duplication and stateful operators."""

from __future__ import annotations

import json
import math
import pickle
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarmac.operators import ensemble, episodes, flow, motion
from tarmac.session import shared_dir, stage

FRAME_DELAY, FEED_DELAY = "10 seconds", "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, into a table of the shared folder, and read it."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def heartbeat(stream: DataFrame, after: str, like: DataFrame) -> DataFrame:
    """`stream` and one more row, empty but for a `ts` that lies `after` the last of the table `like`.

    The end of a bounded source closes nothing by itself; a beat past it lets the watermark close the
    last windows and timers, as a live feed's next rows would.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/beat-{uuid.uuid4().hex}"
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != "ts"]
    row = like.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {after}")).alias("ts"), *fields)
    row.select(*stream.columns).write.parquet(path)
    return stream.union(spark.readStream.schema(stream.schema).parquet(path))


def shuffled_stream(df: DataFrame, order: str, parts: int = 3, late: float = 0.0, beat: str | None = None, files: int = 4, rows: int = 2_000_000) -> DataFrame:
    """A table as a file stream of about `parts` micro-batches by the time column `order`, `files` files each.

    A longer table has more of them, of about `rows` rows each: what a task holds of a key grows with its micro-batch.
    Rows are held back by up to `late` seconds (by a hash of the row), so that they arrive out of order and across
    batches as a feed's do. With `beat` a last batch has one row, empty but for a time so long after the others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    seconds = F.unix_micros(order) / 1e6
    arrival = seconds + F.pmod(F.xxhash64(*df.columns), F.lit(1000)) / 1000 * late
    lo, hi, count = df.agg(F.min(seconds), F.max(seconds), F.count("*")).first()
    parts = max(parts, -(-count // rows))
    width = ((hi or 0) + late - (lo or 0)) / parts + 1e-6
    n = df.withColumn("_batch", F.floor((arrival - (lo or 0)) / width).cast("int"))
    if beat:
        # an inner or outer join drops rows without a key before they can move the watermark, so texts are empty, not null
        rest = [F.lit("" if f.dataType == T.StringType() else None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != order]
        last = df.agg((F.max(order) + F.expr(f"INTERVAL {beat}")).alias(order)).select(order, *rest).select(*df.columns)
        n = n.union(last.withColumn("_batch", F.lit(parts)))
    n = stage(n, "_batch")  # a folder each, so that a micro-batch is read without the others
    for k in range(parts + bool(beat)):
        n.where(F.col("_batch") == k).drop("_batch").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def traffic_flow(stream: DataFrame, seconds: int, delay: str = FEED_DELAY) -> DataFrame:
    """Interval flow: first sighting per track and window, then the window's totals (append)."""
    w = F.window("ts", f"{seconds} seconds")
    first = stream.withWatermark("ts", delay).groupBy(w, "ic_name", "track_id").agg(
        F.min_by(F.struct("speed", "vehicle_cls"), F.struct("ts", "event_id")).alias("f"))
    rows = first.select("window", "ic_name", "track_id", F.col("f.speed").alias("speed"),
                        F.col("f.vehicle_cls").alias("vehicle_cls"))
    out = flow.flow_of(rows, ("window", "ic_name"))
    return out.select("ic_name", F.unix_seconds("window.start").alias("period_start"), "volume",
                      "avg_speed", "speed_std", "truck_ratio")


def late_rows(batch: DataFrame, watermark_ms: int) -> DataFrame:
    """Rows of a micro-batch older than the watermark, for a side table written by foreachBatch."""
    return batch.where(F.unix_millis("ts") < watermark_ms)


def first_seen(stream: DataFrame, key: Sequence[str], ttl: str = "24 hours") -> DataFrame:
    """Feed rows whose key has not been seen within `ttl`."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(list(key))


def _millis(ts: pd.Series) -> pd.Series:
    """Milliseconds since 1970; null: NaN."""
    at = pd.to_datetime(ts, utc=True)
    us = at.dt.tz_localize(None).to_numpy("datetime64[us]").astype("int64") / 1000
    return pd.Series(us, index=ts.index).where(at.notna())


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then folds them in the order of their time.

    What is held is a list state, one packed piece for each micro-batch; the fold keeps its own state. One event-time timer a key
    wakes it for the earliest of: the next held row, what the fold says is due, the time at which a silent key is forgotten.
    Rows without a key (a heartbeat) only move the watermark.
    """

    def __init__(self, fold: Fold, order: Sequence[str], idle_sec: float) -> None:
        self.fold, self.order, self.idle = fold, list(order), int(idle_sec * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.seen = handle.getValueState("seen", "last_ms long")
        self.fold.open(handle)

    def handleInputRows(self, key, rows, timerValues):
        pieces = list(rows)
        if any(k is None or k != k for k in key) or not pieces:
            return
        new = pd.concat(pieces, ignore_index=True)
        last = int(new["ts"].max().timestamp() * 1000)
        if self.seen.exists():
            last = max(last, self.seen.get()[0])
        self.seen.update((last,))
        yield from self._release(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release(None, timerValues)

    def close(self) -> None:
        pass

    def _release(self, new, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        old = [pickle.loads(r[0]) for r in self.held.get()] if self.held.exists() else []
        rows = pd.concat([*old, *([] if new is None else [new])], ignore_index=True) if old or new is not None else None
        next_ms = None
        if rows is not None:
            at = _millis(rows["ts"])
            ready = at <= now
            if ready.any():
                yield self.fold.step(rows[ready].sort_values(self.order, kind="stable"))
            rest = rows[~ready]
            if len(rest):
                if ready.any() or len(old) > 8:
                    self.held.put([(pickle.dumps(rest, 5),)])
                else:
                    self.held.appendValue((pickle.dumps(new, 5),))
                next_ms = int(np.ceil(at[~ready].min()))
            else:
                self.held.clear()
        yield from self.fold.settle(now)
        due = self.fold.due()
        last = self.seen.get()[0] if self.seen.exists() else now
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if next_ms is None and due is None and now >= last + self.idle:
            self.seen.clear()
            self.fold.forget()
            return
        wake = min(x for x in (next_ms, None if due is None else int(np.ceil(due * 1000)), last + self.idle) if x is not None)
        self.handle.registerTimer(max(wake, now + 1))


class Settle(StatefulProcessor):
    """Holds a key's rows, one packed piece for each micro-batch, until the watermark has passed the key's end; then `settle` makes its rows of them."""

    def __init__(self, settle, end) -> None:
        self.settle, self.end = settle, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        self.held.appendValue((pickle.dumps(new, 5),))
        self.handle.registerTimer(max(int(self.end(key[0]) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            rows = pd.concat([pickle.loads(r[0]) for r in self.held.get()], ignore_index=True)
            self.held.clear()
            yield self.settle(rows)

    def close(self) -> None:
        pass


def settled(stream: DataFrame, key: str, settle: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str, end: Callable[[object], float]) -> DataFrame:
    """`settle` of all rows of each key, once the stream's watermark has passed `end(key)` (seconds since 1970)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(Settle(settle, end), out_schema, "Append", "EventTime")


class Fold:
    """What InOrder folds with. Times are seconds since 1970."""

    def open(self, handle: StatefulProcessorHandle) -> None: ...

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def due(self) -> float | None:
        """When something ends by itself, if anything does."""

    def finish(self, at: float) -> pd.DataFrame:
        raise NotImplementedError

    def settle(self, now: float):
        """The rows of all that has ended by itself by `now` (milliseconds since 1970)."""
        due = self.due()
        while due is not None and due * 1000 <= now:
            yield self.finish(due)
            due = self.due()

    def forget(self) -> None: ...


class DictFold(Fold):
    """Folds by functions on a dict that JSON can hold."""

    def __init__(self, step, names, finish=None, due=None) -> None:
        self._step, self._names, self._finish, self._due = step, names, finish, due

    def open(self, handle):
        self.state = handle.getValueState("state", "json string")

    def _get(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def step(self, rows):
        st, out = self._step(self._get(), rows)
        self.state.update((json.dumps(st),))
        return out[self._names]

    def due(self):
        return self._due(self._get()) if self._due and self._finish else None

    def finish(self, at):
        st, out = self._finish(self._get())
        self.state.update((json.dumps(st),))
        return out[self._names]

    def forget(self):
        self.state.clear()


def in_order(stream: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, out_schema: T.StructType,
             *, delay: str = FRAME_DELAY, idle_sec: float = 600.0) -> DataFrame:
    """Fold each key's rows (event time `ts`) in order, also when they come up to `delay` late and in other micro-batches;
    a key silent for `idle_sec` of event time is forgotten."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(
        InOrder(fold, order, idle_sec), out_schema, "Append", "EventTime")


def keyed_fold(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str],
    step: Callable[[dict, pd.DataFrame], tuple[dict, pd.DataFrame]], out_schema: T.StructType,
    *, delay: str = FRAME_DELAY, idle_sec: float = 600.0,
    finish: Callable[[dict], tuple[dict, pd.DataFrame]] | None = None, due: Callable[[dict], float | None] | None = None,
) -> DataFrame:
    """`in_order` with a dict as state, by plain functions.

    `due(state)` may name a time (seconds since 1970) at which something ends by itself: then
    `finish(state)` gives the state after it and the rows to put out.
    """
    names = [f.name for f in out_schema.fields]
    return in_order(stream, keys, order, DictFold(step, names, finish, due), out_schema, delay=delay, idle_sec=idle_sec)


EPISODE = T.StructType([
    T.StructField("camera_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("type", T.StringType()), T.StructField("start_t", T.DoubleType()),
    T.StructField("end_t", T.DoubleType()), T.StructField("seconds", T.DoubleType())])


def episode_step(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Recordable triggers of one camera to finished recordings."""
    E = episodes
    open_, idle_from, seen, out = state.get("open"), state.get("idle", -1e18), state.get("seen", []), []

    def close():
        nonlocal open_, idle_from
        out.append((open_["cam"], open_["id"], open_["type"], open_["t"], open_["end"], open_["end"] - open_["t"]))
        idle_from, open_ = open_["end"] + E.RECORD_COOLDOWN, None

    for r in rows.itertuples():
        t = float(r.t)
        if open_ is not None and t >= open_["end"]:
            close()
        if open_ is not None:
            open_["end"] = min(open_["end"] + E.RECORD_EXTEND, open_["t"] + E.RECORD_MAX)
            continue
        if t < idle_from:
            continue
        seen = [s for s in seen if s[0] > t - E.CONSENSUS_SEC] + [[t, r.type]]
        if r.type in E.INSTANT_TYPES or len({s[1] for s in seen}) >= E.CONSENSUS_TYPES:
            open_ = {"cam": int(r.camera_id), "id": int(r.event_id), "type": r.type, "t": t,
                     "end": t + E.RECORD_MIN}
            seen = []
    return ({**state, "open": open_, "idle": idle_from, "seen": seen},
            pd.DataFrame(out, columns=[f.name for f in EPISODE.fields]))


def episode_due(epoch: float) -> Callable[[dict], float | None]:
    """When the open recording of a state ends; trigger times count from `epoch`."""
    return lambda state: epoch + state["open"]["end"] if state.get("open") else None


def episode_finish(state: dict) -> tuple[dict, pd.DataFrame]:
    """The open recording, ended by time."""
    o, out = state.get("open"), []
    if o:
        out = [(o["cam"], o["id"], o["type"], o["t"], o["end"], o["end"] - o["t"])]
        state = {**state, "open": None, "idle": o["end"] + episodes.RECORD_COOLDOWN}
    return state, pd.DataFrame(out, columns=[f.name for f in EPISODE.fields])


FEATURE_ROWS = T.StructType([*(T.StructField(c, T.LongType()) for c in ("camera_id", "track_id", "frame_idx")),
                             *(T.StructField(c, T.DoubleType()) for c in motion.FEATURES)])
_TRACK = "t double, cx double, cy double, w double, h double, speed double, heading double, stop_t double, age long"


class FeatureFold(Fold):
    """All fifteen features of the vehicles of one camera, frame by frame, as `motion.features` gives them for tables.

    State: the last place, size, speed, heading and standing time of each track (forgotten after `idle_sec` without a
    sighting) and the mean speeds of the last frames.
    """

    def __init__(self, dt: float = 1.0, idle_sec: float = 600.0) -> None:
        self.dt, self.idle = dt, idle_sec

    def open(self, handle):
        self.tracks = handle.getMapState("tracks", "track_id long", _TRACK)
        self.flow = handle.getListState("flow", "mean double")
        self.swept = handle.getValueState("swept", "t double")

    def step(self, rows):
        means = [r[0] for r in self.flow.get()] if self.flow.exists() else []
        known, out = {}, []
        for i in rows["track_id"].unique().tolist():
            if self.tracks.containsKey((i,)):
                known[i] = tuple(self.tracks.getValue((i,)))
        for frame, g in rows.groupby("frame_idx", sort=False):
            out += self._frame(int(g["camera_id"].iloc[0]), int(frame), g, known, means)
            del means[: -motion.FLOW_FRAMES]
        for i, v in known.items():
            self.tracks.updateValue((i,), v)
        self.flow.put([(m,) for m in means])
        now = float(rows["t"].max())
        swept = self.swept.get()[0] if self.swept.exists() else now
        if now - swept >= self.idle:
            for (i,), v in list(self.tracks.iterator()):
                if v[0] < now - self.idle:
                    self.tracks.removeKey((i,))
        if now - swept >= self.idle or not self.swept.exists():
            self.swept.update((now,))
        return pd.DataFrame(out, columns=FEATURE_ROWS.names)

    def _frame(self, camera, frame, g, known, means):
        ids = g["track_id"].tolist()
        t, x, y, w, h, x1, x2 = (g[c].to_numpy(float) for c in ("t", "cx", "cy", "w", "h", "x1", "x2"))
        n = len(ids)
        blank = (np.nan,) * 8 + (0,)
        old = [known.get(i) or blank for i in ids]
        pt, px, py, pw, ph, pv, head, stop = np.array([[np.nan if c is None else c for c in o[:8]] for o in old], float).T
        age = np.array([o[8] for o in old]) + 1
        first = age == 1
        dx, dy = x - px, y - py
        speed = np.where(first, 0.0, np.hypot(dx, dy) * motion.METRES_PER_PIXEL / self.dt * 3.6 if self.dt > 0 else 0.0)
        small = (np.abs(dx) < 0.5) & (np.abs(dy) < 0.5)
        deg = np.degrees(np.array([math.atan2(a, -b) for a, b in zip(dx, dy)]))  # as motion.c_float; numpy's may differ
        heading = np.where(first, 0.0, np.where(small, head, np.where(deg < 0, deg + 360, deg)))
        halted = speed <= motion.STOP_KMH
        stop = np.where(halted, np.where(first | (pv > motion.STOP_KMH), t, stop), np.nan)
        fx, fy = np.sin(np.radians(heading)), -np.cos(np.radians(heading))
        along = dx * fx + dy * fy
        turn = np.abs(heading - head)
        s, c = fx.sum(), -fy.sum()
        mean = np.degrees(np.arctan2(s - fx, c + fy))
        off = np.abs(heading - np.where(mean < 0, mean + 360, mean))
        with np.errstate(divide="ignore", invalid="ignore"):
            area = np.where(pw * ph > 0, (w * h - pw * ph) / (pw * ph) * 100, 0.0)
            aspect = np.where(h > 0, w / h, 1.0)
        gx, gy = x[None, :] - x[:, None], y[None, :] - y[:, None]  # from row to column; a frame holds what a camera sees
        d = np.hypot(gx, gy)
        ahead = gx * fx[:, None] + gy * fy[:, None]
        other = ~np.eye(n, dtype=bool) & (d <= motion.GAP_RANGE_PX)
        gap = lambda ok: np.where(other & ok, d, motion.NO_GAP).min(1)
        ttc = self._contact(np.array(ids), first, x, y, px, py, t, pt, x1, x2, w)
        flow = speed - (np.mean(means) if means else speed)
        cols = {"speed_kmh": speed, "acceleration": np.where(first, 0.0, (speed / 3.6 - pv / 3.6) / self.dt), "heading": heading,
                "heading_change": np.where(first, 0.0, np.where(turn > 180, 360 - turn, turn)),
                "heading_deviation": np.where(off > 180, 360 - off, off) if n > 3 else np.zeros(n),
                "lateral_speed": np.where(first, 0.0, np.hypot(dx - along * fx, dy - along * fy)), "ttc_min": ttc,
                "gap_front": gap(ahead > 0), "gap_rear": gap(ahead < 0), "speed_diff_flow": flow,
                "stop_duration": np.where(halted, t - stop, 0.0), "area_change_rate": area, "aspect_ratio": aspect,
                "track_age": age.astype(float), "neighbor_count": (other & (d <= motion.NEIGHBOUR_RADIUS_PX)).sum(1).astype(float)}
        for k, i in enumerate(ids):
            known[i] = (t[k], x[k], y[k], w[k], h[k], speed[k], heading[k], None if np.isnan(stop[k]) else stop[k], int(age[k]))
            known[i] = tuple(v if v is None else (int(v) if j == 8 else float(v)) for j, v in enumerate(known[i]))
        means.append(float(speed.mean()))
        return [(camera, i, frame, *(float(cols[c][k]) for c in motion.FEATURES)) for k, i in enumerate(ids)]

    def _contact(self, ids, first, x, y, px, py, t, pt, x1, x2, w):
        least = np.full(len(ids), np.inf)
        a, b = np.nonzero((ids[:, None] < ids[None, :]) & ~first[:, None] & ~first[None, :])
        width = np.minimum(w[a], w[b])
        over = np.maximum(0.0, np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b]))
        with np.errstate(divide="ignore", invalid="ignore"):
            ok = (width > 0) & (over / width > motion.LANE_OVERLAP)
        a, b = a[ok], b[ok]
        before, now = np.hypot(px[b] - px[a], py[b] - py[a]), np.hypot(x[b] - x[a], y[b] - y[a])
        dt = ((t[a] - pt[a]) + (t[b] - pt[b])) / 2
        for i, j, d0, d1, s in zip(a, b, before, now, dt, strict=True):
            if s > 0 and (d0 - d1) / s > 0:
                sec = 0.0 if d1 <= 0 else d1 / ((d0 - d1) / s)
                least[i], least[j] = min(least[i], sec), min(least[j], sec)
        return np.where(np.isfinite(least), least, motion.NO_TTC)

    def forget(self):
        self.tracks.clear()
        self.flow.clear()
        self.swept.clear()


def feature_stream(obs: DataFrame, dt: float = 1.0, delay: str = FRAME_DELAY, idle_sec: float = 600.0) -> DataFrame:
    """The fifteen features of a stream of observations (with the event time `ts`), keyed by camera."""
    return in_order(obs, ["camera_id"], ["ts", "frame_idx", "track_id"], FeatureFold(dt, idle_sec), FEATURE_ROWS, delay=delay, idle_sec=idle_sec)


LEVELS = T.StructType([T.StructField("camera_id", T.LongType()), T.StructField("event_id", T.LongType()),
                       T.StructField("t", T.DoubleType()), T.StructField("level", T.StringType())])


class AlarmLimit(Fold):
    """Alarms beyond `per_hour` within an hour become alerts and do not count. State: the times of the last alarms."""

    def __init__(self, per_hour: int) -> None:
        self.per_hour = per_hour

    def open(self, handle):
        self.recent = handle.getListState("recent", "t double")

    def step(self, rows):
        recent, levels = [r[0] for r in self.recent.get()] if self.recent.exists() else [], []
        for t, level in zip(rows["t"].tolist(), rows["level"].tolist(), strict=True):
            if level == "ALARM":
                recent = [x for x in recent if x > t - ensemble.HOUR]
                if len(recent) < self.per_hour:
                    recent.append(t)
                else:
                    level = "ALERT"
            levels.append(level)
        self.recent.put([(x,) for x in recent]) if recent else self.recent.clear()
        return rows.assign(level=levels)[LEVELS.names]

    def forget(self):
        self.recent.clear()


def alarm_stream(events: DataFrame, per_hour: int = ensemble.ALARMS_PER_HOUR, delay: str = FRAME_DELAY) -> DataFrame:
    """`ensemble.limit_alarms` for a stream of camera_id, event_id, t, level, ts."""
    return in_order(events, ["camera_id"], ["t", "event_id"], AlarmLimit(per_hour), LEVELS, delay=delay, idle_sec=ensemble.HOUR)
