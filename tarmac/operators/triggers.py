"""The eight trigger kinds: signal rows per kind, cooled down or folded independently of each other.

`signals` turns frames into one narrow row per kind and frame that can matter to it. Kinds without memory
(braking, braking together, people, snapshots) only need a cooldown, which `jump_chain` resolves in
parallel. The others remember something of the frames they looked at; a kind does not look during its
cooldown, so its memory stands still then. Their folds take a whole stretch between two cooldowns at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators import episodes, folds
from tarmac.operators import sequence as seq

# fixed values: trigger thresholds
COOLDOWN = 60.0
TTC_MIN, TTC_MAX, TTC_FRAMES = 0.5, 2.0, 4
DECEL = -3.0
STOP_KMH, STOP_SEC = 5.0, 10.0
MANY, MANY_DROP = 3, 10.0
HISTORY, HISTORY_MIN, SIGMA = 300, 10, 2.0
PERIOD = 300.0
IDLE_SEC = 600.0
AWAY_PX, ALIGNED, AGAINST = 50.0, 0.3, -0.7

SCHEMA = T.StructType([
    T.StructField("camera_id", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("frame_idx", T.LongType()), T.StructField("t", T.DoubleType()),
    T.StructField("involved_tracks", T.ArrayType(T.LongType())),
    T.StructField("severity", T.DoubleType()), T.StructField("description", T.StringType())])
_COLS = [f.name for f in SCHEMA.fields]
_FRAME = ["camera_id", "frame_idx"]
_ITEM = "array<struct<a: bigint, b: bigint, x: double, y: double, v: double>>"
PLAIN, FOLDED = ("T2", "T5", "T8"), ("T1", "T3", "T4", "T6")


def _item(a, b=None, x=None, y=None, v=None):
    none = F.lit(None)
    return F.struct(a.alias("a"), (none if b is None else b).cast("bigint").alias("b"), (none if x is None else x).cast("double").alias("x"),
                    (none if y is None else y).cast("double").alias("y"), (none if v is None else v).cast("double").alias("v"))


def signals(motion_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(camera_id, type, frame_idx, t, items): what each kind can see in a frame. `pairs` are of vehicles."""
    walker = F.col("cls").isin("person", "pedestrian")
    v = F.when(F.col("track_age") >= 2, F.col("speed_kmh"))
    drop = F.when(F.col("track_age") >= 3, F.col("acceleration") * 3.6)  # km/h gained since the frame before
    rows = motion_rows.withColumns({"_v": F.when(~walker, v), "_drop": F.when(~walker, drop), "_car": ~walker})

    def gather(when, item):
        return F.array_sort(F.collect_list(F.when(when, item))).cast(_ITEM)

    f = rows.groupBy(*_FRAME).agg(
        F.max("t").alias("t"),
        gather(F.col("_car"), _item(F.col("track_id"), x=F.col("cx"), y=F.col("cy"))).alias("T4"),
        gather(F.col("_v").isNotNull(), _item(F.col("track_id"), v=F.col("_v"))).alias("T3"),
        gather(F.col("_drop").isNotNull(), _item(F.col("track_id"), v=F.col("_drop"))).alias("_drops"),
        gather(walker, _item(F.col("track_id"))).alias("T8"), F.count("_v").alias("_n"), F.avg("_v").alias("_mean"))
    band = pairs.where(F.col("ttc").between(TTC_MIN, TTC_MAX)).groupBy(*_FRAME).agg(
        F.array_sort(F.collect_list(F.struct(F.col("ttc").alias("o"), _item(F.least("track_a", "track_b"), F.greatest("track_a", "track_b"),
                                                                           F.col("track_a"), F.col("track_b"), F.col("ttc")).alias("i")))).alias("s"))
    f = f.join(band.select(*_FRAME, F.transform("s", lambda s: s["i"]).cast(_ITEM).alias("T1")), _FRAME, "left")
    n = seq.blocks(f.select(*_FRAME, "t"), ["camera_id"], ["frame_idx"], F.floor(F.col("frame_idx") / 4096), halo=1)
    step = F.col("t") - F.lag("t").over(seq.block_window(["camera_id"], "frame_idx"))
    gap = seq.body(n.withColumn("_gap", F.when((step > 0) & (step <= 10), step).otherwise(1.0))).select(*_FRAME, "_gap")
    f = f.join(gap, _FRAME)
    brakes = F.filter("_drops", lambda d: d["v"] / 3.6 / F.col("_gap") <= DECEL)
    together = F.filter("_drops", lambda d: d["v"] <= -MANY_DROP)
    f = f.withColumns({
        "T1": F.coalesce("T1", F.array().cast(_ITEM)), "T2": F.transform(brakes, lambda d: _item(d["a"], v=d["v"] / 3.6 / F.col("_gap"))).cast(_ITEM),
        "T5": F.when(F.size(together) >= MANY, together).otherwise(F.array().cast(_ITEM)),
        "T6": F.when(F.col("_n") >= 3, F.array(_item(F.lit(None).cast("bigint"), v=F.col("_mean"))).cast(_ITEM)).otherwise(F.array().cast(_ITEM)),
        "T7": F.array().cast(_ITEM),
    })
    always = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("items")) for k in ("T1", "T4", "T7")])
    some = F.filter(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("items")) for k in ("T2", "T3", "T5", "T6", "T8")]), lambda s: F.size(s["items"]) > 0)
    return f.select(*_FRAME, "t", F.explode(F.concat(always, some)).alias("s")).select(*_FRAME, "t", "s.type", "s.items")


def _plain(rows: DataFrame, *more: str) -> DataFrame:
    """Trigger rows of the kinds without memory, with the columns `more` of `rows`."""
    i, n = F.col("items"), F.size("items")
    first = F.get(i, F.lit(0))
    ids = F.transform(i, lambda x: x["a"])
    is_a = F.col("type")
    return rows.select(
        "camera_id", "type", "frame_idx", "t",
        F.when(is_a == "T2", F.slice(ids, 1, 1)).when(is_a == "T5", ids).when(is_a == "T8", F.filter(ids, lambda x: x >= 0))
        .otherwise(F.array().cast("array<bigint>")).alias("involved_tracks"),
        F.when(is_a == "T2", F.least(F.lit(1.0), first["v"] / DECEL)).when(is_a == "T5", F.least(F.lit(1.0), n / (MANY * 2)))
        .when(is_a == "T8", F.least(F.lit(1.0), 0.8 + 0.1 * (n - 1))).otherwise(0.1).alias("severity"),
        F.when(is_a == "T2", F.format_string("decel %.1f m/s2", first["v"])).when(is_a == "T5", F.format_string("%d braking together", n))
        .when(is_a == "T8", F.format_string("%d on the road", n)).otherwise("periodic").alias("description"), *more)


# --- kinds with memory: scan(memory, t, items) looks at a stretch of frames up to the first that fires ---------
# and gives (its place or None, tracks, severity, description); memory is left as of that frame.


def _table(items: list) -> pd.DataFrame:
    """The items of a stretch as rows: place of the frame, order inside it, fields."""
    rows = [(k, o, x["a"], x["b"], x["x"], x["y"], x["v"]) for k, frame in enumerate(items) for o, x in enumerate(frame)]
    # a stream hands whole numbers on as floats where some are null; keys must read alike in tables and streams
    return pd.DataFrame(rows, columns=["k", "o", "a", "b", "x", "y", "v"]).astype({"a": "Int64", "b": "Int64"})


def _upto(d: pd.DataFrame, k: int, o: int) -> pd.DataFrame:
    return d[(d.k < k) | ((d.k == k) & (d.o < o))]


def near_miss(memory: dict, t: np.ndarray, items: list):
    """A pair in the time-to-contact band for TTC_FRAMES looks in a row."""
    d = _table(items)
    d["key"] = d.a.astype(str) + "," + d.b.astype(str)
    d = d.sort_values(["key", "k"], kind="stable")
    new = (d.key != d.key.shift()) | (d.k != d.k.shift() + 1)
    run = new.cumsum()
    head = d.k.groupby(run).transform("first") == 0
    d["n"] = d.groupby(run).cumcount() + 1 + np.where(head, d.key.map(memory).fillna(0), 0)
    hits = d[d.n >= TTC_FRAMES].sort_values(["k", "o"])
    if hits.empty:
        last = d[d.k == len(items) - 1]
        memory.clear()
        memory.update((k, int(n)) for k, n in zip(last.key, last.n))
        return None
    h = hits.iloc[0]
    if h.k > 0:  # the look that fires forgets no pair
        before = d[d.k == h.k - 1]
        memory.clear()
        memory.update((k, int(n)) for k, n in zip(before.key, before.n))
    now = d[(d.k == h.k) & (d.o < h.o)]
    memory.update((k, int(n)) for k, n in zip(now.key, now.n))
    memory.pop(h.key, None)
    return int(h.k), [int(h.x), int(h.y)], max(0.0, 1 - h.v / TTC_MAX), f"ttc {h.v:.1f}s over {int(h.n)} frames"


def standing(memory: dict, t: np.ndarray, items: list):
    """A vehicle at STOP_KMH or less for STOP_SEC."""
    d = _table(items)
    d["now"] = t[d.k.to_numpy(int)]
    d["key"] = d.a.astype(str)
    d = d.sort_values(["key", "k"], kind="stable")
    d["stopped"] = d.v <= STOP_KMH
    spell = (~d.stopped).groupby(d.key).cumsum()
    began = d.now.where(d.stopped).groupby([d.key, spell]).transform("min")
    d["since"] = np.where(spell == 0, d.key.map(memory).fillna(began), began)
    hits = d[d.stopped & (d.now - d.since >= STOP_SEC)].sort_values(["k", "o"])
    h = None if hits.empty else hits.iloc[0]
    last = (d if h is None else _upto(d, h.k, h.o)).groupby("key").tail(1)
    for key, stopped, since in zip(last.key, last.stopped, last.since):
        memory.pop(key, None)
        if stopped:
            memory[key] = float(since)
    if h is None:
        return None
    memory.pop(h.key, None)
    held = h.now - h.since
    return int(h.k), [int(h.a)], min(1.0, held / (STOP_SEC * 3)), f"standing {held:.0f}s"


def against(memory: dict, t: np.ndarray, items: list):
    """A vehicle heading, from where it was first seen, against the mean heading of the others."""
    for k, frame in enumerate(items):
        ids = [str(int(x["a"])) for x in frame]
        at = np.array([(x["x"], x["y"]) for x in frame], float).reshape(-1, 2)
        home = np.array([memory.get(i, [*p])[:2] for i, p in zip(ids, at)], float).reshape(-1, 2)
        memory.update((i, [float(p[0]), float(p[1]), float(t[k])]) for i, p in zip(ids, home))
        for i in [i for i, m in memory.items() if t[k] - m[2] > IDLE_SEC]:
            del memory[i]
        way = at - home
        far = np.hypot(way[:, 0], way[:, 1])
        moved = np.flatnonzero(far >= AWAY_PX)
        if len(moved) < 4:
            continue
        unit = way[moved] / far[moved, None]
        rest = (unit.sum(0) - unit) / (len(moved) - 1)
        size = np.hypot(rest[:, 0], rest[:, 1])
        cos = (unit * rest).sum(1) / np.maximum(size, 1e-300)
        bad = np.flatnonzero((size >= ALIGNED) & (cos < AGAINST))
        if len(bad):
            c = float(cos[bad[0]])
            return k, [int(ids[moved[bad[0]]])], min(1.0, abs(c)), f"against traffic, cosine {c:.2f}"
    return None


def odd_flow(memory: dict, t: np.ndarray, items: list):
    """The mean speed of a frame SIGMA deviations off that of the last HISTORY frames."""
    past = memory.get("past", [])
    x = np.array(past + [frame[0]["v"] for frame in items])
    end = np.arange(len(past) + 1, len(x) + 1)
    low = np.maximum(0, end - HISTORY)
    mid0 = x.mean()
    c1, c2 = np.r_[0, np.cumsum(x - mid0)], np.r_[0, np.cumsum((x - mid0) ** 2)]
    n = end - low
    mid = (c1[end] - c1[low]) / n
    std = np.sqrt(np.maximum(0, (c2[end] - c2[low]) / n - mid**2))
    off = np.abs(x[len(past):] - mid0 - mid) / np.maximum(std, 1e-300)
    bad = np.flatnonzero((n >= HISTORY_MIN) & (std >= 1) & (off >= SIGMA))
    k = int(bad[0]) if len(bad) else None
    memory["past"] = x[: len(x) if k is None else end[k]][-HISTORY:].tolist()
    if k is None:
        return None
    return k, [], min(1.0, off[k] / (SIGMA * 2)), f"flow {x[len(past) + k]:.1f} against {mid0 + mid[k]:.1f}"


SCANS = {"T1": near_miss, "T3": standing, "T4": against, "T6": odd_flow}


def fold(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Signal rows of one camera and kind, in frame order, to trigger rows. State: `ready` (when it looks
    again) and the kind's memory."""
    out, i, n = [], 0, len(rows)
    if not n:
        return state, pd.DataFrame(out, columns=_COLS)
    camera, kind = int(rows.camera_id.iloc[0]), rows.type.iloc[0]
    t, frame, items = rows.t.to_numpy(float), rows.frame_idx.to_numpy(), rows["items"].tolist()
    memory = state.setdefault("memory", {})
    while True:
        while i < n and t[i] < state.get("ready", -np.inf):
            i += 1
        if i >= n:
            break
        hit = SCANS[kind](memory, t[i:], items[i:])
        if hit is None:
            break
        k, tracks, severity, text = hit
        out.append((camera, kind, int(frame[i + k]), float(t[i + k]), tracks, float(severity), text))
        state["ready"] = float(t[i + k]) + COOLDOWN
        i += k + 1
    return state, pd.DataFrame(out, columns=_COLS)


def detect(rows: DataFrame, size: int = 21_600) -> DataFrame:
    """Triggers of all cameras from their `signals`, parallel by camera and kind. A task holds `size` frames of one of them."""
    keys = ["camera_id", "type"]
    plain = episodes.cooldown(_plain(rows.where(F.col("type").isin(*PLAIN))), keys, COOLDOWN, tie="frame_idx")
    snaps = episodes.periodic(_plain(rows.where("type = 'T7'")), keys, PERIOD)
    n = seq.number_rows(rows.where(F.col("type").isin(*FOLDED)), keys, ["frame_idx"], F.floor(F.col("frame_idx") / 4096))
    found = folds.chained_fold(n.withColumn("_run", F.lit(1).cast("long")), keys, fold, SCHEMA, size=size)
    return plain.select(*_COLS).unionByName(snaps.select(*_COLS)).unionByName(found)


def stream_rows(rows: DataFrame, ts) -> DataFrame:
    """`signals` as a stream carries them: with the trigger each would be, and the event time `ts`."""
    return _plain(rows, "items").withColumn("ts", ts)


def stream_fold(state: dict, rows: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """`fold`, and for the kinds without memory rows that carry their trigger: the first at or after `ready`."""
    kind = rows.type.iloc[0]
    if kind in SCANS:
        return fold(state, rows)
    hold, out = (PERIOD if kind == "T7" else COOLDOWN), []
    for r in rows[_COLS].itertuples(index=False):
        if r.t >= state.get("ready", -np.inf):
            if kind != "T7" or "ready" in state:
                out.append(tuple(r))
            state["ready"] = float(r.t) + hold
    return state, pd.DataFrame(out, columns=_COLS)
