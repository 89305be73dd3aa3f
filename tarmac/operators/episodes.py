"""Cooldowns, consensus, periodic snapshots, recording episodes, stream health, tiers."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators import folds
from tarmac.operators import sequence as seq

# fixed values: trigger handling
RECORD_TYPES = ["T1", "T2", "T3", "T4", "T5", "T6"]
INSTANT_TYPES = ["T5"]
SEVERITY_GATE = 0.5
CONSENSUS_SEC, CONSENSUS_TYPES = 5.0, 2
COOLDOWN_SEC = 60.0
PERIOD_SEC = 300.0
RECORD_MIN, RECORD_EXTEND, RECORD_MAX, RECORD_COOLDOWN = 180.0, 60.0, 300.0, 600.0
MAX_FAILURES, REPROBE_SEC = 15, 1800.0
TIER3_MAX = 50
DAY = 86_400.0


def day_of(t: str = "t") -> Column:
    return F.floor(F.col(t) / DAY)


def time_cut(df: DataFrame, t: str, width: float, back: float = 0.0, ahead: float = 0.0):
    """Cut by time; rows are also shown to chunks that look `back` at or `ahead` to them."""
    home = F.floor(F.col(t) / width)
    first, last = F.floor((F.col(t) - ahead) / width), F.floor((F.col(t) + back) / width)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_chunk") == home)


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")


def cooldown(events: DataFrame, keys, seconds: float = COOLDOWN_SEC, t: str = "t",
             tie: str = "event_id", size: int = folds.FOLD_BLOCK) -> DataFrame:
    """Events that fire when each firing silences its key for `seconds`."""
    e = events.withColumn("_ready", F.col(t)).withColumn("_release", F.col(t) + seconds)
    return folds.jump_chain(e, keys, [t, tie], day_of(t), ready="_ready", release="_release",
                            horizon=seconds, size=size).drop("_ready", "_release")


def periodic(frames: DataFrame, keys, seconds: float = PERIOD_SEC, t: str = "t",
             tie: str = "frame_idx", size: int = folds.FOLD_BLOCK) -> DataFrame:
    """One snapshot every `seconds` counted from the key's first frame, which takes none."""
    taken = cooldown(frames, keys, seconds, t, tie, size)
    first = frames.groupBy(*keys).agg(F.min(F.struct(t, tie)).alias("_first"))
    return taken.join(first, keys).where(F.struct(t, tie) != F.col("_first")).drop("_first")


def recordable(triggers: DataFrame) -> DataFrame:
    return triggers.where(F.col("type").isin(RECORD_TYPES) & (F.col("severity") >= SEVERITY_GATE))


def _recent(width: float):
    us = F.round(F.col("t") * 1_000_000).cast("long")
    return Window.partitionBy("camera_id", "_chunk").orderBy(us).rangeBetween(
        -int(width * 1_000_000) + 1, 0)


def consensus(triggers: DataFrame, seconds: float = CONSENSUS_SEC) -> DataFrame:
    """Recordable triggers backed by another type within `seconds`, or instant ones."""
    c = time_cut(recordable(triggers), "t", 3600.0, back=seconds)
    kinds = F.size(F.collect_set("type").over(_recent(seconds)))
    ok = F.col("type").isin(INSTANT_TYPES) | (kinds >= CONSENSUS_TYPES)
    return own(c.withColumn("accepted", ok))


def recording_plan(triggers: DataFrame) -> DataFrame:
    """For each recordable trigger: the latest idle-since time that lets it start a recording
    (`backing`) and when a recording it starts would end (`end_t`)."""
    c = time_cut(recordable(triggers), "t", 3600.0, back=CONSENSUS_SEC, ahead=RECORD_MAX)
    w = _recent(CONSENSUS_SEC)
    seen = {x: F.max(F.when(F.col("type") == x, F.col("t"))).over(w) for x in RECORD_TYPES}
    c = c.select("*", *[v.alias(f"_{x}") for x, v in seen.items()])
    others = F.array_max(F.array(*[
        F.when(F.col("type") != x, F.col(f"_{x}")) for x in RECORD_TYPES]))
    line = Window.partitionBy("camera_id", "_chunk").orderBy("t", "event_id")
    n1, n2 = F.lead("t", 1).over(line), F.lead("t", 2).over(line)
    c = c.withColumn("_n1", n1).withColumn("_n2", n2)
    t = F.col("t")
    once = F.coalesce(F.col("_n1") < t + RECORD_MIN, F.lit(False))
    twice = once & F.coalesce(F.col("_n2") < t + RECORD_MIN + RECORD_EXTEND, F.lit(False))
    length = F.when(twice, RECORD_MIN + 2 * RECORD_EXTEND).when(
        once, RECORD_MIN + RECORD_EXTEND).otherwise(RECORD_MIN)
    c = c.withColumn("end_t", t + F.least(length, F.lit(RECORD_MAX)))
    c = c.withColumn("backing", F.when(F.col("type").isin(INSTANT_TYPES), t).otherwise(others))
    return own(c.drop("_n1", "_n2", *[f"_{x}" for x in RECORD_TYPES]))


def recording_episodes(triggers: DataFrame, size: int = folds.FOLD_BLOCK) -> DataFrame:
    """Recordings: 180 s, 60 s more per further trigger up to 300 s, then 600 s of rest.

    Only triggers after the rest count towards the next start.
    """
    p = recording_plan(triggers).withColumn("_release", F.col("end_t") + RECORD_COOLDOWN)
    taken = folds.jump_chain(
        p, ["camera_id"], ["t", "event_id"], day_of(), ready="backing", release="_release",
        horizon=RECORD_MAX + RECORD_COOLDOWN + CONSENSUS_SEC, size=size)
    return taken.select("camera_id", "event_id", "type", "severity", F.col("t").alias("start_t"),
                        "end_t", (F.col("end_t") - F.col("t")).alias("seconds"))


def failure_runs(health: DataFrame, limit: int = MAX_FAILURES, reprobe: float = REPROBE_SEC,
                 size: int = seq.BLOCK) -> DataFrame:
    """Unbroken failure runs per camera; a run reaching `limit` disables the stream at that event.

    Input: camera_id, event_id, t, failed.
    """
    keys = ["camera_id"]
    b = seq.blocks(health, keys, ["t", "event_id"], day_of(), size=size, halo=1)
    ok_before = ~F.lag("failed", 1).over(seq.block_window(keys))
    b = b.withColumn("_start", F.col("failed") & ((F.col("_g") == 1) | ok_before))
    b = seq.islands(b, keys, F.col("_start"), "run", size=size, halo=1, depth=1)
    f = seq.body(b).where("failed").withColumn("nth", F.col("_g") - F.col("run") + 1)
    out = f.groupBy("camera_id", "run").agg(
        F.count("*").alias("failures"), F.min("t").alias("first_t"),
        F.max(F.when(F.col("nth") == limit, F.col("t"))).alias("disabled_t"))
    return out.withColumn("disabled", F.col("disabled_t").isNotNull()).withColumn(
        "reprobe_t", F.col("disabled_t") + reprobe)


_TIER = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("admitted", T.BooleanType())])


def tier_admission(requests: DataFrame, cap: int = TIER3_MAX,
                   size: int = 10 * folds.FOLD_BLOCK) -> DataFrame:
    """Promotions to the top tier: refused while `cap` other cameras hold it.

    Input: event_id, camera_id, t, hold. The cap is shared by all cameras, so the rule is one
    sequence; it is split wherever every earlier hold has run out, and walked in bounded blocks.
    """
    r = requests.withColumn("_all", F.lit(0)).withColumn("_until", F.col("t") + F.col("hold"))
    runs = folds.reset_runs(r, ["_all"], ["t", "event_id"], day_of(), F.col("_until"), F.col("t"))

    def step(state, rows):
        held, out = dict(state), []
        ends = sorted((u, c) for c, u in held.items())  # a heap of when holds run out
        for cam, t, until in zip(rows["camera_id"].astype(str).tolist(), rows["t"].tolist(), rows["_until"].tolist()):
            while ends and not ends[0][0] > t:
                del held[heapq.heappop(ends)[1]]
            ok = len(held) < cap and cam not in held
            if ok:
                held[cam] = until
                heapq.heappush(ends, (until, cam))
            out.append(ok)
        return held, pd.DataFrame({"event_id": rows["event_id"], "admitted": out})

    return folds.chained_fold(runs.select("_all", "_run", "_g", "event_id", "camera_id", "t", "_until"), ["_all"], step, _TIER, size=size)
