"""Exact sequential semantics over long event histories, run in parallel.

`jump_chain` covers every rule of the form "after an event is taken nothing is taken before its
release time": cooldowns, periodic snapshots, recording episodes. Blocks of a key are summarised
independently (incoming release time -> outgoing release time), the summaries are chained, and the
blocks are then resolved independently again.

`chained_fold` covers rules whose state is richer than one number. It splits a key's history where
the state provably resets and, inside a stretch that is still long, walks blocks in rounds with the
state kept in a table; a round handles that block of every key at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators import sequence as seq
from tarmac.session import stage

FOLD_BLOCK = 100_000


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    by = {f.name: f for f in df.schema.fields}
    return [T.StructField(n, by[n].dataType, True) for n in names]


def _summarise(ready, release, horizon):
    """Step function of a block: incoming release -> outgoing release."""
    high = np.maximum.accumulate(ready)
    n = len(ready)
    nxt = np.searchsorted(high, release, side="left")
    out = release.copy()
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            out[i] = out[nxt[i]]
    heads = np.flatnonzero(np.r_[True, high[1:] > high[:-1]])
    thr, ext = high[heads], out[heads]
    finite = np.isfinite(thr)
    thr, ext = thr[finite], ext[finite]
    if len(thr) == 0:
        return [], []
    keep_to = int(np.searchsorted(thr, thr[0] + horizon, side="right")) + 1
    thr, ext = thr[:keep_to], ext[:keep_to]
    last_of_run = np.r_[ext[1:] != ext[:-1], True]
    return thr[last_of_run].tolist(), ext[last_of_run].tolist()


def jump_chain(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    chunk: Column,
    *,
    ready: str,
    release: str,
    horizon: float,
    size: int = FOLD_BLOCK,
) -> DataFrame:
    """Rows taken by the rule "first row whose `ready` has reached the last taken row's `release`".

    `ready` is null on rows that can never be taken; `release` is at least `ready` and at most
    `horizon` later. Returns the taken rows with all their columns.
    """
    keys = list(keys)
    numbered = seq.blocks(df, keys, order, chunk, size=size).drop("_halo")
    slim = numbered.select(
        *keys, "_blk", "_g", F.col(ready).cast("double").alias("_r"),
        F.col(release).cast("double").alias("_e"),
    )
    key_fields = _fields(slim, keys)

    def arrays(pdf):
        pdf = pdf.sort_values("_g", kind="stable")
        r = pdf["_r"].to_numpy(dtype=float, na_value=-np.inf)
        r = np.where(np.isnan(r), -np.inf, r)
        return pdf, r, pdf["_e"].to_numpy(dtype=float)

    def summary(key, pdf):
        _, r, e = arrays(pdf)
        thr, ext = _summarise(r, e, horizon)
        return pd.DataFrame([[*key, thr, ext]], columns=[*keys, "_blk", "thr", "ext"])

    summary_schema = T.StructType([
        *key_fields, T.StructField("_blk", T.LongType()),
        T.StructField("thr", T.ArrayType(T.DoubleType())),
        T.StructField("ext", T.ArrayType(T.DoubleType())),
    ])
    steps = slim.groupBy(*keys, "_blk").applyInPandas(summary, summary_schema)

    def chain(key, pdf):
        pdf = pdf.sort_values("_blk")
        t, seen = -np.inf, []
        for thr, ext in zip(pdf["thr"], pdf["ext"]):
            seen.append(t)
            i = int(np.searchsorted(np.asarray(thr, dtype=float), t, side="left"))
            if i < len(thr):
                t = float(ext[i])
        out = pd.DataFrame({k: v for k, v in zip(keys, key)}, index=range(len(pdf)))
        out["_blk"] = pdf["_blk"].to_numpy()
        out["_in"] = seen
        return out

    chain_schema = T.StructType([
        *key_fields, T.StructField("_blk", T.LongType()), T.StructField("_in", T.DoubleType()),
    ])
    entering = steps.groupBy(*keys).applyInPandas(chain, chain_schema)

    def resolve(key, pdf):
        pdf, r, e = arrays(pdf)
        high = np.maximum.accumulate(r)
        t, taken = float(pdf["_in"].iloc[0]), []
        while True:
            i = int(np.searchsorted(high, t, side="left"))
            while i < len(r) and not np.isfinite(r[i]):
                i += 1
            if i >= len(r):
                break
            taken.append(i)
            t = e[i]
        return pdf.iloc[taken][[*keys, "_g"]]

    taken = (
        slim.join(entering, [*keys, "_blk"])
        .groupBy(*keys, "_blk")
        .applyInPandas(resolve, T.StructType([*key_fields, T.StructField("_g", T.LongType())]))
    )
    return numbered.drop("_blk").join(taken, [*keys, "_g"], "left_semi").drop("_g")


def reset_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, ends: Column,
    starts: Column, size: int = seq.BLOCK,
) -> DataFrame:
    """Number rows and tag them with `_run`: a new run begins where every earlier row's `ends`
    lies before this row's `starts`, i.e. where nothing earlier can still matter."""
    g = seq.blocks(df.withColumn("_end", ends), keys, order, chunk, size=size)
    g = seq.previous_max(g, keys, "_end", "_prev", size=size)
    g = seq.islands(g, keys, F.col("_prev").isNull() | (F.col("_prev") < starts), "_run", size=size)
    return g.drop("_end", "_prev", "_blk", "_halo")


def chained_fold(
    runs: DataFrame,
    keys: Sequence[str],
    step: Callable[[dict, pd.DataFrame], tuple[dict, pd.DataFrame]],
    out_schema: T.StructType,
    *,
    size: int = FOLD_BLOCK,
) -> DataFrame:
    """Fold each (key, `_run`) in `_g` order with `step(state, rows) -> (state, output)`.

    `runs` comes from `reset_runs`. State is a JSON-serialisable dict, empty at a run's start.
    """
    keys = [*keys, "_run"]
    # written once, by round: a round reads its own rows alone and plans stay small
    cut_up = runs.withColumn("_round", F.floor((F.col("_g") - F.col("_run")) / size).cast("int"))
    cut_up = stage(cut_up.repartition(*keys, "_round"), "_round")
    rounds = (cut_up.agg(F.max("_round")).first()[0] or 0) + 1
    key_fields = _fields(cut_up, keys)
    out_fields = out_schema.fields

    if rounds == 1:
        def whole(pdf):
            _, out = step({}, pdf.sort_values("_g", kind="stable"))
            return out[[f.name for f in out_fields]]

        return cut_up.groupBy(*keys).applyInPandas(whole, out_schema)

    state_schema = T.StructType([*key_fields, T.StructField("_state", T.StringType())])
    boxed = T.StructType([
        *key_fields, T.StructField("_state", T.StringType()),
        *[T.StructField(f.name, f.dataType, True) for f in out_fields if f.name not in keys],
    ])
    spark = runs.sparkSession
    state = spark.createDataFrame([], state_schema)
    result = None
    for r in range(rounds):
        def one(key, left, rows):
            st = json.loads(left["_state"].iloc[0]) if len(left) else {}
            st, out = step(st, rows.sort_values("_g", kind="stable"))
            names = [f.name for f in boxed.fields]
            out = out.astype(object).assign(_state=None)
            for k, v in zip(keys, key):
                out[k] = v
            tail = {**dict.fromkeys(names), **dict(zip(keys, key)), "_state": json.dumps(st)}
            tail = pd.DataFrame([tail], columns=names, dtype=object)
            return pd.concat([out[names], tail], ignore_index=True) if len(out) else tail

        now = cut_up.where(F.col("_round") == r)
        done = stage(
            state.groupBy(*keys).cogroup(now.groupBy(*keys)).applyInPandas(
                lambda key, l, rows: one(key, l, rows) if len(rows)
                else pd.DataFrame(columns=[f.name for f in boxed.fields]), boxed)
        )
        state = done.where(F.col("_state").isNotNull()).select(*keys, "_state")
        part = done.where(F.col("_state").isNull()).select(*[f.name for f in out_fields])
        result = part if result is None else result.unionByName(part)
    return result
