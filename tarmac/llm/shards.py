"""Shards by sampled splitters: size-weighted key samples give range boundaries, overfull ranges are subdivided."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tarmac.llm.common import query, table
from tarmac.session import stage

LAWS = ("bytes", "rows")
_NO_ID = -(2**63)  # stands for a null id, before all others
Key = tuple[int, int]


def place(bounds: list[Key], h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds are at or below each key (h, id)."""
    bh, bi = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
    lo, hi = np.searchsorted(bh, h, "left"), np.searchsorted(bh, h, "right")
    out = lo.copy()
    ties = np.flatnonzero(hi > lo)
    for x in np.unique(h[ties]):
        at = ties[h[ties] == x]
        a, b = lo[at[0]], hi[at[0]]
        out[at] = a + np.searchsorted(bi[a:b], ids[at], "right")
    return out


def _ranged(rows: DataFrame, bounds: list[Key]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(bounds)  # a few for each range

    @pandas_udf("int")
    def at(h: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(place(sent.value, h.to_numpy(), i.to_numpy()).astype(np.int32))

    return rows.withColumn("range", at("h", "i"))


def quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[Key]:
    """Boundaries that cut a weighted sample (h, id, weight) in `parts`; only a key with several splits inside an h."""
    if not sample or parts < 2:
        return []
    sample = sorted(sample)
    cum = np.cumsum([w for *_, w in sample])
    at = np.searchsorted(cum, cum[-1] * np.arange(1, parts) / parts, "left")
    out: list[Key] = []
    for k in sorted({sample[j][:2] for j in at}):
        out.append((k[0], _NO_ID) if not out or out[-1][0] != k[0] else k)
    return out


def splitters(rows: DataFrame, total: int, parts: int, per_part: int = 64, rounds: int = 6) -> tuple[list[Key], list]:
    """Boundaries of about `parts` ranges of `rows` (h, i, size, n) and the bytes and rows of each range.

    The sample is drawn by a hash of the key with a chance that grows with the size: about `per_part` a range.
    A range with over twice its share is cut again by a sample of its own, until none is left or it is one key.
    """
    share = total / parts
    own = F.col("size") * F.col("n")
    u = F.pmod(F.xxhash64("h", "i", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)

    def draw(some: DataFrame, rate: float) -> list[tuple[int, int, float]]:
        found = some.where(u < own * rate).select("h", "i", own.alias("w")).collect()
        return [(r.h, r.i, max(r.w, 1 / rate)) for r in found]

    bounds = quantiles(draw(rows, per_part * parts / max(1, total)), parts)
    for k in range(rounds):
        sums = _ranged(rows, bounds).groupBy("range").agg(F.sum(own).alias("b"), F.sum("n").alias("n"), F.count("*").alias("keys")).orderBy("range").collect()
        over = [r for r in sums if r.b > 2 * share and r["keys"] > 1]
        if not over or k == rounds - 1:
            return bounds, sums
        inside = _ranged(rows, bounds).where(F.col("range").isin([r.range for r in over]))
        extra = draw(inside, per_part / share)
        where = place(bounds, np.array([s[0] for s in extra], np.int64), np.array([s[1] for s in extra], np.int64))
        more: set[Key] = set(bounds)
        for r in over:
            mine = [s for s, w in zip(extra, where, strict=True) if w == r.range]
            new = quantiles(mine, int(np.ceil(r.b / share)))
            more.update(new if any(b not in more for b in new) else [s[:2] for s in mine[:: max(1, len(mine) // 8)]])
        bounds = sorted(more)
    return bounds, []


def assign(docs: DataFrame, shards: int = 24, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text",
           parts_per_shard: int = 16, group_share: float = 0.002) -> DataFrame:
    """Per row of `docs`: id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot (gapless from 0), grown_shard (null).

    Keys are (hash of the text, id), so equal texts are neighbours; a group of them under `group_share` of a
    shard stays in one. `bytes`: a row goes where the middle of its bytes falls, so sizes differ by little more
    than one row or such a group; `rows`: counts are at most one apart. Null texts have size 8 and the checksum of the
    empty text; null ids come first among equal texts; repeated rows each get a slot; other columns are
    left out; an empty table gives an empty result.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("i"), F.xxhash64(text).alias("h"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
    )
    rows = stage(rows.groupBy("h", "i", "size", "crc").agg(F.count("*").alias("n")))  # repeated rows are one
    total, count = rows.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    total, count = total or 1, count or 1
    bounds, sums = splitters(rows, total, shards * parts_per_shard)
    before, at = [], [0, 0]
    for r in sums:
        before.append((r.range, *at))
        at = [at[0] + r.b, at[1] + r.n]
    starts = rows.sparkSession.createDataFrame(before, "range int, byte0 long, row0 long")  # a row for each range
    order = Window.partitionBy("range").orderBy("h", "i", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "h")
    own = F.col("size") * F.col("n")
    r = _ranged(rows, bounds).withColumns({
        "bytes_in": F.coalesce(F.sum(own).over(order), F.lit(0)), "rows_in": F.coalesce(F.sum("n").over(order), F.lit(0)),
    })
    r = r.withColumns({"group_in": F.min("bytes_in").over(group), "group": F.sum(own).over(group)}).join(F.broadcast(starts), "range")
    r = r.select("i", "h", "size", "crc", "byte0", "row0", "bytes_in", "rows_in", "group_in", "group", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    row = F.col("row0") + F.col("rows_in") + F.col("k")
    if law == "rows":
        shard = F.floor(row * F.lit(shards) / count)
    else:
        whole = F.col("group") <= group_share * total / shards
        mid = F.col("byte0") + F.when(whole, F.col("group_in") + F.col("group") / 2).otherwise(F.col("bytes_in") + (F.col("k") + 0.5) * F.col("size"))
        shard = F.least(F.floor(mid * shards / total), F.lit(shards - 1))
    r = stage(r.select("i", "size", "crc", shard.cast("int").alias("shard"), row.alias("row")))
    first = r.groupBy("shard").agg(F.min("row").alias("row0"))  # at most `shards` rows
    return r.join(F.broadcast(first), "shard").select(
        F.when(F.col("i") > _NO_ID, F.col("i")).alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"),
        "shard", (F.col("row") - F.col("row0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_sharding_splitters")
def op8(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))
