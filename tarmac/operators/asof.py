"""Backward as-of joins without a window over a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, values: Sequence[str],
                keys: Sequence[str] = (), width: float = 3600.0) -> DataFrame:
    """`left` with the columns `right_ts` and `values` of its latest right row at or before it (nulls if none).

    Time is cut into slots of `width` seconds. Rows of both sides are sorted together inside a slot and the last right
    row is handed down, led by the last one of the slots before; what travels from slot to slot is one row for each slot
    and key. Work is that of a sort, however many right rows a slot holds. Right rows of one time and key are made one first:
    among them the largest `values` count. Rows without a time match nothing.
    """
    keys = list(keys)
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / int(width * 1e6))
    one = right.where(F.col(right_ts).isNotNull()).groupBy(*keys, F.col(right_ts).alias("_at")).agg(F.max(F.struct(*values)).alias("_v"))
    one = one.select(*keys, F.struct("_at", *(F.col("_v")[v].alias(v) for v in values)).alias("_r"), "_at")
    last = one.groupBy(*keys, slot("_at").alias("_slot")).agg(F.max_by("_r", "_at").alias("_end"))
    asked = left.select(*keys, slot(left_ts).alias("_slot")).where("_slot IS NOT NULL").distinct()
    w = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(asked, [*keys, "_slot"], "full").withColumn("_lead", F.last("_end", ignorenulls=True).over(w)).select(*keys, "_slot", "_lead")
    # a key may be null on the left; it meets nothing and is kept
    timely = left.where(F.col(left_ts).isNotNull())
    both = timely.select(*keys, F.col(left_ts).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(one.schema["_r"].dataType).alias("_r")).unionByName(
        one.select(*keys, "_at", F.lit(None).cast(left.select(F.struct(*left.columns).alias("_l")).schema["_l"].dataType).alias("_l"), "_r"))
    both = both.withColumn("_slot", slot("_at"))
    # right rows first among equals
    inside = Window.partitionBy(*keys, "_slot").orderBy("_at", F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_r", ignorenulls=True).over(inside)).where("_l IS NOT NULL").drop("_r")
    timed = found.join(carried, [*keys, "_slot"], "left").withColumn("_best", F.coalesce("_here", "_lead"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    best = F.when(known, F.col("_best"))
    none = left.where(F.col(left_ts).isNull()).select(F.struct(*left.columns).alias("_l"), F.lit(None).cast(one.schema["_r"].dataType).alias("_best"))
    out = timed.select("_l", best.alias("_best")).unionByName(none)
    return out.select(*(F.col("_l")[c].alias(c) for c in left.columns), F.col("_best._at").alias(right_ts), *(F.col("_best")[v].alias(v) for v in values))
