"""Exponential smoothing without a sequential scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators import sequence as seq


def ema(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, value: str,
        alpha: float, out: str) -> DataFrame:
    """s1 = x1, sn = alpha * xn + (1 - alpha) * s(n-1).

    A value `reach` rows back weighs less than double precision can show, so each block only looks
    back that far and the weighted sum is an ordinary running window.
    """
    reach = math.ceil(math.log(1e-17) / math.log(1 - alpha))
    size = max(256 - reach, reach + 1)
    b = seq.blocks(df, keys, order, chunk, size=size, halo=reach)
    p = F.col("_g") - F.col("_blk") * size
    q = F.lit(1 - alpha)
    weight = F.when(F.col("_g") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    w = seq.block_window(keys).rowsBetween(-10_000, 0)
    grown = F.sum(F.col(value) * weight * F.pow(q, -p)).over(w)
    return seq.body(b.withColumn(out, grown * F.pow(q, p))).drop("_g")
