"""Order-dependent windows that never put a whole key in one task.

A camera, an interchange or even one track can hold a large share of all rows, so a plain
``Window.partitionBy(key)`` would sort that share in a single task. Instead every key's rows get
their position with a two-level count (`number_rows`), are cut into blocks of a fixed number of
rows, and each block carries copies of the few rows before it that its windows look back to
(`blocks`). What must travel further than that - "the last heading", "where this run began" - is
summarised per block and handed on (`carry_last`, `carry_max`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16_384


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, out: str = "_g"
) -> DataFrame:
    """1-based position of each row inside its key under a total order.

    `chunk` must never decrease along `order` (an hour, a frame range): rows are ranked inside
    (key, chunk) and shifted by the size of the key's earlier chunks.
    """
    keys = list(keys)
    tagged = df.withColumn("_ck", chunk)
    sizes = tagged.groupBy(*keys, "_ck").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_ck", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*keys, "_ck").orderBy(*order)
    ranked = tagged.withColumn("_l", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, "_ck"])
        .withColumn(out, (F.col("_l") + F.col("_off")).cast("long"))
        .drop("_l", "_off", "_ck")
    )


def cut(df: DataFrame, pos: str, size: int = BLOCK, halo: int = 0) -> DataFrame:
    """Blocks of `size` rows by position; the last `halo` rows also lead the next block."""
    if halo >= size:
        raise ValueError("halo must be smaller than a block")
    p = F.col(pos) - 1
    blk = F.floor(p / F.lit(size)).cast("long")
    if halo == 0:
        return df.withColumn("_blk", blk).withColumn("_halo", F.lit(False))
    own = F.struct(blk.alias("b"), F.lit(False).alias("h"))
    nxt = F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))
    homes = F.when(p % size >= size - halo, F.array(own, nxt)).otherwise(F.array(own))
    return (
        df.withColumn("_home", F.explode(homes))
        .withColumn("_blk", F.col("_home.b"))
        .withColumn("_halo", F.col("_home.h"))
        .drop("_home")
    )


def blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    chunk: Column,
    *,
    size: int = BLOCK,
    halo: int = 0,
    out: str = "_g",
) -> DataFrame:
    return cut(number_rows(df, keys, order, chunk, out), out, size, halo)


def block_window(keys: Sequence[str], pos: str = "_g"):
    return Window.partitionBy(*keys, "_blk").orderBy(pos)


def body(df: DataFrame) -> DataFrame:
    """Drop the look-back copies once the windows are evaluated."""
    return df.where(~F.col("_halo")).drop("_halo", "_blk")


def _before_block(df, keys, aggs_full, aggs_body, names, pos, size, reach, fold):
    p = (F.col(pos) - 1) % size
    lead = p < size - reach
    per_block = (
        df.where(~F.col("_halo"))
        .groupBy(*keys, "_blk")
        .agg(*[a.alias(f"_f{i}") for i, a in enumerate(aggs_full)],
             *[a(lead).alias(f"_b{i}") for i, a in enumerate(aggs_body)])
    )
    w = Window.partitionBy(*keys).orderBy("_blk")
    older = w.rowsBetween(Window.unboundedPreceding, -2)
    return per_block.select(
        *keys, "_blk",
        *[fold(F.col(f"_f{i}"), F.lag(f"_b{i}", 1).over(w), older).alias(n)
          for i, n in enumerate(names)],
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    *,
    pos: str = "_g",
    size: int = BLOCK,
    halo: int = 0,
    depth: int = 0,
) -> DataFrame:
    """Fill each column with its latest non-null value so far in the key, across blocks.

    The first `depth` look-back copies of a block cannot know their own value (their own look-back
    is missing); what they hold is taken from the block they were copied from.
    """
    keys = list(keys)
    g = F.col(pos)

    def full(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), g))

    def lead(c):
        return lambda ok: F.max_by(c, F.when(F.col(c).isNotNull() & ok, g))

    def fold(f, b, older):
        return F.coalesce(b, F.last(f, ignorenulls=True).over(older))

    names = [f"_in_{c}" for c in cols]
    carried = _before_block(
        df, keys, [full(c) for c in cols], [lead(c) for c in cols], names, pos, size,
        halo - depth, fold
    )
    run = block_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(carried, [*keys, "_blk"], "left")
    for c, n in zip(cols, names):
        out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(run), F.col(n))).drop(n)
    return out


def previous_max(
    df: DataFrame, keys: Sequence[str], col: str, out: str, *, pos: str = "_g", size: int = BLOCK
) -> DataFrame:
    """Largest value of `col` over the key's earlier rows (null on the first one)."""
    keys = list(keys)
    per_block = df.groupBy(*keys, "_blk").agg(F.max(col).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*keys, "_blk", F.max("_m").over(before).alias("_in"))
    w = block_window(keys, pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(carried, [*keys, "_blk"], "left")
        .withColumn(out, F.greatest(F.max(col).over(w), F.col("_in")))
        .drop("_in")
    )


def islands(
    df: DataFrame, keys: Sequence[str], starts: Column, out: str, *, pos: str = "_g",
    size: int = BLOCK, halo: int = 0, depth: int = 0,
) -> DataFrame:
    """Position of the first row of the run each row belongs to; `starts` marks run heads."""
    marked = df.withColumn(out, F.when(starts, F.col(pos)))
    return carry_last(marked, keys, [out], pos=pos, size=size, halo=halo, depth=depth)
