"""Ordered computations over groups of any size, done in bounded blocks.

A group that holds a third of all rows would put a plain window into one task.
Here the order is cut into blocks; only one summary row per block meets in a
window over the group, and each block is then finished on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def block_of(position: Column | str, size: int = BLOCK) -> Column:
    """Number of the block of consecutive positions that a position lies in."""
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / F.lit(size)).cast("bigint") if size < 2 else F.shiftright(c.cast("bigint"), (size - 1).bit_length())


def prefix_by_block(df: DataFrame, keys: list[str], block: str, aggs: dict[str, Column], over: dict[str, str]) -> DataFrame:
    """One row per (keys, block) with each aggregate of the blocks before it.

    ``aggs`` names per-block aggregates; ``over`` says how each is combined over
    earlier blocks (``sum`` or ``max``). Output columns are ``prev_<name>``.
    """
    per_block = df.groupBy(*keys, block).agg(*[c.alias(n) for n, c in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(*keys, block, *[getattr(F, over[n])(n).over(before).alias(f"prev_{n}") for n in aggs])


def block_rank(df: DataFrame, keys: list[str], block: str, order: list, to: str = "rank") -> DataFrame:
    """Rank from 0 within ``keys`` by (block, order); no task sees more than a block of a group.

    Ties in ``order`` get adjacent ranks. Keys and blocks must not be null. The
    rows are shuffled once: counts and window use the same partitioning.
    """
    names = [*keys, block]
    counts = prefix_by_block(df, keys, block, {"n": F.count(F.lit(1))}, {"n": "sum"})
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1 + F.coalesce("prev_n", F.lit(0))
    return df.join(counts, names, "left").withColumn(to, rank.cast("bigint")).drop("prev_n")
