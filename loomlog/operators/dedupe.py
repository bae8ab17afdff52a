"""Messages delivered at least once: keep exactly one copy of each.

Partition by identifier, rank by arrival with a deterministic tie-break, keep
the first. ``row_number() = 1`` lets Spark prune every map task to one row per
identifier before the shuffle, so a group of copies of any size stays small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.scratch import free_name, stage


def first_copies(df: DataFrame, identifier: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Exactly one row per identifier: the first by ``arrival`` (nulls last).

    Rows with a null in ``identifier`` identify no message and are all kept.
    Rows equal in every ``arrival`` column are interchangeable; one is kept.
    """
    known = _known(identifier)
    return _firsts(df.where(known), identifier, arrival).unionByName(df.where(~known))


def _known(identifier: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in identifier:
        known = known & F.col(c).isNotNull()
    return known


def _firsts(known: DataFrame, identifier: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in arrival]
    rank = free_name(known, "_rank")
    ranked = known.withColumn(rank, F.row_number().over(Window.partitionBy(*identifier).orderBy(*order)))
    return ranked.where(F.col(rank) == 1).drop(rank)


def surplus_copies(df: DataFrame, identifier: Sequence[str], arrival: Sequence[str], row_id: str) -> DataFrame:
    """The ``row_id`` of every row that is not a first copy.

    The complement is taken by an anti join on ``row_id``, which is unique, so
    it is spread evenly however large a group of copies is. Rows with a null in
    ``identifier`` are copies of nothing; rows with a null ``row_id`` cannot be
    named and do not appear.
    """
    known, kept = df.where(_known(identifier)), free_name(df, "_kept")
    keep = _firsts(known, identifier, arrival).select(F.col(row_id).alias(kept))
    return known.where(F.col(row_id).isNotNull()).select(row_id).join(keep, F.col(row_id) == F.col(kept), "left_anti")


def only_unseen(batch: DataFrame, seen: DataFrame, identifier: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """First copies of a new batch whose identifiers are not stored in ``seen``.

    The batch is reduced to one row per identifier first, so no side of the
    anti join has a hot key. Null identifiers are never stored and always pass.
    """
    return first_copies(batch, identifier, arrival).join(seen.select(*identifier).distinct(), list(identifier), "left_anti")


def in_batches(df: DataFrame, batch: str, borders: list, identifier: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """First copies of batches that arrive one after the other, each checked against what is stored of those before.

    A batch has the values of ``batch`` up to a border, the last one the rest
    and nulls. Every batch is stored before the next is looked at. What is kept
    is the first copy by batch, then by ``arrival``.
    """
    kept, low = None, None
    for high in [*borders, None]:
        own = F.lit(True) if low is None else F.coalesce(F.col(batch) > low, F.lit(True))
        if high is not None:
            own = own & (F.col(batch) <= high)
        elif low is None:
            own = F.lit(True)
        new = df.where(own)
        new = stage(first_copies(new, identifier, arrival) if kept is None else only_unseen(new, kept, identifier, arrival).select(*df.columns), "batch")
        kept = new if kept is None else kept.unionByName(new)
        low = high
    return kept
