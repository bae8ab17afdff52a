"""Per-period counts by event time, corrected as late events arrive.

A period's count is published once an event of a later period has arrived
(version 0). An event that is late, but not by more than the cut-off, then
retracts the published count and emits the next version: a negative delta of
the old value and a positive one of the new. Downstream aggregates apply the
deltas instead of recomputing.

Order of arrival is a gapless sequence per key, so everything ordered is done
in blocks of that sequence (see ``blocks``): a key with a third of all rows is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.blocks import BLOCK, block_of, block_rank, prefix_by_block
from loomlog.scratch import stage

HOUR_NS = 3_600_000_000_000


def classify(events: DataFrame, period_ns: int = HOUR_NS, lateness_ns: int = 6 * HOUR_NS, highs: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Each event (key, seq, ts) once, with its period and how it arrived.

    ``arrived`` is ``on_time`` (its period is not before that of the largest
    earlier timestamp of the key), ``late`` (before it, by at most
    ``lateness_ns``), ``dropped`` (later than that) or ``untimed`` (null ts).
    Rows of the same (key, seq) are one event; the smallest ts is taken if they
    disagree. A null key or seq identifies no event. ``highs`` (key, high) has
    the largest timestamps of earlier runs.
    """
    e = events.where("key is not null and seq is not null").select("key", "seq", "ts", block_of("seq", block).alias("block"))
    before = prefix_by_block(e, ["key"], "block", {"ts": F.max("ts")}, {"ts": "max"}).withColumnRenamed("prev_ts", "high_before")
    if highs is not None:
        before = before.join(highs.select("key", "high"), "key", "left").withColumn("high_before", F.greatest("high_before", "high")).drop("high")
    once = e.repartition("key", "block").groupBy("key", "block", "seq").agg(F.min("ts").alias("ts"))
    within = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    timed = once.join(before, ["key", "block"], "left").withColumn("high", F.greatest(F.max("ts").over(within), "high_before"))
    period, high_period = F.expr(f"ts div {period_ns}L"), F.expr(f"high div {period_ns}L")
    arrived = F.when(F.col("ts").isNull(), "untimed").when(F.col("high").isNull() | (period >= high_period), "on_time").when(
        F.try_subtract("high", "ts") <= lateness_ns, "late"
    ).otherwise("dropped")
    return timed.select("key", "seq", "ts", "block", period.alias("period"), "high", arrived.alias("arrived"))


def changelog(events: DataFrame, period_ns: int = HOUR_NS, lateness_ns: int = 6 * HOUR_NS, highs: DataFrame | None = None, counts: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per correction: (key, period, version, seq, old_count, new_count).

    ``seq`` is the late event that caused it; versions count from 1 within a
    (key, period), in order of arrival. ``counts`` (key, period, count, version)
    is the state that earlier runs left.
    """
    return _corrections(classify(events, period_ns, lateness_ns, highs, block), counts)


def _corrections(seen: DataFrame, counts: DataFrame | None) -> DataFrame:
    published = seen.where("arrived = 'on_time'").groupBy("key", "period").agg(F.count(F.lit(1)).alias("base"))
    if counts is not None:
        kept = counts.select("key", "period", F.col("count").alias("had"), F.col("version").alias("from_version"))
        published = published.join(kept, ["key", "period"], "full").select("key", "period", (F.coalesce("base", F.lit(0)) + F.coalesce("had", F.lit(0))).alias("base"), "from_version")
    else:
        published = published.withColumn("from_version", F.lit(0).cast("bigint"))
    late = block_rank(seen.where("arrived = 'late'").select("key", "period", "seq", "block"), ["key", "period"], "block", [F.col("seq")], "nth")
    old = F.coalesce("base", F.lit(0)) + F.col("nth")
    return late.join(published, ["key", "period"], "left").select(
        "key", "period", (F.coalesce("from_version", F.lit(0)) + F.col("nth") + 1).cast("bigint").alias("version"), "seq", old.cast("bigint").alias("old_count"), (old + 1).cast("bigint").alias("new_count")
    )


def deltas(log: DataFrame) -> DataFrame:
    """Corrections as signed rows: -old_count (none for a period without a count) and +new_count."""
    pair = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old_count").alias("count")), F.struct(F.lit(1).alias("sign"), F.col("new_count").alias("count")))
    return log.select("key", "period", "version", "seq", F.explode(pair).alias("d")).select(
        "key", "period", "version", "seq", "d.sign", "d.count"
    ).where("sign > 0 or count > 0")


def corrected_counts(events: DataFrame, period_ns: int = HOUR_NS, lateness_ns: int = 6 * HOUR_NS, block: int = BLOCK, by: dict[str, Column] | None = None) -> DataFrame:
    """The state after all corrections: what was published, and the deltas applied to it.

    Without ``by``: (key, period, published_count, corrections, count, dropped),
    dropped events counted beside the count, never in it. With ``by`` (names and
    expressions of key and period), the counts of a coarser key downstream:
    (*by, count, version), which see the published counts and the deltas of the
    finer ones and nothing else.
    """
    seen = stage(classify(events, period_ns, lateness_ns, None, block).where("arrived <> 'untimed'").select("key", "period", "seq", "block", "arrived"), "arrived")
    published = seen.groupBy("key", "period").agg(F.count(F.when(F.col("arrived") == "on_time", 1)).alias("count"), F.count(F.when(F.col("arrived") == "dropped", 1)).alias("dropped"))
    changes = deltas(_corrections(seen, None))
    if by:
        names = list(by)
        state = published.select(*[c.alias(n) for n, c in by.items()], "count").groupBy(*names).agg(F.sum("count").alias("count"), F.lit(0).cast("bigint").alias("version"))
        return apply_deltas(state, changes.select(*[c.alias(n) for n, c in by.items()], "sign", "count"), names).where("count > 0")
    now = apply_deltas(published.select("key", "period", "count", F.lit(0).cast("bigint").alias("version")), changes, ["key", "period"])
    return published.withColumnRenamed("count", "published_count").join(now, ["key", "period"]).select("key", "period", "published_count", F.col("version").alias("corrections"), "count", "dropped")


def apply_deltas(state: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Propagate deltas to a coarser keyed state (*by, count, version): one signed sum per key.

    ``changes`` has ``by``, sign, count and version. The new version of a key
    is the number of corrections that it has seen.
    """
    net = changes.groupBy(*by).agg(F.sum(F.col("sign") * F.col("count")).alias("net"), F.count(F.when(F.col("sign") > 0, 1)).alias("seen"))
    return state.join(net, by, "full").select(
        *by, (F.coalesce("count", F.lit(0)) + F.coalesce("net", F.lit(0))).cast("bigint").alias("count"), (F.coalesce("version", F.lit(0)) + F.coalesce("seen", F.lit(0))).cast("bigint").alias("version")
    )
