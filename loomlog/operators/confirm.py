"""Confirmed watermarks: how far each partition is contiguously confirmed.

Not Spark's event-time watermark: the watermark W of a partition is the number
of its events, counted from sequence 0, of which each is present and confirmed
by a quorum. A sequence is readable if it is below W.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.operators.blocks import BLOCK, block_of
from loomlog.publish import Published
from loomlog.scratch import sized

MARKS = "partition_id int, confirmed_watermark bigint, highest_version bigint"


def watermarks(log: DataFrame, quorum: int = 2, skipped: DataFrame | None = None, forced: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(partition_id, confirmed_watermark, highest_version) of each partition.

    Each block of a partition's sequence tells its first missing or unconfirmed
    sequence; only these rows, one per block, meet in a window. A null count is
    unconfirmed; the highest count of repeated rows holds. ``skipped``
    (partition_id, partition_sequence) count as confirmed; ``forced``
    (partition_id, confirmed_watermark) can only move a watermark forward.
    """
    size = 1 << (block - 1).bit_length()
    e = log.where("partition_id is not null and partition_sequence is not null").select("partition_id", "partition_sequence", F.coalesce("confirmation_count", F.lit(0)).alias("count"))
    if skipped is not None:
        e = e.unionByName(skipped.select("partition_id", "partition_sequence", F.lit(quorum).alias("count")))
    e = e.withColumn("block", block_of("partition_sequence", block))
    once = e.repartition("partition_id", "block").groupBy("partition_id", "block", "partition_sequence").agg(F.max("count").alias("count"))
    place = F.col("block") * size + F.row_number().over(Window.partitionBy("partition_id", "block").orderBy("partition_sequence")) - 1
    numbered = once.withColumn("place", place)
    bad = F.when((F.col("partition_sequence") != F.col("place")) | (F.col("count") < quorum), F.col("place"))
    blocks = numbered.groupBy("partition_id", "block").agg(F.min(bad).alias("bad"), F.count(F.lit(1)).alias("n"), F.max("partition_sequence").alias("top"))
    following = F.lead("block").over(Window.partitionBy("partition_id").orderBy("block"))
    stop = F.coalesce("bad", F.when(F.col("n") < size, F.col("block") * size + F.col("n")), F.when(following.isNull() | (following != F.col("block") + 1), (F.col("block") + 1) * size))
    w = blocks.withColumn("stop", stop).groupBy("partition_id").agg(F.min("stop").alias("stop"), F.min("block").alias("first"), (F.max("top") + 1).alias("highest_version"))
    out = w.select("partition_id", F.when(F.col("first") > 0, F.lit(0)).otherwise(F.col("stop")).cast("bigint").alias("confirmed_watermark"), F.col("highest_version").cast("bigint").alias("highest_version"))
    if forced is None:
        return out
    f = forced.groupBy("partition_id").agg(F.max("confirmed_watermark").alias("forced"))
    return out.join(f, "partition_id", "full").select("partition_id", F.greatest("confirmed_watermark", "forced").alias("confirmed_watermark"), F.greatest("highest_version", "forced").alias("highest_version"))


def gaps(marks: DataFrame) -> DataFrame:
    """How many versions each partition is ahead of its watermark."""
    return marks.select("partition_id", (F.col("highest_version") - F.col("confirmed_watermark")).alias("confirmation_gap"))


def unconfirmed(log: DataFrame, marks: DataFrame, quorum: int = 2) -> DataFrame:
    """Events at or above the watermark that lack a quorum: what holds a partition up.

    The watermarks are broadcast if there are as few as partitions can be.
    """
    return log.join(sized(marks.select("partition_id", "confirmed_watermark"), 1 << 16, "marks"), "partition_id").where(
        (F.col("partition_sequence") >= F.col("confirmed_watermark")) & (F.coalesce("confirmation_count", F.lit(0)) < quorum)
    )


def stuck(pending: DataFrame, now_ns: int | str, min_attempts: int, min_age_ns: int) -> DataFrame:
    """Unconfirmed events tried often enough and old enough: (…, attempts, first_seen_ns); ``now_ns``: a time or a column."""
    now = F.col(now_ns) if isinstance(now_ns, str) else F.lit(now_ns)
    return pending.where((F.col("attempts") >= min_attempts) & (now - F.col("first_seen_ns") >= min_age_ns))


def stats(log: DataFrame, marks: DataFrame, quorum: int = 2, buckets: int = 4) -> DataFrame:
    """One row: buckets, partitions, confirmed and unconfirmed events, largest gap."""
    m = marks.agg(
        F.count_distinct(F.col("partition_id") % buckets).alias("buckets"), F.count(F.lit(1)).alias("partitions"), F.sum("confirmed_watermark").alias("confirmed"),
        F.sum(F.col("highest_version") - F.col("confirmed_watermark")).alias("unconfirmed"), F.max(F.col("highest_version") - F.col("confirmed_watermark")).alias("max_gap"),
    )
    return m


def validate(log: DataFrame, stated: DataFrame, quorum: int = 2) -> DataFrame:
    """Compare stated watermarks with the events: (partition_id, stated, actual, verdict); it only reports."""
    actual = watermarks(log, quorum)
    j = stated.select("partition_id", F.col("confirmed_watermark").alias("stated")).join(actual.select("partition_id", F.col("confirmed_watermark").alias("actual")), "partition_id", "full")
    verdict = F.when(F.col("actual").isNull(), "no events").when(F.col("stated").isNull(), "not stated").when(F.col("stated") > F.col("actual"), "too high").when(F.col("stated") < F.col("actual"), "behind").otherwise("ok")
    return j.select("partition_id", "stated", "actual", verdict.alias("verdict"))


def confirm(log: DataFrame, claims: DataFrame) -> DataFrame:
    """Check confirmations from a replica against the stored events, as rows.

    ``claims``: partition_id, partition_sequence, event_id, confirmation_count.
    """
    have = log.select("partition_id", "partition_sequence", F.col("event_id").alias("stored_id"))
    status = F.when(F.col("stored_id").isNull(), "missing").when(F.col("stored_id") != F.col("event_id"), "other event").otherwise("ok")
    return claims.join(have, ["partition_id", "partition_sequence"], "left").withColumn("status", status).drop("stored_id")


def check_updates(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates of confirmation counts with their status: OK, or why they cannot be made.

    ``updates``: partition_id, partition_sequence, confirmation_count and, where
    it matters, transaction_id (null: whatever the event has). Of several for
    one event the highest count holds. A count lies between 0 and 12.
    """
    tx = F.col("transaction_id") if "transaction_id" in updates.columns else F.lit(None).cast("string")
    u = updates.select("partition_id", "partition_sequence", "confirmation_count", tx.alias("transaction_id")).groupBy("partition_id", "partition_sequence", "transaction_id").agg(F.max("confirmation_count").alias("confirmation_count"))
    have = log.select(F.col("partition_id").alias("_p"), F.col("partition_sequence").alias("_s"), F.col("transaction_id").alias("_t"))
    j = u.join(have, (F.col("partition_id") == F.col("_p")) & (F.col("partition_sequence") == F.col("_s")), "left")
    status = F.when(F.col("_s").isNull(), "NOTFOUND").when(F.col("transaction_id") != F.col("_t"), "NOTFOUND").when(
        F.coalesce(~F.col("confirmation_count").between(0, 12), F.lit(True)), "INVALIDARG"
    ).otherwise("OK")
    return j.select("partition_id", "partition_sequence", "transaction_id", "confirmation_count", status.alias("status"))


class Snapshots:
    """Watermarks on disk: every save is a new directory, published by one marker; the last published is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.published = spark, Published(spark, path)

    def load(self) -> DataFrame | None:
        last = self.published.last()
        return self.spark.read.schema(MARKS).parquet(f"{last}/marks") if last else None

    def save(self, marks: DataFrame) -> int:
        """Publish new watermarks; none of them moves back behind the current ones."""
        number, now = self.published.next_number(), self.load()
        if now is not None:
            both = marks.select(*now.columns).unionByName(now)
            marks = both.groupBy("partition_id").agg(F.max("confirmed_watermark").alias("confirmed_watermark"), F.max("highest_version").alias("highest_version"))
        folder = self.published.new_folder(number)
        marks.write.parquet(f"{folder}/marks")
        self.published.publish(number, folder)
        return number

    def due(self, changes: int, seconds: float) -> bool:
        """Whether it is time to save: after more than 100 changes or 5 seconds."""
        return changes > 100 or seconds > 5 and changes > 0

    def reopen(self, log: DataFrame, quorum: int = 2) -> DataFrame:
        """Watermarks after a restart: the saved ones, moved on by the events stored since; only these are read."""
        now = self.load()
        if now is None:
            return watermarks(log, quorum)
        saved = sized(now.select(F.col("partition_id").alias("_p"), F.col("confirmed_watermark").alias("_w")), 1 << 16, "marks")
        later = log.join(saved, F.col("partition_id") == F.col("_p"), "left").where(F.coalesce("_w", F.lit(0)) <= F.col("partition_sequence"))
        shifted = later.withColumn("partition_sequence", F.col("partition_sequence") - F.coalesce("_w", F.lit(0)))
        moved = watermarks(shifted, quorum).select("partition_id", F.col("confirmed_watermark").alias("more"), F.col("highest_version").alias("top"))
        both = now.join(moved, "partition_id", "full")
        base = F.coalesce("confirmed_watermark", F.lit(0))
        return both.select("partition_id", (base + F.coalesce("more", F.lit(0))).alias("confirmed_watermark"), F.greatest(F.col("highest_version"), base + F.col("top")).alias("highest_version"))
