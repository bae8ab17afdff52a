"""Reads of the log: points, ranges, versions, transactions, and their visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions import ids
from loomlog.operators.blocks import BLOCK, block_of
from loomlog.operators.confirm import watermarks
from loomlog.scratch import sized
from loomlog.sources.log import once, wire

DEFAULT_COUNT = 100


def committed(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Events of finished transactions: flagged as single, or complete under a commit record.

    Counts are taken per transaction with map-side combining, and only of
    multi-event transactions. A commit without a count commits what is there.
    """
    single = ids.single_event("transaction_id")
    kept = log.where(~single).join(_whole(log, commits), F.col("transaction_id") == F.col("_tx"), "left_semi")
    return log.where(single).unionByName(kept)


def _whole(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Ids (_tx) of the transactions of several events that are complete in ``log``."""
    counts = log.where(~ids.single_event("transaction_id")).groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    done = commits.where("transaction_id is not null").groupBy("transaction_id").agg(F.max("event_count").alias("event_count"))
    return counts.join(done, "transaction_id").where(F.col("event_count").isNull() | (F.col("event_count") == F.col("n"))).select(F.col("transaction_id").alias("_tx"))


def below_watermark(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of the log under the watermark of their partition; the side of watermarks is broadcast if it fits."""
    w = sized(marks.select(F.col("partition_id").alias("_p"), F.col("confirmed_watermark").alias("_w")), 1 << 16, "marks")
    return log.join(w, (F.col("partition_id") == F.col("_p")) & (F.col("partition_sequence") < F.col("_w"))).drop("_p", "_w")


def visible(log: DataFrame, commits: DataFrame, quorum: int = 2, marks: DataFrame | None = None) -> DataFrame:
    """Committed events below the confirmed watermark of their partition."""
    below = below_watermark(once(log), marks if marks is not None else watermarks(log, quorum))
    return committed(below, commits)


def visible_among(rows: DataFrame, log: DataFrame, commits: DataFrame, marks: DataFrame) -> DataFrame:
    """The visible ones of some rows of a log, for reads of few of them.

    Whether a transaction is complete is looked up for the transactions of the
    rows only, in ``log``, which may be cut to their partitions.
    """
    single = ids.single_event("transaction_id")
    own = below_watermark(once(rows), marks)
    wanted = own.where(~single).select(F.col("partition_id").alias("_p"), F.col("transaction_id").alias("_t")).distinct()
    several = log.where(~single).join(wanted, (F.col("partition_id") == F.col("_p")) & (F.col("transaction_id") == F.col("_t")), "left_semi")
    whole = _whole(below_watermark(once(several), marks), commits)
    return own.where(single).unionByName(own.where(~single).join(whole, F.col("transaction_id") == F.col("_tx"), "left_semi"))


def filter_commit(events: DataFrame, stream_id: str) -> DataFrame:
    """Transactions as a reader of one stream sees them: without the events of other streams; those with none of it are gone."""
    return events.where(F.col("stream_id") == stream_id).groupBy("partition_id", "transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("stream_version").alias("first_version"), F.max("stream_version").alias("last_version")
    )


def get_event(log: DataFrame, event_id: str, partitions: int = ids.PARTITIONS) -> DataFrame:
    """The event of an id. Its partition follows from the id itself, so one directory is read."""
    key = str(event_id).strip().lower().removeprefix("urn:uuid:").strip("{}").replace("-", "")
    canonical = f"{key[:8]}-{key[8:12]}-{key[12:16]}-{key[16:20]}-{key[20:]}"
    partition = ((int(key, 16) >> 46) & 0xFFFF) % partitions
    return log.where((F.col("partition_id") == partition) & (F.col("event_id") == canonical))


def stream_of(log: DataFrame, stream_id: str, partition: int | None = None, buckets: int = ids.BUCKETS) -> DataFrame:
    """Events of a stream. A stream lives in a bucket: a partition only says which."""
    own = log.where(F.col("stream_id") == stream_id)
    return own if partition is None else own.where(F.col("partition_id") % buckets == partition % buckets)


def scan_stream(log: DataFrame, stream_id: str, start: int = 0, end: int | None = None, partition: int | None = None, count: int | None = DEFAULT_COUNT, reverse: bool = False, buckets: int = ids.BUCKETS) -> DataFrame:
    """Events of a stream by version, both ends inclusive; ``reverse`` goes down from ``start``."""
    s = stream_of(log, stream_id, partition, buckets)
    return _scan(s, "stream_version", start, end, count, reverse)


def scan_partition(log: DataFrame, partition: int, start: int = 0, end: int | None = None, count: int | None = DEFAULT_COUNT, reverse: bool = False) -> DataFrame:
    """Events of a partition by sequence, both ends inclusive; ``reverse`` goes down from ``start``."""
    return _scan(log.where(F.col("partition_id") == partition), "partition_sequence", start, end, count, reverse)


def _scan(df: DataFrame, position: str, start: int, end: int | None, count: int | None, reverse: bool) -> DataFrame:
    p = F.col(position)
    if reverse:
        df = df.where(p <= start) if start < 1 << 63 else df
        df = df if end is None else df.where(p >= end)
    else:
        df = df.where(p >= start)
        df = df if end is None else df.where(p <= end)
    ordered = df.orderBy(p.desc() if reverse else p.asc())
    return ordered if count is None else ordered.limit(count)


def page(scan: DataFrame, position: str, count: int) -> DataFrame:
    """One row: has_more and the events of a page, in order. ``scan`` was limited to count + 1.

    Only a page comes together here, never a range.
    """
    fields = F.struct(F.col(position).alias("_at"), *[F.col(c) for c in wire(scan).columns])
    rows = wire(scan).select(fields.alias("e")).agg(F.array_sort(F.collect_list("e")).alias("all"))
    return rows.select((F.size("all") > count).alias("has_more"), F.slice("all", 1, count).alias("events")) if count else rows.select((F.size("all") > 0).alias("has_more"), F.slice("all", 1, 0).alias("events"))


def stream_versions(log: DataFrame, buckets: int = ids.BUCKETS) -> DataFrame:
    """Current version and partition key of every stream; a stream is one per bucket."""
    return log.groupBy(ids.bucket_id("partition_id", buckets).alias("bucket_id"), "stream_id").agg(
        F.max("stream_version").alias("stream_version"), F.max_by("partition_key", "stream_version").alias("partition_key")
    )


def stream_version(log: DataFrame, stream_id: str, partition: int | None = None, buckets: int = ids.BUCKETS) -> DataFrame:
    """One row with the current version; null for a stream without events."""
    return stream_of(log, stream_id, partition, buckets).agg(F.max("stream_version").alias("stream_version"))


def partition_sequences(log: DataFrame) -> DataFrame:
    return log.groupBy("partition_id").agg(F.max("partition_sequence").alias("partition_sequence"))


def confirmed_sequences(marks: DataFrame) -> DataFrame:
    """Highest readable sequence of each partition; null while nothing is confirmed."""
    return marks.select("partition_id", F.when(F.col("confirmed_watermark") > 0, F.col("confirmed_watermark") - 1).alias("partition_sequence"))


def read_transaction(log: DataFrame, event_id: str, partitions: int = ids.PARTITIONS) -> DataFrame:
    """The events of an event's transaction from that event on."""
    first = get_event(log, event_id, partitions).select(F.col("partition_id").alias("_p"), F.col("transaction_id").alias("_t"), F.col("partition_sequence").alias("_s"))
    return log.join(first, (F.col("partition_id") == F.col("_p")) & (F.col("transaction_id") == F.col("_t")) & (F.col("partition_sequence") >= F.col("_s"))).drop("_p", "_t", "_s")


def transactions(log: DataFrame, commits: DataFrame, block: int = 1 << 12) -> DataFrame:
    """Committed events per transaction: (transaction_id, partition_id, single, n, first/last sequence, event_ids in order).

    Ids are ordered and joined in blocks of the sequence, so no task holds the
    events of a long transaction; only the text of its blocks comes together. That
    list is one value: beyond the 2 GB of one (some 58 million ids) the query fails.
    """
    c = committed(once(log), commits).withColumn("_block", block_of("partition_sequence", block))
    ordered = F.array_sort(F.collect_list(F.when(F.col("event_id").isNotNull(), F.struct("partition_sequence", "event_id"))))
    blocks = c.groupBy("transaction_id", "_block").agg(
        F.min("partition_id").alias("partition_id"), F.count(F.lit(1)).alias("n"), F.min("partition_sequence").alias("first_sequence"), F.max("partition_sequence").alias("last_sequence"), ordered.alias("e")
    ).withColumn("ids", F.when(F.size("e") > 0, F.array_join("e.event_id", ","))).drop("e")
    texts = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("_block", "ids"))))
    g = blocks.groupBy("transaction_id").agg(
        F.min("partition_id").alias("partition_id"), F.sum("n").alias("n"), F.min("first_sequence").alias("first_sequence"), F.max("last_sequence").alias("last_sequence"), texts.alias("t")
    )
    return g.select("transaction_id", "partition_id", ids.single_event("transaction_id").alias("single"), "n", "first_sequence", "last_sequence", F.when(F.size("t") > 0, F.array_join("t.ids", ",")).alias("event_ids"))


def stream_index(log: DataFrame) -> DataFrame:
    """Per stream of a bucket: key, first and last version, events."""
    return log.groupBy(ids.bucket_id("partition_id").alias("bucket_id"), "stream_id").agg(
        F.min("partition_key").alias("partition_key"), F.min("stream_version").alias("min_version"), F.max("stream_version").alias("max_version"), F.count(F.lit(1)).alias("n")
    )


def partition_index(log: DataFrame) -> DataFrame:
    """Per partition: first and last sequence, events."""
    return log.groupBy("partition_id").agg(F.min("partition_sequence").alias("min_sequence"), F.max("partition_sequence").alias("max_sequence"), F.count(F.lit(1)).alias("n"))


def out_of_sequence(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """Events whose sequence is not that of their predecessor plus one: (partition_id, partition_sequence, missing).

    Predecessors are looked up in blocks; the last sequence of each block is
    carried to the next.
    """
    from loomlog.operators.blocks import prefix_by_block

    e = once(log).select("partition_id", "partition_sequence", block_of("partition_sequence", block).alias("block"))
    before = prefix_by_block(e, ["partition_id"], "block", {"top": F.max("partition_sequence")}, {"top": "max"})
    w = Window.partitionBy("partition_id", "block").orderBy("partition_sequence")
    prev = F.coalesce(F.lag("partition_sequence").over(w), F.col("prev_top"), F.lit(-1))
    return e.join(before, ["partition_id", "block"]).select("partition_id", "partition_sequence", (F.col("partition_sequence") - prev - 1).alias("missing")).where("missing <> 0")
