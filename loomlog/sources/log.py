"""The log's tables: loading, deriving, storing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import ids
from loomlog.operators.blocks import block_of, block_rank
from loomlog.scratch import free_name

EVENT = (
    "event_id string, partition_key string, partition_id int, transaction_id string, partition_sequence bigint, stream_version bigint, "
    "timestamp_ns bigint, confirmation_count int, stream_id string, event_name string, metadata binary, payload binary"
)
COMMIT = "transaction_id string, timestamp_ns bigint, confirmation_count int, event_count int"
#: What a reader of the log gets of an event; the time is in milliseconds.
WIRE = ["event_id", "partition_key", "partition_id", "transaction_id", "partition_sequence", "stream_version", "timestamp", "stream_id", "event_name", "metadata", "payload"]


def once(log: DataFrame) -> DataFrame:
    """The log with each (partition_id, partition_sequence) once, in blocks of the sequence."""
    block = free_name(log, "_block")
    rows = log.where("partition_id is not null and partition_sequence is not null").withColumn(block, block_of("partition_sequence", 1 << 12))
    return rows.repartition("partition_id", block).dropDuplicates(["partition_id", block, "partition_sequence"]).drop(block)


def wire(events: DataFrame) -> DataFrame:
    """The fields that a reply carries."""
    return events.withColumn("timestamp", F.expr("timestamp_ns div 1000000")).select(*WIRE)


def derive(events: DataFrame, partitions: int = ids.PARTITIONS, buckets: int = ids.BUCKETS) -> DataFrame:
    """A log from a plain table of (event_id, ts, user_id, event_type, value, props): a stream per user.

    Sequences and versions are numbered by event_id in blocks, so a user with a
    third of all events is numbered by many tasks.
    """
    stream = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    key = ids.default_partition_key(stream)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select(F.col("event_id").alias("no"), stream.alias("stream_id"), key.alias("partition_key"), us.alias("us"), "event_type", "props")
    e = e.withColumn("phash", ids.partition_hash("partition_key")).withColumn("partition_id", (F.col("phash") % partitions).cast("int")).withColumn("block", block_of("no"))
    e = block_rank(e, ["partition_id"], "block", [F.col("no")], "partition_sequence")
    e = block_rank(e, ["stream_id"], "block", [F.col("no")], "stream_version")
    tx = F.sha1(F.concat_ws("/", F.col("partition_id").cast("string"), F.floor(F.col("no") / 4).cast("string")).cast("binary"))
    return e.select(
        ids.event_id(F.floor(F.col("us") / 1000), "phash", F.sha1(F.col("no").cast("string").cast("binary"))).alias("event_id"), "partition_key", "partition_id",
        ids.bucket_id("partition_id", buckets).alias("bucket_id"), ids.dashed(F.substring(tx, 1, 32)).alias("transaction_id"), "partition_sequence", "stream_version",
        (F.col("us") * 1000).alias("timestamp_ns"), F.when(F.col("no") % 97 == 96, 1).otherwise(2).alias("confirmation_count"), "stream_id", F.col("event_type").alias("event_name"),
        F.lit(b"").cast("binary").alias("metadata"), F.encode(F.coalesce("props", F.lit("")), "UTF-8").alias("payload"), F.col("no").alias("event_no"),
    )


def write(log: DataFrame, path: str, partitions: int, buckets: int, mode: str = "errorifexists") -> None:
    """Store a log: directories by bucket and partition, sorted by sequence, bloom filters for ids and streams, zstd."""
    spark = log.sparkSession
    laid = log.withColumn("bucket_id", ids.bucket_id("partition_id", buckets)).withColumn("_block", block_of("partition_sequence", 1 << 20))
    # a hot partition is written by one task per block of it, not by one task
    laid.repartition("bucket_id", "partition_id", "_block").sortWithinPartitions("bucket_id", "partition_id", "partition_sequence").drop("_block").write.mode(mode).option(
        "compression", "zstd"
    ).option("parquet.bloom.filter.enabled#event_id", "true").option("parquet.bloom.filter.enabled#stream_id", "true").partitionBy("bucket_id", "partition_id").parquet(f"{path}/events")
    _write_text(spark, f"{path}/_engine_meta.json", json.dumps({"version": 1, "partitions": partitions, "buckets": buckets}))


def read(spark: SparkSession, path: str, partitions: int | None = None, buckets: int | None = None) -> DataFrame:
    """Open a stored log; a different number of partitions or buckets than it was made with is refused."""
    meta = json.loads(_read_text(spark, f"{path}/_engine_meta.json"))
    for name, wanted in (("partitions", partitions), ("buckets", buckets)):
        if wanted is not None and meta[name] != wanted:
            raise ValueError(f"the log has {meta[name]} {name}, not {wanted}")
    return spark.read.schema(EVENT + ", bucket_id int").parquet(f"{path}/events")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def encode_record(log: DataFrame) -> DataFrame:
    """The record view of events: stored confirmation byte, record header and CRC-32 of the payload."""
    return log.select(
        "event_id", "partition_id", "partition_sequence", ids.confirmation_byte("confirmation_count").alias("confirmation_byte"),
        ids.record_header("timestamp_ns", False)["timestamp_ns"].alias("header_ns"), F.crc32("payload").alias("payload_crc"), F.length("payload").cast("bigint").alias("payload_bytes"),
    )


def latest_confirmations(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Counts as they are now: the log's own, overridden by the last update (update_no) of each event."""
    last = updates.groupBy("partition_id", "partition_sequence").agg(F.max_by("confirmation_count", "update_no").alias("_count"))
    return log.join(last, ["partition_id", "partition_sequence"], "left").withColumn("confirmation_count", F.coalesce("_count", "confirmation_count")).drop("_count").select(*log.columns)


__all__ = ["COMMIT", "EVENT", "WIRE", "Window", "derive", "encode_record", "latest_confirmations", "once", "read", "wire", "write"]
