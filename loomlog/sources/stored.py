"""A log on disk that grows by batches, each visible as a whole or not at all.

A batch is a folder with events, commit records, confirmations, and the heads:
the newest version of every stream and the next sequence of every partition
that it wrote to. Appends are judged against the heads, which are small beside
the events, so no append reads the log. A batch that was not published, because
its run died or lost a race, is never read; ``recover`` deletes what is left.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.config import LogConfig
from loomlog.functions import ids
from loomlog.operators import append as appends
from loomlog.operators import confirm
from loomlog.operators.blocks import block_of
from loomlog.publish import Published
from loomlog.scratch import sized
from loomlog.sources import log as tables

HEAD = "bucket_id int, stream_id string, partition_key string, stream_version bigint"
TOP = "partition_id int, next_sequence bigint"
CONFIRMATION = "partition_id int, partition_sequence bigint, confirmation_count int, update_no bigint"
RESULT = "request_no bigint, tx_no bigint, partition_id int, bucket_id int, stream_id string, status string, message string, stream_version bigint, partition_sequence bigint"
REPLY = ["request_no", "tx_no", "status", "message", "event_id", "partition_key", "partition_id", "transaction_id", "partition_sequence", "stream_id", "stream_version", "timestamp"]


class StoredLog:
    """Opened by its path; made there, with the settings given, if nothing is stored yet."""

    def __init__(self, spark: SparkSession, path: str, config: LogConfig | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.config = (config or LogConfig()).validate()
        self.published = Published(spark, self.path)
        wanted = {"version": 1, "partitions": self.config.partitions, "buckets": self.config.buckets}
        meta = f"{self.path}/_engine_meta.json"
        if not self.published._fs.exists(self.published._Path(meta)):
            tables._write_text(spark, meta, json.dumps(wanted))
        have = json.loads(tables._read_text(spark, meta))
        for name, value in wanted.items():
            if have[name] != value:
                raise ValueError(f"the log has {name} {have[name]}, not {value}")

    def batches(self) -> list[str]:
        """The folders that make up the log: from the last compacted one on."""
        folders = [f for _, f in self.published.runs()]
        whole = [i for i, f in enumerate(folders) if f.endswith("-whole")]
        return folders[whole[-1] if whole else 0 :]

    def recover(self) -> None:
        """Delete what unpublished or replaced batches left behind. Not while a writer or an older reader is at work."""
        batches = self.batches()
        self.published.forget(min((n for n, f in self.published.runs() if f in batches), default=0))
        fs, root = self.published._fs, self.published._Path(f"{self.path}/events")
        kept = {f"batch={_name(f)}" for f in batches}
        for s in fs.listStatus(root) if fs.exists(root) else []:
            if s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)

    def _read(self, name: str, schema: str) -> DataFrame:
        folders = [f"{f}/{name}" for f in self.batches() if self.published._fs.exists(self.published._Path(f"{f}/{name}"))]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        """All events with their newest confirmation counts; directories are pruned by bucket and partition."""
        batches = self.batches()
        if not batches:
            return self.spark.createDataFrame([], tables.EVENT + ", bucket_id int")
        found = self.spark.read.schema(tables.EVENT + ", bucket_id int, batch string").parquet(f"{self.path}/events").where(F.col("batch").isin([_name(f) for f in batches])).drop("batch")
        if not any(self.published._fs.exists(self.published._Path(f"{f}/confirmations")) for f in self.batches()):
            return found
        return tables.latest_confirmations(found, self._read("confirmations", CONFIRMATION))

    def commits(self) -> DataFrame:
        return self._read("commits", tables.COMMIT)

    def heads(self) -> DataFrame:
        """(bucket_id, stream_id, partition_key, stream_version): the current version of every stream."""
        h = self._read("heads", HEAD)
        return h.groupBy("bucket_id", "stream_id").agg(F.max_by("partition_key", "stream_version").alias("partition_key"), F.max("stream_version").alias("stream_version"))

    def tops(self) -> DataFrame:
        """(partition_id, next_sequence) of every partition that has events."""
        return self._read("tops", TOP).groupBy("partition_id").agg(F.max("next_sequence").alias("next_sequence"))

    def append(self, requests: DataFrame, atomic: bool = False, confirmations: int = 1, now_ms: int | None = None) -> DataFrame:
        """Judge requests against the log and store those that are accepted; returns a reply for each request.

        ``requests`` as for ``operators.append.append``, with payload and
        metadata (null: empty). Events without an id get one that carries their
        partition's hash, events without a time the time of the batch. Only
        transactions of several events get a commit record. Nothing of a refused
        transaction is stored and it uses up no number. Request numbers must be
        unique in a batch. Replies come after all is published.
        """
        c = self.config
        number = self.published.next_number()
        folder = self.published.new_folder(number)
        batch = uuid.uuid4().hex
        now = now_ms if now_ms is not None else time.time_ns() // 1_000_000
        given = {f.name.lower() for f in requests.schema}
        r = requests.withColumn("partition_key", F.coalesce("partition_key" if "partition_key" in given else F.lit(None).cast("string"), ids.default_partition_key("stream_id")))
        for name, kind in (("payload", "binary"), ("metadata", "binary"), ("event_id", "string"), ("timestamp_ms", "bigint")):
            r = r.withColumn(name, F.col(name).cast(kind) if name in given else F.lit(None).cast(kind))
        if not atomic:
            r = r.withColumn("tx_no", F.col("request_no"))
        r.write.parquet(f"{folder}/requests")
        r = self.spark.read.schema(r.schema).parquet(f"{folder}/requests")
        streams = r.select(ids.bucket_id(ids.partition_id("partition_key", c.partitions), c.buckets).alias("bucket_id"), "stream_id").distinct()
        known = self.heads().join(streams, ["bucket_id", "stream_id"], "left_semi")
        tops = self.tops()
        judged = appends.append(r, c.strict_versioning, c.partitions, c.buckets, atomic, known, tops, c.segment_bytes)
        judged.write.parquet(f"{folder}/judged")
        judged = self.spark.read.schema(RESULT).parquet(f"{folder}/judged")
        sizes = judged.where("status = 'OK'").groupBy("tx_no").agg(F.count(F.lit(1)).cast("int").alias("event_count"))
        seed = F.sha1(F.concat(F.lit(batch), F.col("request_no").cast("string")).cast("binary"))
        tx = F.concat(F.substring(F.sha1(F.concat(F.lit(batch), F.lit("/"), F.col("tx_no").cast("string")).cast("binary")), 1, 12), F.lit("4"), F.substring(seed_of(batch), 1, 19))
        ms = F.coalesce("timestamp_ms", F.lit(now))
        own = r.select("request_no", "partition_key", "event_name", "payload", "metadata", F.col("event_id").alias("given_id"), "timestamp_ms")
        done = judged.join(own, F.equal_null(judged["request_no"], own["request_no"])).drop(own["request_no"]).join(sizes, "tx_no", "left")
        done = done.select(
            "request_no", "tx_no", "status", "message", "partition_id", "bucket_id", "stream_id", "stream_version", "partition_sequence", "partition_key", "event_name", "event_count",
            F.when(F.col("status") == "OK", F.lower(F.coalesce("given_id", ids.event_id(ms, ids.partition_hash("partition_key"), seed)))).alias("event_id"),
            F.when(F.col("status") == "OK", ids.with_flag(tx, F.col("event_count") == 1)).alias("transaction_id"), F.when(F.col("status") == "OK", ms).alias("timestamp"),
            F.coalesce("payload", F.lit(b"")).alias("payload"), F.coalesce("metadata", F.lit(b"")).alias("metadata"),
        )
        ok = done.where("status = 'OK'").withColumn("timestamp_ns", ids.to_ns("timestamp")).withColumn("confirmation_count", F.lit(confirmations))
        self._lay(ok, folder)
        ok.where("event_count > 1").groupBy("transaction_id").agg(F.max("timestamp_ns").alias("timestamp_ns"), F.max("confirmation_count").alias("confirmation_count"), F.max("event_count").alias("event_count")).write.parquet(f"{folder}/commits")
        stored = self._batch(folder)
        self._summaries(stored, folder)
        self.published.publish(number, folder)
        shown = stored.select("partition_id", "partition_sequence", "event_id", "transaction_id", F.expr("timestamp_ns div 1000000").alias("timestamp"))
        return judged.join(own.select(F.col("request_no").alias("_no"), "partition_key"), F.equal_null(F.col("request_no"), F.col("_no"))).join(shown, ["partition_id", "partition_sequence"], "left").select(*REPLY)

    def _lay(self, events: DataFrame, folder: str) -> None:
        laid = events.withColumn("_block", block_of("partition_sequence", 1 << 20)).repartition("bucket_id", "partition_id", "_block").sortWithinPartitions("bucket_id", "partition_id", "partition_sequence")
        names = [x.split()[0] for x in tables.EVENT.split(", ")]
        laid.select(*names, "bucket_id").write.option("compression", "zstd").option("parquet.bloom.filter.enabled#event_id", "true").option("parquet.bloom.filter.enabled#stream_id", "true").partitionBy("bucket_id", "partition_id").parquet(f"{self.path}/events/batch={_name(folder)}")

    def _batch(self, folder: str) -> DataFrame:
        return self.spark.read.schema(tables.EVENT + ", bucket_id int").parquet(f"{self.path}/events/batch={_name(folder)}")

    def _summaries(self, stored: DataFrame, folder: str) -> None:
        stored.groupBy("bucket_id", "stream_id").agg(F.max_by("partition_key", "stream_version").alias("partition_key"), F.max("stream_version").alias("stream_version")).write.parquet(f"{folder}/heads")
        stored.groupBy("partition_id").agg((F.max("partition_sequence") + 1).alias("next_sequence")).write.parquet(f"{folder}/tops")

    def load(self, log: DataFrame, commits: DataFrame) -> int:
        """Store a log that exists already, numbers and all, as one batch; its rows must be one an event."""
        number = self.published.next_number()
        folder = self.published.new_folder(number)
        own = [x.split()[0] for x in tables.COMMIT.split(", ")]
        self._lay(log.withColumn("bucket_id", ids.bucket_id("partition_id", self.config.buckets)), folder)
        commits.select(*[F.col(x) if x in commits.columns else F.lit(None).cast(t).alias(x) for x, t in zip(own, ("string", "bigint", "int", "int"))]).write.parquet(f"{folder}/commits")
        self._summaries(self._batch(folder), folder)
        self.published.publish(number, folder)
        return number

    def set_confirmations(self, updates: DataFrame) -> DataFrame:
        """Set the confirmation counts of stored events: (partition_id, partition_sequence, confirmation_count, transaction_id).

        All are set or none: if one names no stored event of its transaction
        (null: any), nothing changes. Returns the updates with their status.
        """
        number = self.published.next_number()
        folder = self.published.new_folder(number)
        checked = confirm.check_updates(self.events(), updates)
        checked.write.parquet(f"{folder}/checked")
        checked = self.spark.read.schema(checked.schema).parquet(f"{folder}/checked")
        if checked.where("status <> 'OK'").isEmpty():
            checked.select("partition_id", "partition_sequence", "confirmation_count", F.lit(number).cast("bigint").alias("update_no")).write.parquet(f"{folder}/confirmations")
            self.published.publish(number, folder)
        return checked

    def compact(self) -> int:
        """Write the whole log as one batch that takes the place of all before it."""
        number = self.published.next_number()
        folder = self.published.new_folder(number) + "-whole"
        self._lay(self.events(), folder)
        self.commits().write.parquet(f"{folder}/commits")
        self._summaries(self._batch(folder), folder)
        self.published.publish(number, folder)
        return number

    def watermarks(self, quorum: int) -> DataFrame:
        """Confirmed watermarks, one row a partition, staged."""
        return sized(confirm.watermarks(self.events(), quorum), 1 << 16, "marks")


def _name(folder: str) -> str:
    return folder.rpartition("/")[2]


def seed_of(batch: str):
    return F.sha1(F.concat(F.lit(batch), F.lit(":"), F.col("tx_no").cast("string")).cast("binary"))
