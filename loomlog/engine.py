"""The engine: commands and methods over one log, each read compiled to a DataFrame."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.config import LogConfig
from loomlog.errors import EngineError
from loomlog.operators import confirm, reads
from loomlog.plans import commands as c
from loomlog.scratch import sized
from loomlog.sources.log import wire
from loomlog.sources.stored import StoredLog


class Engine:
    """Commands over a log and its commit records; reads see confirmed, committed events.

    Over two DataFrames it only reads; ``open`` gives one over a stored log,
    which it appends to, and which then sees its own writes. Watermarks are
    computed once and staged, one row a partition; every read filters the log by
    what it asks for first and looks up transactions of these rows only.
    """

    def __init__(self, log: DataFrame, commits: DataFrame, config: LogConfig | None = None, marks: DataFrame | None = None, store: StoredLog | None = None):
        self.log, self.commits, self.config, self.store = log, commits, (config or LogConfig()).validate(), store
        self.spark: SparkSession = log.sparkSession
        self._marks = marks
        self.subscriptions: dict[str, tuple[c.Subscribe, int | None]] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: LogConfig | None = None) -> Engine:
        """An engine over the stored log at ``path``, which is made if there is none."""
        store = StoredLog(spark, path, config)
        return cls(store.events(), store.commits(), store.config, store=store)

    @property
    def marks(self) -> DataFrame:
        if self._marks is None:
            self._marks = sized(confirm.watermarks(self.log, self.config.quorum), 1 << 16, "marks")
        return self._marks

    @property
    def visible(self) -> DataFrame:
        return reads.visible(self.log, self.commits, self.config.quorum, self.marks)

    def _refresh(self) -> None:
        """See what was written: by this engine, or by others since it was opened."""
        if self.store:
            self.log, self.commits, self._marks = self.store.events(), self.store.commits(), None

    def _seen(self, rows: DataFrame, partitions: Column) -> DataFrame:
        """The visible ones of some rows of the partitions that the condition names."""
        return reads.visible_among(rows, self.log.where(partitions), self.commits, self.marks)

    def execute(self, command: str | list[str]) -> DataFrame:
        """The reply of a command as a DataFrame; EngineError for one that is refused."""
        r = c.parse(command, self.config.partitions)
        partition = F.col("partition_id")
        if isinstance(r, c.GetEvent):
            p = c.hash_of(r.event_id) % self.config.partitions
            return wire(self._seen(reads.get_event(self.log, r.event_id, self.config.partitions), partition == p))
        if isinstance(r, c.ScanStream):
            seen = self._stream(r.stream_id, r.partition_key, F.col("stream_version") >= r.start, None if r.end is None else F.col("stream_version") <= r.end)
            return reads.page(seen.orderBy("stream_version").limit(r.count + 1), "stream_version", r.count)
        if isinstance(r, c.ScanPartition):
            p = self._partition(r.partition)
            rows = reads.scan_partition(self.log, p, r.start, r.end, None)
            seen = self._seen(rows, partition == p)
            shown = reads.page(seen.orderBy("partition_sequence").limit(r.count + 1), "partition_sequence", r.count)
            if r.end is None:
                return shown
            # more are there if confirmed events follow the last one returned, even past the requested end
            last = F.coalesce(F.element_at("events", -1)["partition_sequence"], F.lit(r.start - 1))
            top = self.marks.where(partition == p).agg((F.max("confirmed_watermark") - 1).alias("top")).scalar()
            return shown.select((F.coalesce(top, F.lit(-1)) > last).alias("has_more"), "events")
        if isinstance(r, c.StreamVersion):
            return self._stream(r.stream_id, r.partition_key).agg(F.max("stream_version").alias("stream_version"))
        if isinstance(r, c.PartitionSequence):
            return reads.confirmed_sequences(self.marks.where(partition == self._partition(r.partition)))
        if isinstance(r, c.Append):
            return self.append(r)
        if isinstance(r, c.Subscribe):
            return self.subscribe(r)
        if isinstance(r, c.Simple) and r.name == "HELLO":
            return self.spark.range(1).select(F.lit("loomlog").alias("server"), F.lit("1").alias("version"), F.lit("local").alias("peer_id"), F.lit(self.config.partitions).alias("num_partitions"))
        if isinstance(r, c.Simple) and r.name == "PING":
            return self.spark.range(1).select(F.lit("PONG").alias("reply"))
        if isinstance(r, c.Ack):
            return self.spark.range(1).select(F.lit(self.acknowledge(r.subscription_id, r.cursor)).cast("bigint").alias("acked"))
        return self.cache_info()

    def _stream(self, stream_id: str, key: str | None, *where: Column | None) -> DataFrame:
        """The visible events of a stream, which lives in the bucket of its key."""
        p = c.hash_of(key or c.default_key(stream_id)) % self.config.partitions
        rows = reads.stream_of(self.log, stream_id, p, self.config.buckets)
        for w in where:
            rows = rows if w is None else rows.where(w)
        return self._seen(rows, F.col("partition_id") % self.config.buckets == p % self.config.buckets)

    def _partition(self, p: int | str) -> int:
        return p if isinstance(p, int) else c.hash_of(p) % self.config.partitions

    def append(self, r: c.Append) -> DataFrame:
        """Append the events of a command, all or none; EngineError if they are refused.

        One row an event: event_id, partition_key, partition_id,
        partition_sequence, stream_id, stream_version, timestamp, and the first
        and last sequence of the whole. It is stored when this returns. Without
        a stored log there is nothing to append to.
        """
        if self.store is None:
            raise EngineError("DBOPFAILED", "this engine has no stored log to append to")
        rows = []
        for i, e in enumerate(r.events):
            key = r.partition_key or e.partition_key or c.default_key(e.stream_id)
            rows.append((i, 0, e.stream_id, e.event_name, e.expected_version, key, e.event_id, e.timestamp_ms, bytearray(e.payload), bytearray(e.metadata)))
        requests = self.spark.createDataFrame(rows, "request_no bigint, tx_no bigint, stream_id string, event_name string, expected_version string, partition_key string, event_id string, timestamp_ms bigint, payload binary, metadata binary")
        reply = self.store.append(requests, atomic=True).orderBy("request_no").collect()  # as many rows as the command has events
        if reply[0].status != "OK":
            raise EngineError(reply[0].status, reply[0].message)
        self._refresh()
        first, last = reply[0].partition_sequence, reply[-1].partition_sequence
        out = [(x.event_id, x.partition_key, x.partition_id, x.partition_sequence, x.stream_id, x.stream_version, x.timestamp, first, last) for x in reply]
        return self.spark.createDataFrame(out, "event_id string, partition_key string, partition_id int, partition_sequence bigint, stream_id string, stream_version bigint, timestamp bigint, first_partition_sequence bigint, last_partition_sequence bigint")

    def set_confirmations(self, updates: DataFrame) -> DataFrame:
        """Set confirmation counts of stored events, all or none; the updates with their status."""
        if self.store is None:
            raise EngineError("DBOPFAILED", "this engine has no stored log to confirm in")
        out = self.store.set_confirmations(updates)
        self._refresh()
        return out

    def close(self) -> None:
        """End the engine: what it appended is on disk already, open subscriptions end."""
        self.subscriptions.clear()

    def subscribe(self, r: c.Subscribe) -> DataFrame:
        """Open a subscription: what it is sent of the history before its first ack, at most a window."""
        return self.next_records(self._opened(r))

    def open_subscription(self, command: str | list[str]) -> str:
        """Open a subscription by its command and return its id only."""
        r = c.parse(command, self.config.partitions)
        if not isinstance(r, c.Subscribe):
            raise EngineError("SYNTAX", "no subscription")
        return self._opened(r)

    def _opened(self, r: c.Subscribe) -> str:
        """Note where every key begins: one that is live only begins behind what is visible now."""
        start = dict(r.start) if isinstance(r.start, dict) else {}
        if r.kind == "stream":
            for key, stream in r.keys if not isinstance(r.start, int) else []:
                if stream not in start:
                    top = self._stream(stream, key).agg(F.max("stream_version")).first()[0]
                    start[stream] = 0 if top is None else top + 1
        elif not isinstance(r.start, int) and r.fallback is None:
            for p, w in self.marks.select("partition_id", "confirmed_watermark").collect():  # one row a partition
                if r.keys is None or p in r.keys:
                    start.setdefault(p, w)
        fallback = r.fallback if r.fallback is not None else 0
        subscription_id = str(uuid.uuid4())
        self.subscriptions[subscription_id] = (dataclasses.replace(r, start=r.start if isinstance(r.start, int) else start, fallback=fallback), None)
        return subscription_id

    def next_records(self, subscription_id: str) -> DataFrame:
        """(subscription_id, cursor, event...) that a subscription may be sent now: past its ack, within its window."""
        from loomlog.streaming.subscriptions import records

        r, acked = self._subscription(subscription_id)
        sent = records(self.visible, r, True, acked)
        return sent.where(F.col("cursor") > (-1 if acked is None else acked)).select(F.lit(subscription_id).alias("subscription_id"), "cursor", *[x for x in sent.columns if x != "cursor"])

    def acknowledge(self, subscription_id: str, cursor: int) -> int:
        """Move the ack of a subscription forward; an older cursor changes nothing."""
        r, acked = self._subscription(subscription_id)
        acked = cursor if acked is None else max(acked, cursor)
        self.subscriptions[subscription_id] = (r, acked)
        return acked

    def unsubscribe(self, subscription_id: str) -> None:
        self._subscription(subscription_id)
        del self.subscriptions[subscription_id]

    def _subscription(self, subscription_id: str) -> tuple[c.Subscribe, int | None]:
        if subscription_id not in self.subscriptions:
            raise EngineError("NOTFOUND", "no such subscription on this connection")
        return self.subscriptions[subscription_id]

    def cache_info(self) -> DataFrame:
        """Memory that Spark's storage uses and has, in place of a block cache's counters."""
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        most = left = entries = 0
        it = status.valuesIterator()
        while it.hasNext():
            pair = it.next()
            most, left = most + pair._1(), left + pair._2()
        entries = self.spark.sparkContext._jsc.getPersistentRDDs().size()
        return self.spark.range(1).select(F.lit(entries).alias("entries"), F.lit(most - left).cast("bigint").alias("memory"), F.lit(most).cast("bigint").alias("max"))
