"""Queries of the event-store operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.config import LogConfig
from loomlog.engine import Engine
from loomlog.functions import ids, versions
from loomlog.operators import append, confirm, reads, replicate
from loomlog.plans.commands import Subscribe
from loomlog.queries.general import table
from loomlog.scratch import new_folder, stage
from loomlog.sources import log as store
from loomlog.sources.stored import StoredLog
from loomlog.streaming.subscriptions import RECORD, AckTable, SubscriptionSource, options_of, records

# The stream, partition and event that the point queries ask for.
STREAM = "meter-feeder-280"
PARTITION = 25
RF, QUORUM = 3, 2


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "event_log")


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "commit_log")


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    return store.derive(table(spark, sf, "events"))


def _shown(df: DataFrame) -> DataFrame:
    return store.wire(df).withColumn("metadata", F.hex("metadata")).withColumn("payload", F.hex("payload"))


_KEY = ["partition_id", "partition_sequence", "stream_version", "event_id", "stream_id", "event_name"]


def partition_hash(spark, sf):
    return store.once(_log(spark, sf)).select("partition_id", "partition_sequence", ids.partition_hash("partition_key").alias("key_hash"), ids.partition_hash("event_id").alias("event_hash"))


def route(spark, sf):
    streams = _log(spark, sf).select("stream_id").where("stream_id is not null").distinct()
    keyed = streams.withColumn("partition_key", ids.default_partition_key("stream_id"))
    return keyed.select("stream_id", "partition_key", ids.partition_id("partition_key").alias("partition_id"), ids.bucket_id(ids.partition_id("partition_key")).alias("bucket_id"))


def event_uuid(spark, sf):
    return _derived(spark, sf).select("event_no", "event_id")


def validate_event_id(spark, sf):
    ok = ids.embeds_hash("event_id", "partition_key") & (ids.partition_id("partition_key") == F.col("partition_id"))
    return store.once(_log(spark, sf)).groupBy("partition_id").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("invalid"))


def derived_log(spark, sf):
    return _derived(spark, sf).select("event_no", "stream_id", "partition_key", "partition_id", "bucket_id", "partition_sequence", "stream_version", "timestamp_ns", "confirmation_count")


def transaction_flags(spark, sf):
    t = _log(spark, sf).select("transaction_id").distinct()
    return t.select("transaction_id", ids.single_event("transaction_id").alias("single"), ids.with_flag("transaction_id", True).alias("set_id"), ids.with_flag("transaction_id", False).alias("cleared_id"))


def stream_id_rules(spark, sf):
    return _log(spark, sf).select("stream_id").distinct().select("stream_id", ids.valid_stream_id("stream_id").alias("valid"), F.octet_length("stream_id").alias("n_bytes"))


def confirmation_byte(spark, sf):
    e = store.once(_log(spark, sf))
    b = ids.confirmation_byte("confirmation_count")
    return e.select("partition_id", "partition_sequence", b.alias("stored"), ids.confirmation_count(b).alias("confirmation_count"))


def crc32_payload(spark, sf):
    return store.encode_record(store.once(_log(spark, sf)))


def wire_events(spark, sf):
    return _shown(store.once(_log(spark, sf)))


def committed_only(spark, sf):
    return reads.committed(store.once(_log(spark, sf)), _commits(spark, sf)).select(*_KEY)


def read_transactions(spark, sf):
    return reads.transactions(_log(spark, sf), _commits(spark, sf))


def visible_log(spark, sf):
    return reads.visible(_log(spark, sf), _commits(spark, sf), QUORUM).select(*_KEY)


def confirmed_watermark(spark, sf):
    return confirm.watermarks(_log(spark, sf), QUORUM)


def watermark_skip_event(spark, sf):
    """Watermarks if every event that blocks one now were skipped."""
    log = store.once(_log(spark, sf))
    w = confirm.watermarks(log, QUORUM)
    return confirm.watermarks(log, QUORUM, skipped=w.select("partition_id", F.col("confirmed_watermark").alias("partition_sequence")).where("true"))


def watermark_forced(spark, sf):
    log = _log(spark, sf)
    forced = log.groupBy("partition_id").agg(F.lit(100).cast("bigint").alias("confirmed_watermark"))
    return confirm.watermarks(log, QUORUM, forced=forced)


def confirmation_gap(spark, sf):
    return confirm.gaps(confirm.watermarks(_log(spark, sf), QUORUM))


def unconfirmed_events(spark, sf):
    log = store.once(_log(spark, sf))
    return confirm.unconfirmed(log, confirm.watermarks(log, QUORUM), QUORUM).select("partition_id", "partition_sequence", "event_id")


def confirmation_stats(spark, sf):
    log = _log(spark, sf)
    return confirm.stats(log, confirm.watermarks(log, QUORUM), QUORUM)


def validate_watermarks(spark, sf):
    log = _log(spark, sf)
    return confirm.validate(log, log.groupBy("partition_id").agg(F.max("partition_sequence").alias("confirmed_watermark")), QUORUM)


def _scan(spark, sf, *bounds, **how) -> DataFrame:
    """A stream of the log: the filter is in the scan, exported copies are dropped among the few rows that pass it."""
    rows = reads.stream_of(_log(spark, sf), STREAM, PARTITION)
    return reads.scan_stream(store.once(rows), STREAM, *bounds, **how)


def escan(spark, sf):
    return _shown(_scan(spark, sf, count=100))


def escan_range(spark, sf):
    return _shown(_scan(spark, sf, 5, 25, count=100))


def escan_partition_key(spark, sf):
    """A stream under the key of another one in its bucket; a key of another bucket finds nothing."""
    at = reads.scan_stream(store.once(reads.stream_of(_log(spark, sf), STREAM, PARTITION + ids.BUCKETS)), STREAM, 0, 3, PARTITION + ids.BUCKETS)
    other = reads.scan_stream(store.once(reads.stream_of(_log(spark, sf), STREAM, PARTITION + 1)), STREAM, 0, 3, PARTITION + 1)
    return _shown(at.unionByName(other))


def escan_count_has_more(spark, sf):
    p = reads.page(_scan(spark, sf, 3, 60, count=11), "stream_version", 10)
    return p.select("has_more", F.size("events").cast("bigint").alias("n"), F.array_join(F.col("events.event_id"), ",").alias("event_ids"))


def stream_forward(spark, sf):
    """All of a stream that is visible, from a version on."""
    log = _log(spark, sf)
    marks = confirm.watermarks(log.where(F.col("partition_id") == PARTITION), QUORUM)
    rows = reads.stream_of(log, STREAM, PARTITION).where((F.col("partition_id") == PARTITION) & (F.col("stream_version") >= 10))
    return reads.visible_among(rows, log.where(F.col("partition_id") == PARTITION), _commits(spark, sf), marks).select(*_KEY)


def filter_commit(spark, sf):
    """Each committed transaction that a stream takes part in, without its events of other streams."""
    return reads.filter_commit(reads.committed(store.once(_log(spark, sf)), _commits(spark, sf)), STREAM)


def epscan_has_more(spark, sf):
    """A page of a partition whose range ends before the confirmed events do."""
    engine = Engine(_log(spark, sf), _commits(spark, sf), LogConfig(nodes=3, cluster=True, replication_factor=RF))
    p = engine.execute(f"EPSCAN {PARTITION} 3 12 COUNT 20")
    return p.select("has_more", F.size("events").cast("bigint").alias("n"), F.array_join(F.col("events.event_id"), ",").alias("event_ids"))


def epscan(spark, sf):
    return _shown(reads.scan_partition(store.once(_log(spark, sf)), PARTITION, count=100))


def epscan_range(spark, sf):
    return _shown(reads.scan_partition(store.once(_log(spark, sf)), PARTITION, 50, 150, count=None))


def epscan_visible(spark, sf):
    return _shown(reads.scan_partition(reads.visible(_log(spark, sf), _commits(spark, sf), QUORUM), PARTITION, count=100))


def _some_id(spark, sf, where="true") -> str:
    """The smallest event id that a condition leaves, to ask for; zeros in an empty log."""
    return _log(spark, sf).where(where).agg(F.min("event_id")).first()[0] or "0" * 32


def eget(spark, sf):
    return _shown(store.once(reads.get_event(_log(spark, sf), _some_id(spark, sf, "partition_id is not null"))))


def eget_missing(spark, sf):
    return _shown(store.once(reads.get_event(_log(spark, sf), "00000000-0000-7000-8000-000000000000")))


def esver(spark, sf):
    return reads.stream_versions(reads.visible(_log(spark, sf), _commits(spark, sf), QUORUM)).select("bucket_id", "stream_id", "stream_version")


def epseq(spark, sf):
    return reads.confirmed_sequences(confirm.watermarks(_log(spark, sf), QUORUM))


def partition_sequences(spark, sf):
    return reads.partition_sequences(_log(spark, sf))


def stream_reverse(spark, sf):
    return _scan(spark, sf, 40, reverse=True, count=None).select(*_KEY)


def partition_reverse(spark, sf):
    return reads.scan_partition(store.once(_log(spark, sf).where(F.col("partition_id") == PARTITION)), PARTITION, 1 << 63, reverse=True, count=50).select(*_KEY)


def read_transaction_tail(spark, sf):
    """The rest of a transaction of several events, from its second one on."""
    log = _log(spark, sf).where("partition_id is not null")
    wanted = log.where(~ids.single_event("transaction_id")).agg(F.min_by("event_id", F.struct(-F.col("partition_sequence") % 2, "event_id"))).first()[0] or "0" * 32
    return store.once(reads.read_transaction(log, wanted)).select(*_KEY)


def stream_index_summary(spark, sf):
    return reads.stream_index(store.once(_log(spark, sf)))


def partition_index_summary(spark, sf):
    return reads.partition_index(store.once(_log(spark, sf)))


def validate_sequences(spark, sf):
    """Sequences after a hole, in the log without the events that lack a quorum."""
    return reads.out_of_sequence(_log(spark, sf).where(F.col("confirmation_count") >= QUORUM))


def version_gap(spark, sf):
    e = store.once(_log(spark, sf))
    expected = F.element_at(F.array(F.lit("any"), F.lit("exists"), F.lit("empty"), (F.col("partition_sequence") % 7).cast("string")), (F.col("partition_sequence") % 4 + 1).cast("int"))
    current = F.when(F.col("stream_version") > 0, F.col("stream_version") - 1)
    g = versions.gap("expected", "current")
    return e.select("partition_id", "partition_sequence", expected.alias("expected"), current.alias("current")).select(
        "partition_id", "partition_sequence", "expected", "current", g["kind"].alias("kind"), g["n"].alias("n"), versions.satisfied("expected", "current").alias("satisfied"), versions.strict("expected").alias("strict"),
        versions.into_next("expected").alias("next_expected"), versions.next_of("current").alias("next_current"),
    )


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Append requests from the plain events: a stream per user, every kind of expectation."""
    n = F.col("event_id")
    kind = F.when(n % 5 < 2, "any").when(n % 5 == 2, "exists").when(n % 5 == 3, "empty").otherwise((n % 3).cast("string"))
    return table(spark, sf, "events").select(n.alias("request_no"), F.floor(n / 3).alias("tx_no"), F.concat(F.lit("user-"), F.col("user_id")).alias("stream_id"), F.col("event_type").alias("event_name"), kind.alias("expected_version"))


def append_fold(spark, sf):
    return append.append(_requests(spark, sf)).select("request_no", "stream_id", "status", "stream_version", "partition_id", "partition_sequence")


def append_any_versions(spark, sf):
    r = _requests(spark, sf).withColumn("expected_version", F.lit("any"))
    return append.append(r).select("request_no", "stream_id", "status", "stream_version", "partition_id", "partition_sequence")


def strict_mode(spark, sf):
    return append.append(_requests(spark, sf), strict=True).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _atomic_requests(spark, sf) -> DataFrame:
    """Three events a transaction, all of one stream's partition."""
    e = _derived(spark, sf)
    kind = F.when(F.col("event_no") % 7 < 5, "any").when(F.col("event_no") % 7 == 5, "exists").otherwise((F.col("event_no") % 2).cast("string"))
    tx = (F.col("partition_id").cast("bigint") * (1 << 40) + F.floor(F.col("partition_sequence") / 3)).cast("bigint")
    return e.select(F.col("event_no").alias("request_no"), tx.alias("tx_no"), "partition_key", "stream_id", "event_name", kind.alias("expected_version"))


def emappend_atomic(spark, sf):
    return append.append(_atomic_requests(spark, sf), atomic=True).select("request_no", "tx_no", "stream_id", "status", "stream_version", "partition_id", "partition_sequence")


def append_onto_log(spark, sf):
    """The log stored, the requests of the plain events and a request for each of its streams appended to it: what is new there.

    A request for a stream of the log expects the version that it has, is or
    exists; half of them lose against it.
    """
    stored = StoredLog(spark, new_folder(spark, "log"), LogConfig(strict_versioning=False))
    stored.load(store.once(_log(spark, sf)), _commits(spark, sf))
    heads = stage(stored.heads(), "heads")
    last = heads.agg(F.max("bucket_id")).first()[0] or 0
    no = F.lit(1 << 40) + F.pmod(F.xxhash64("bucket_id", "stream_id"), F.lit(1 << 60))
    second = F.when(F.col("bucket_id") % 2 == 0, F.col("stream_version").cast("string")).otherwise("empty")
    own = heads.select(no.alias("request_no"), "stream_id", F.lit("again").alias("event_name"), second.alias("expected_version"), "partition_key")
    fresh = _requests(spark, sf).select("request_no", "stream_id", "event_name", "expected_version", F.lit(None).cast("string").alias("partition_key"))
    stored.append(fresh.unionByName(own), now_ms=1_900_000_000_000)
    assert last < stored.config.buckets
    old = store.once(_log(spark, sf)).select("partition_id", "partition_sequence")
    return stored.events().join(old, ["partition_id", "partition_sequence"], "left_anti").select("partition_id", "stream_id", "event_name", "stream_version", F.expr("timestamp_ns div 1000000").alias("timestamp"), "confirmation_count")


def append_tops(spark, sf):
    """Events and next sequence of each partition after the same appends: no number is skipped or used twice."""
    stored = StoredLog(spark, new_folder(spark, "log"), LogConfig(strict_versioning=False))
    stored.load(store.once(_log(spark, sf)), _commits(spark, sf))
    stored.append(_requests(spark, sf), now_ms=1_900_000_000_000)
    n = stored.events().groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("partition_sequence").alias("n_sequences"))
    return n.join(stored.tops(), "partition_id").select("partition_id", "n", "n_sequences", "next_sequence")


def set_confirmations(spark, sf):
    """Watermarks of the stored log after a quorum has confirmed the event that held each partition up."""
    stored = StoredLog(spark, new_folder(spark, "log"), LogConfig())
    stored.load(store.once(_log(spark, sf)), _commits(spark, sf))
    held = confirm.unconfirmed(stored.events(), confirm.watermarks(stored.events(), QUORUM), QUORUM)
    first = held.groupBy("partition_id").agg(F.min("partition_sequence").alias("partition_sequence"), F.min_by("transaction_id", "partition_sequence").alias("transaction_id"))
    stored.set_confirmations(first.withColumn("confirmation_count", F.lit(QUORUM)))
    return confirm.watermarks(stored.events(), QUORUM)


def stuck_events(spark, sf):
    """Events without a quorum that are older than an hour at the partition's newest time, tried once for each event after them."""
    log = store.once(_log(spark, sf))
    marks = confirm.watermarks(log, QUORUM)
    held = confirm.unconfirmed(log, marks, QUORUM)
    newest = log.groupBy("partition_id").agg(F.max("timestamp_ns").alias("now_ns"), F.max("partition_sequence").alias("top"))
    pending = held.join(newest, "partition_id").select("partition_id", "partition_sequence", "event_id", F.col("timestamp_ns").alias("first_seen_ns"), (F.col("top") - F.col("partition_sequence")).alias("attempts"), "now_ns")
    return confirm.stuck(pending, "now_ns", 3, 3_600_000_000_000).select("partition_id", "partition_sequence", "event_id", "attempts")


def watermark_gap_block(spark, sf):
    """Watermarks of a log in which the event at sequence 20 of every partition never arrived."""
    return confirm.watermarks(_log(spark, sf).where("partition_sequence <> 20"), QUORUM)


def watermark_reopen(spark, sf):
    """Watermarks saved over the first 15 sequences of each partition, then moved on by what was stored since."""
    log = _log(spark, sf)
    saved = confirm.Snapshots(spark, new_folder(spark, "marks"))
    saved.save(confirm.watermarks(log.where("partition_sequence < 15"), QUORUM))
    return saved.reopen(log, QUORUM)


def sync_range(spark, sf):
    """What a replica that lacks sequences 10 to 60 is sent of each partition: confirmed commits, whole ones only."""
    return replicate.sync_range(store.once(_log(spark, sf)), _commits(spark, sf), confirm.watermarks(_log(spark, sf), QUORUM), 10, 60).select(*_KEY)


def accept_rules(spark, sf):
    """What a replica would answer to each event as a write that came over with its confirmations as its age."""
    e = store.once(_log(spark, sf))
    expected = F.when(F.col("partition_sequence") == 0, "empty").when(F.col("confirmation_count").isNull(), "any").otherwise((F.col("partition_sequence") - 1).cast("string"))
    w = e.select("partition_id", "partition_sequence", expected.alias("expected_sequence"), (F.col("confirmation_count") > 1).alias("sender_known"), (F.col("stream_version") * 1000).alias("age_ms"), F.lit(30_000).alias("timeout_ms"), (F.col("partition_id") % 3 < 2).alias("owned"))
    return replicate.accept_rules(w).select("partition_id", "partition_sequence", "status")


def memberships(spark, sf):
    """Partitions as nodes, their events as heartbeats: spells of life with at most an hour of silence."""
    beats = store.once(_log(spark, sf)).select(F.concat(F.lit("node-"), F.col("partition_id")).alias("node"), F.expr("timestamp_ns div 1000000").alias("at_ms"))
    return replicate.memberships(beats, 3_600_000)


def replica_confirm(spark, sf):
    """Claims of a replica against the log: every fourth sequence under a wrong id, and one past the end of each partition."""
    log = store.once(_log(spark, sf))
    wrong = F.when(F.col("partition_sequence") % 4 == 3, F.lit("00000000-0000-7000-8000-000000000000")).otherwise(F.col("event_id"))
    past = log.groupBy("partition_id").agg((F.max("partition_sequence") + 1).alias("partition_sequence")).select("partition_id", "partition_sequence", F.lit("none").alias("event_id"), F.lit(1).alias("confirmation_count"))
    claims = log.select("partition_id", "partition_sequence", wrong.alias("event_id"), "confirmation_count").unionByName(past)
    return confirm.confirm(log, claims).groupBy("partition_id", "status").agg(F.count(F.lit(1)).alias("n"))


def _subscribed(spark, sf, r: Subscribe) -> DataFrame:
    return records(store.once(_log(spark, sf)), r, window=False).select("cursor", *_KEY)


def sub_all_from_map_default(spark, sf):
    return _subscribed(spark, sf, Subscribe("partition", None, {25: 100, 1: 40}, 10))


def sub_partitions_from(spark, sf):
    return _subscribed(spark, sf, Subscribe("partition", [1, 5, 25], 20))


def sub_streams_from_map(spark, sf):
    keys = [(k, f"user-{i}") for i, k in ((i, _key(f"user-{i}")) for i in (1, 2, 3))]
    return records(_derived(spark, sf), Subscribe("stream", keys, {"user-1": 10, "user-2": 0}), window=False).select("cursor", *_KEY)


def sub_window_first_page(spark, sf):
    return records(store.once(_log(spark, sf)), Subscribe("partition", None, 0, None, 10)).select("cursor", *_KEY)


def sub_window_after_ack(spark, sf):
    return records(store.once(_log(spark, sf)), Subscribe("partition", None, 0, None, 10), acked=499).where("cursor > 499").select("cursor", *_KEY)


def stream_replay(spark, sf, windows: int = 4):
    """The whole log through the subscription source, a window at a time, each acknowledged when it is stored.

    The query is stopped after the first window and started again.
    """
    where = new_folder(spark, "replay")
    store.write(store.once(_log(spark, sf)), f"{where}/log", ids.PARTITIONS, ids.BUCKETS)
    spark.dataSource.register(SubscriptionSource)
    window = max(1, -(-spark.read.parquet(f"{where}/log/events").count() // windows))
    options = options_of(Subscribe("partition", None, 0, None, window), "replay", f"{where}/log/events", f"{where}/acks")
    acks = AckTable(options["state"])

    stopping = True

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")
        if not (stopping and number):
            acks.ack("replay", stored_to())

    def stored_to() -> int:
        return spark.read.schema(RECORD + ", batch int").parquet(f"{where}/out").agg(F.coalesce(F.max("cursor"), F.lit(-1))).first()[0]

    for stopping in (True, False):
        stream = spark.readStream.format("loomlog_subscription").options(**options).load()
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        if stopping:  # the consumer finds what it has stored and acknowledges it
            acks.ack("replay", stored_to())
    return spark.read.schema(RECORD + ", batch int").parquet(f"{where}/out").select("cursor", "partition_id", "partition_sequence", "event_id")


def sequence_gap(spark, sf):
    """What a write that expects each event's own stream version as sequence would be told at that point."""
    e = store.once(_log(spark, sf))
    g = versions.sequence_gap(F.col("stream_version").cast("string"), "partition_sequence")
    return e.select("partition_id", "partition_sequence", g["kind"].alias("kind"), g["n"].alias("n"))


def _key(stream: str) -> str:
    from loomlog.plans.commands import default_key

    return default_key(stream)


def subscription_progress(spark, sf):
    """Last acknowledged cursor of each subscription and the un-acked records its window still admits."""
    acks = table(spark, sf, "acks").where("outcome = 'ok'").groupBy("subscription_id").agg(F.max("cursor_no").alias("acked"))
    sent = table(spark, sf, "deliveries").groupBy("subscription_id").agg(F.max("cursor_no").alias("sent"))
    s = table(spark, sf, "subscriptions").join(acks, "subscription_id", "left").join(sent, "subscription_id", "left")
    room = F.greatest(F.lit(0).cast("bigint"), F.coalesce("acked", F.lit(-1)) + F.col("window_size") - F.coalesce("sent", F.lit(-1)))
    return s.select("subscription_id", "acked", "sent", "window_size", room.alias("room"))


def replica_gaps(spark, sf):
    """What a replica that only has the confirmed events lacks."""
    e = _log(spark, sf).where(F.col("confirmation_count") >= QUORUM)
    return replicate.missing_ranges(e, "partition_id", "partition_sequence")


def replica_sets(spark, sf):
    parts = _log(spark, sf).select("partition_id").where("partition_id is not null").distinct()
    return replicate.replica_sets(parts, 5, RF, ids.BUCKETS)


def coordinators(spark, sf):
    parts = _log(spark, sf).select("partition_id").where("partition_id is not null").distinct()
    alive = spark.range(5).select(F.col("id").cast("int").alias("node"), ((F.col("id") * 7) % 5).alias("alive_since")).where("node <> 2")
    return replicate.coordinators(replicate.replica_sets(parts, 5, RF, ids.BUCKETS), alive)


def distribute_partition(spark, sf):
    s = _log(spark, sf).select("partition_key").where("partition_key is not null").distinct()
    d = ids.distribute(ids.partition_hash("partition_key"), ids.PARTITIONS, RF)
    return s.select("partition_key", d[0].alias("first"), d[1].alias("second"), d[2].alias("third"))


def write_quorums(spark, sf):
    """Copies of each event beside the writer's, as acks of replicas."""
    e = store.once(_log(spark, sf)).where("confirmation_count is not null")
    acks = e.select(F.concat_ws("/", "partition_id", "partition_sequence").alias("write_id"), F.explode(F.sequence(F.lit(1), F.col("confirmation_count"))).alias("node")).where("node > 1")
    return replicate.quorum_reached(acks, RF)


QUERIES = {f.__name__: f for f in (
    partition_hash, route, event_uuid, validate_event_id, derived_log, transaction_flags, stream_id_rules, confirmation_byte, crc32_payload, wire_events, committed_only, read_transactions,
    visible_log, confirmed_watermark, watermark_skip_event, watermark_forced, confirmation_gap, unconfirmed_events, confirmation_stats, validate_watermarks, escan, escan_range,
    escan_count_has_more, epscan, epscan_range, epscan_visible, eget, eget_missing, esver, epseq, partition_sequences, stream_reverse, partition_reverse, read_transaction_tail,
    stream_index_summary, partition_index_summary, validate_sequences, version_gap, append_fold, append_any_versions, strict_mode, emappend_atomic, sub_all_from_map_default,
    sub_partitions_from, sub_streams_from_map, sub_window_first_page, sub_window_after_ack, subscription_progress, replica_gaps, replica_sets, coordinators, distribute_partition, write_quorums,
    stream_replay, sequence_gap, escan_partition_key, stream_forward, filter_commit, epscan_has_more, append_onto_log, append_tops, set_confirmations, stuck_events, watermark_gap_block,
    watermark_reopen, sync_range, accept_rules, memberships, replica_confirm,
)}

# ---- SQL ----

_ONCE = "once AS (SELECT DISTINCT ON (partition_id, partition_sequence) * FROM event_log)"


def _hash(key: str) -> str:
    h = f"replace(lower({key}), '-', '')"
    b = [f"CAST('0x' || substr({h}, {i}, 2) AS BIGINT)" for i in (17, 19, 21)]
    return f"CAST(((({b[0]}) & 63) << 10) | ({b[1]} << 2) | ({b[2]} >> 6) AS INT)"


def _dash(h: str) -> str:
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def _default_key(stream: str) -> str:
    h = f"sha1(unhex('{ids.NAMESPACE_PARTITION_KEY.replace('-', '')}') || encode({stream}))"
    v = f"lower(to_hex((CAST('0x' || substr({h}, 17, 1) AS BIGINT) & 3) | 8))"
    return _dash(f"(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || {v} || substr({h}, 18, 15))")


_DERIVED = f"""
k AS (SELECT *, 'user-' || user_id AS stream_id, {_default_key("('user-' || user_id)")} AS partition_key FROM events),
hh AS (SELECT *, {_hash("partition_key")} AS phash, sha1(CAST(event_id AS VARCHAR)) AS seed FROM k),
pp AS (SELECT *, CAST(phash % 32 AS INT) AS partition_id FROM hh),
log AS (SELECT event_id AS event_no, stream_id, partition_key, partition_id, CAST(partition_id % 4 AS INT) AS bucket_id,
  row_number() OVER (PARTITION BY partition_id ORDER BY event_id) - 1 AS partition_sequence, row_number() OVER (PARTITION BY stream_id ORDER BY event_id) - 1 AS stream_version,
  epoch_us(ts) * 1000 AS timestamp_ns, CAST(CASE WHEN event_id % 97 = 96 THEN 1 ELSE 2 END AS INT) AS confirmation_count,
  {_dash("substr(sha1(partition_id || '/' || (event_id // 4)), 1, 32)")} AS transaction_id, event_type AS event_name, props,
  {_dash("(lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') || substr(seed, 1, 3) || '7' || lpad(lower(to_hex(524288 + phash * 4 + (CAST('0x' || substr(seed, 4, 1) AS BIGINT) & 3))), 5, '0') || substr(seed, 5, 11))")} AS event_id
  FROM pp)"""
_D = f"WITH {_DERIVED}\n"
_KEYS = "partition_id, partition_sequence, stream_version, event_id, stream_id, event_name"
_WIRE = "event_id, partition_key, partition_id, transaction_id, partition_sequence, stream_version, timestamp_ns // 1000000 AS timestamp, stream_id, event_name"
_WIRE_D = f"{_WIRE}, '' AS metadata, hex(encode(coalesce(props, ''))) AS payload"
_WIRE_L = f"{_WIRE}, hex(metadata) AS metadata, hex(payload) AS payload"
_SINGLE = "substr(replace(lower(transaction_id), '-', ''), 17, 1) >= '8'"
_COMMITTED = f"""{_ONCE},
cnt AS (SELECT transaction_id, count(*) AS n FROM once GROUP BY ALL),
com AS (SELECT transaction_id, max(event_count) AS event_count FROM commit_log GROUP BY ALL),
okay AS (SELECT cnt.transaction_id FROM cnt JOIN com USING (transaction_id) WHERE event_count IS NULL OR event_count = n),
done AS (SELECT * FROM once WHERE {_SINGLE} OR transaction_id IN (SELECT transaction_id FROM okay))"""
_MARKS = f"""num AS (SELECT partition_id, partition_sequence, coalesce(confirmation_count, 0) AS c, row_number() OVER (PARTITION BY partition_id ORDER BY partition_sequence) - 1 AS rn FROM once),
marks AS (SELECT partition_id, coalesce(min(rn) FILTER (rn <> partition_sequence OR c < {QUORUM}), max(rn) + 1) AS confirmed_watermark, max(partition_sequence) + 1 AS highest_version FROM num GROUP BY ALL)"""
_ML = f"WITH {_ONCE}, {_MARKS}\n"
_VISIBLE = f"""{_ONCE}, {_MARKS},
below AS (SELECT once.* FROM once JOIN marks USING (partition_id) WHERE once.partition_sequence < confirmed_watermark),
cnt AS (SELECT transaction_id, count(*) AS n FROM below GROUP BY ALL),
com AS (SELECT transaction_id, max(event_count) AS event_count FROM commit_log GROUP BY ALL),
okay AS (SELECT cnt.transaction_id FROM cnt JOIN com USING (transaction_id) WHERE event_count IS NULL OR event_count = n),
seen AS (SELECT * FROM below WHERE {_SINGLE} OR transaction_id IN (SELECT transaction_id FROM okay))"""
_REQ = """r AS (SELECT event_id AS request_no, 'user-' || user_id AS stream_id,
  CASE WHEN event_id % 5 < 2 THEN 'any' WHEN event_id % 5 = 2 THEN 'exists' WHEN event_id % 5 = 3 THEN 'empty' ELSE CAST(event_id % 3 AS VARCHAR) END AS e,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"""
_OK = "CASE r.e WHEN 'any' THEN true WHEN 'exists' THEN cur IS NOT NULL WHEN 'empty' THEN cur IS NULL ELSE cur IS NOT NULL AND cur = TRY_CAST(r.e AS BIGINT) END"


def _fold(strict: bool) -> str:
    ok = _OK if not strict else f"(r.e NOT IN ('any', 'exists') AND {_OK})"
    return f"""WITH RECURSIVE {_REQ},
f AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS request_no, false AS ok, '' AS e FROM (SELECT DISTINCT stream_id FROM r)
  UNION ALL SELECT r.stream_id, r.k, CASE WHEN {ok} THEN coalesce(cur, -1) + 1 ELSE cur END, r.request_no, {ok}, r.e FROM f JOIN r ON r.stream_id = f.stream_id AND r.k = f.k + 1),
j AS (SELECT request_no, stream_id, ok, e, CASE WHEN ok THEN cur END AS stream_version, CAST({_hash(_default_key('stream_id'))} % 32 AS INT) AS partition_id FROM f WHERE k > 0)"""


_NUMBERED = """SELECT request_no, stream_id, CASE WHEN ok THEN 'OK' ELSE 'WRONGVER' END AS status, stream_version, partition_id,
  CASE WHEN ok THEN row_number() OVER (PARTITION BY partition_id, ok ORDER BY request_no) - 1 END AS partition_sequence FROM j"""


def _sub(where: str, source: str = "once") -> str:
    return f"SELECT row_number() OVER (ORDER BY partition_id, partition_sequence) - 1 AS cursor, {_KEYS} FROM {source} WHERE {where}"


_OWN = f"stream_id = '{STREAM}' AND partition_id % 4 = {PARTITION % 4}"
ORACLES = {
    "partition_hash": f"WITH {_ONCE} SELECT partition_id, partition_sequence, {_hash('partition_key')} AS key_hash, {_hash('event_id')} AS event_hash FROM once",
    "route": f"WITH s AS (SELECT DISTINCT stream_id FROM event_log), k AS (SELECT stream_id, {_default_key('stream_id')} AS partition_key FROM s) SELECT stream_id, partition_key, CAST({_hash('partition_key')} % 32 AS INT) AS partition_id, CAST({_hash('partition_key')} % 32 % 4 AS INT) AS bucket_id FROM k",
    "event_uuid": _D + "SELECT event_no, event_id FROM log",
    "validate_event_id": f"WITH {_ONCE}, v AS (SELECT partition_id, {_hash('event_id')} = {_hash('partition_key')} AND {_hash('partition_key')} % 32 = partition_id AS ok FROM once) SELECT partition_id, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM v GROUP BY ALL",
    "derived_log": _D + "SELECT event_no, stream_id, partition_key, partition_id, bucket_id, partition_sequence, stream_version, timestamp_ns, confirmation_count FROM log",
    "transaction_flags": f"""WITH t AS (SELECT DISTINCT transaction_id, replace(lower(transaction_id), '-', '') AS h FROM event_log), b AS (SELECT *, CAST('0x' || substr(h, 17, 1) AS BIGINT) & 7 AS nib FROM t)
SELECT transaction_id, substr(h, 17, 1) >= '8' AS single, {_dash("(substr(h, 1, 16) || lower(to_hex(nib + 8)) || substr(h, 18, 15))")} AS set_id, {_dash("(substr(h, 1, 16) || lower(to_hex(nib)) || substr(h, 18, 15))")} AS cleared_id FROM b""",
    "stream_id_rules": "SELECT DISTINCT stream_id, strlen(stream_id) BETWEEN 1 AND 64 AND instr(stream_id, chr(0)) = 0 AS valid, CAST(strlen(stream_id) AS INT) AS n_bytes FROM event_log",
    "confirmation_byte": f"WITH {_ONCE} SELECT partition_id, partition_sequence, CAST(confirmation_count * 17 AS INT) AS stored, confirmation_count FROM once",
    "wire_events": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once",
    "committed_only": f"WITH {_COMMITTED} SELECT {_KEYS} FROM done",
    "read_transactions": f"WITH {_COMMITTED} SELECT transaction_id, min(partition_id) AS partition_id, {_SINGLE} AS single, count(*) AS n, min(partition_sequence) AS first_sequence, max(partition_sequence) AS last_sequence, string_agg(event_id, ',' ORDER BY partition_sequence) AS event_ids FROM done GROUP BY transaction_id",
    "visible_log": f"WITH {_VISIBLE} SELECT {_KEYS} FROM seen",
    "confirmed_watermark": _ML + "SELECT partition_id, confirmed_watermark, highest_version FROM marks",
    "watermark_skip_event": f"""WITH {_ONCE}, {_MARKS},
n2 AS (SELECT num.partition_id, rn, num.partition_sequence, CASE WHEN num.partition_sequence = confirmed_watermark THEN {QUORUM} ELSE c END AS c FROM num JOIN marks USING (partition_id))
SELECT partition_id, CASE WHEN coalesce(min(rn) FILTER (rn <> partition_sequence OR c < {QUORUM}), max(rn) + 1) = max(rn) + 1 AND min(CASE WHEN num_ok THEN 1 ELSE 0 END) = 1 THEN max(rn) + 2 ELSE coalesce(min(rn) FILTER (rn <> partition_sequence OR c < {QUORUM}), max(rn) + 1) END AS confirmed_watermark,
  max(partition_sequence) + 1 + CAST(min(CASE WHEN num_ok THEN 1 ELSE 0 END) AS BIGINT) AS highest_version
FROM (SELECT n2.*, m.confirmed_watermark > m.highest_version - 1 AS num_ok FROM n2 JOIN marks m USING (partition_id)) GROUP BY partition_id""",
    "watermark_forced": _ML + "SELECT partition_id, greatest(confirmed_watermark, 100) AS confirmed_watermark, greatest(highest_version, 100) AS highest_version FROM marks",
    "confirmation_gap": _ML + "SELECT partition_id, highest_version - confirmed_watermark AS confirmation_gap FROM marks",
    "unconfirmed_events": _ML + f"SELECT partition_id, partition_sequence, event_id FROM once JOIN marks USING (partition_id) WHERE partition_sequence >= confirmed_watermark AND coalesce(confirmation_count, 0) < {QUORUM}",
    "confirmation_stats": _ML + "SELECT count(DISTINCT partition_id % 4) AS buckets, count(*) AS partitions, CAST(sum(confirmed_watermark) AS BIGINT) AS confirmed, CAST(sum(highest_version - confirmed_watermark) AS BIGINT) AS unconfirmed, max(highest_version - confirmed_watermark) AS max_gap FROM marks",
    "validate_watermarks": _ML + "SELECT partition_id, highest_version - 1 AS stated, confirmed_watermark AS actual, CASE WHEN highest_version - 1 > confirmed_watermark THEN 'too high' WHEN highest_version - 1 < confirmed_watermark THEN 'behind' ELSE 'ok' END AS verdict FROM marks",
    "escan": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once WHERE {_OWN} ORDER BY stream_version LIMIT 100",
    "escan_range": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once WHERE {_OWN} AND stream_version BETWEEN 5 AND 25",
    "escan_count_has_more": f"WITH {_ONCE}, s AS (SELECT * FROM once WHERE {_OWN} AND stream_version BETWEEN 3 AND 60 ORDER BY stream_version LIMIT 11), p AS (SELECT * FROM s ORDER BY stream_version LIMIT 10) SELECT (SELECT count(*) FROM s) > 10 AS has_more, count(*) AS n, coalesce(string_agg(event_id, ',' ORDER BY stream_version), '') AS event_ids FROM p",
    "epscan": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once WHERE partition_id = {PARTITION} ORDER BY partition_sequence LIMIT 100",
    "epscan_range": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once WHERE partition_id = {PARTITION} AND partition_sequence BETWEEN 50 AND 150",
    "epscan_visible": f"WITH {_VISIBLE} SELECT {_WIRE_L} FROM seen WHERE partition_id = {PARTITION} ORDER BY partition_sequence LIMIT 100",
    "eget": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once WHERE event_id = (SELECT min(event_id) FROM event_log WHERE partition_id IS NOT NULL)",
    "eget_missing": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once WHERE false",
    "esver": f"WITH {_VISIBLE} SELECT CAST(partition_id % 4 AS INT) AS bucket_id, stream_id, max(stream_version) AS stream_version FROM seen GROUP BY ALL",
    "epseq": _ML + "SELECT partition_id, CASE WHEN confirmed_watermark > 0 THEN confirmed_watermark - 1 END AS partition_sequence FROM marks",
    "partition_sequences": "SELECT partition_id, max(partition_sequence) AS partition_sequence FROM event_log GROUP BY ALL",
    "stream_reverse": f"WITH {_ONCE} SELECT {_KEYS} FROM once WHERE {_OWN} AND stream_version <= 40",
    "partition_reverse": f"WITH {_ONCE} SELECT {_KEYS} FROM once WHERE partition_id = {PARTITION} ORDER BY partition_sequence DESC LIMIT 50",
    "read_transaction_tail": f"WITH {_ONCE}, w AS (SELECT * FROM once WHERE NOT ({_SINGLE}) ORDER BY -(partition_sequence % 2), event_id LIMIT 1) SELECT l.partition_id, l.partition_sequence, l.stream_version, l.event_id, l.stream_id, l.event_name FROM once l JOIN w ON l.partition_id = w.partition_id AND l.transaction_id = w.transaction_id AND l.partition_sequence >= w.partition_sequence",
    "stream_index_summary": f"WITH {_ONCE} SELECT CAST(partition_id % 4 AS INT) AS bucket_id, stream_id, min(partition_key) AS partition_key, min(stream_version) AS min_version, max(stream_version) AS max_version, count(*) AS n FROM once GROUP BY ALL",
    "partition_index_summary": f"WITH {_ONCE} SELECT partition_id, min(partition_sequence) AS min_sequence, max(partition_sequence) AS max_sequence, count(*) AS n FROM once GROUP BY ALL",
    "validate_sequences": f"WITH {_ONCE}, l AS (SELECT partition_id, partition_sequence, partition_sequence - coalesce(lag(partition_sequence) OVER (PARTITION BY partition_id ORDER BY partition_sequence), -1) - 1 AS missing FROM once WHERE confirmation_count >= {QUORUM}) SELECT * FROM l WHERE missing <> 0",
    "version_gap": f"""WITH {_ONCE}, e AS (SELECT partition_id, partition_sequence, [ 'any', 'exists', 'empty', CAST(partition_sequence % 7 AS VARCHAR) ][partition_sequence % 4 + 1] AS expected, CASE WHEN stream_version > 0 THEN stream_version - 1 END AS current FROM once),
x AS (SELECT *, TRY_CAST(expected AS BIGINT) AS v FROM e),
g AS (SELECT *, CASE WHEN expected = 'any' THEN 'none' WHEN expected = 'exists' THEN CASE WHEN current IS NULL THEN 'incompatible' ELSE 'none' END WHEN expected = 'empty' THEN CASE WHEN current IS NULL THEN 'none' ELSE 'ahead' END
  WHEN current IS NULL OR v > current THEN 'behind' WHEN v < current THEN 'ahead' ELSE 'none' END AS kind FROM x)
SELECT partition_id, partition_sequence, expected, current, kind, CASE WHEN kind IN ('none', 'incompatible') THEN NULL WHEN expected = 'empty' THEN current + 1 WHEN current IS NULL THEN v + 1 ELSE abs(v - current) END AS n, kind = 'none' AS satisfied,
  expected NOT IN ('any', 'exists') AS strict, CASE WHEN expected = 'empty' THEN 0 ELSE v + 1 END AS next_expected, coalesce(current + 1, 0) AS next_current FROM g""",
    "append_fold": _fold(False) + _NUMBERED,
    "stream_replay": f"WITH {_ONCE} SELECT row_number() OVER (ORDER BY partition_id, partition_sequence) - 1 AS cursor, partition_id, partition_sequence, event_id FROM once",
    "sequence_gap": f"""WITH {_ONCE}, e AS (SELECT partition_id, partition_sequence, stream_version AS v, CASE WHEN partition_sequence > 0 THEN partition_sequence - 1 END AS c FROM once)
SELECT partition_id, partition_sequence, CASE WHEN c IS NULL OR v > c THEN 'behind' WHEN v < c THEN 'ahead' ELSE 'none' END AS kind, CASE WHEN c IS NULL THEN v + 1 WHEN v <> c THEN abs(v - c) END AS n FROM e""",
    "append_any_versions": _D + "SELECT event_no AS request_no, stream_id, 'OK' AS status, stream_version, partition_id, partition_sequence FROM log",
    "strict_mode": _fold(True) + "SELECT CASE WHEN ok THEN 'OK' WHEN e IN ('any', 'exists') THEN 'INVALIDARG' ELSE 'WRONGVER' END AS status, count(*) AS n FROM j GROUP BY ALL",
    "sub_all_from_map_default": f"WITH {_ONCE} " + _sub("partition_sequence >= CASE partition_id WHEN 25 THEN 100 WHEN 1 THEN 40 ELSE 10 END"),
    "sub_partitions_from": f"WITH {_ONCE} " + _sub("partition_id IN (1, 5, 25) AND partition_sequence >= 20"),
    "sub_streams_from_map": _D + _sub("(stream_id = 'user-1' AND stream_version >= 10) OR stream_id = 'user-2'", "log"),
    "sub_window_first_page": f"WITH {_ONCE}, c AS (" + _sub("true") + ") SELECT * FROM c WHERE cursor <= 9",
    "sub_window_after_ack": f"WITH {_ONCE}, c AS (" + _sub("true") + ") SELECT * FROM c WHERE cursor BETWEEN 500 AND 509",
    "subscription_progress": """WITH a AS (SELECT subscription_id, max(cursor_no) AS acked FROM acks WHERE outcome = 'ok' GROUP BY ALL), d AS (SELECT subscription_id, max(cursor_no) AS sent FROM deliveries GROUP BY ALL)
SELECT s.subscription_id, acked, sent, window_size, greatest(0, coalesce(acked, -1) + window_size - coalesce(sent, -1)) AS room FROM subscriptions s LEFT JOIN a USING (subscription_id) LEFT JOIN d USING (subscription_id)""",
    "replica_gaps": f"WITH {_ONCE}, l AS (SELECT partition_id, partition_sequence AS s, coalesce(lag(partition_sequence) OVER (PARTITION BY partition_id ORDER BY partition_sequence), -1) AS p FROM once WHERE confirmation_count >= {QUORUM}) SELECT partition_id, p + 1 AS from_sequence, s - 1 AS to_sequence FROM l WHERE s - p > 1",
    "replica_sets": "SELECT DISTINCT partition_id, CAST(i AS INT) AS replica_no, CAST((partition_id % 4 % 5 + i) % 5 AS INT) AS node FROM event_log, range(3) t(i)",
    "coordinators": """WITH r AS (SELECT DISTINCT partition_id, CAST((partition_id % 4 % 5 + i) % 5 AS INT) AS node FROM event_log, range(3) t(i)), l AS (SELECT *, (node * 7) % 5 AS since FROM r WHERE node <> 2)
SELECT partition_id, arg_min(node, (since, node)) AS coordinator, count(*) AS live FROM l GROUP BY ALL""",
    "distribute_partition": f"WITH k AS (SELECT DISTINCT partition_key, {_hash('partition_key')} % 32 AS p FROM event_log) SELECT partition_key, CAST(p AS INT) AS first, CAST((p + 17) % 32 AS INT) AS second, CAST((p + 34) % 32 AS INT) AS third FROM k",
    "write_quorums": f"WITH {_ONCE} SELECT partition_id || '/' || partition_sequence AS write_id, CAST(confirmation_count AS BIGINT) AS copies, confirmation_count >= 2 AS quorum FROM once WHERE confirmation_count > 1",
    "escan_partition_key": f"WITH {_ONCE} SELECT {_WIRE_L} FROM once WHERE stream_id = '{STREAM}' AND partition_id % 4 IN ({PARTITION % 4}, {(PARTITION + 1) % 4}) AND stream_version BETWEEN 0 AND 3",
    "stream_forward": f"WITH {_VISIBLE} SELECT {_KEYS} FROM seen WHERE stream_id = '{STREAM}' AND partition_id = {PARTITION} AND stream_version >= 10",
    "filter_commit": f"WITH {_COMMITTED} SELECT partition_id, transaction_id, count(*) AS n, min(stream_version) AS first_version, max(stream_version) AS last_version FROM done WHERE stream_id = '{STREAM}' GROUP BY ALL",
    "epscan_has_more": f"""WITH {_VISIBLE}, p AS (SELECT * FROM seen WHERE partition_id = {PARTITION} AND partition_sequence BETWEEN 3 AND 12)
SELECT coalesce((SELECT confirmed_watermark - 1 FROM marks WHERE partition_id = {PARTITION}), -1) > coalesce(max(partition_sequence), 2) AS has_more, count(*) AS n, coalesce(string_agg(event_id, ',' ORDER BY partition_sequence), '') AS event_ids FROM p""",
    "append_onto_log": f"""{_fold(False)},
{_ONCE}, heads AS (SELECT CAST(partition_id % 4 AS INT) AS bucket_id, stream_id, max(stream_version) AS v, arg_max(partition_key, stream_version) AS partition_key FROM once GROUP BY ALL)
SELECT partition_id, j.stream_id, r.event_name, stream_version, 1900000000000 AS timestamp, CAST(1 AS INT) AS confirmation_count FROM j JOIN (SELECT event_id AS request_no, event_type AS event_name FROM events) r USING (request_no) WHERE ok
UNION ALL SELECT CAST({_hash('partition_key')} % 32 AS INT), stream_id, 'again', v + 1, 1900000000000, 1 FROM heads WHERE bucket_id % 2 = 0""",
    "append_tops": f"""{_fold(False)}, {_ONCE}, b AS (SELECT partition_id, count(*) AS n FROM once GROUP BY ALL), a AS (SELECT partition_id, count(*) AS n FROM j WHERE ok GROUP BY ALL)
SELECT coalesce(a.partition_id, b.partition_id) AS partition_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, coalesce(a.n, 0) + coalesce(b.n, 0) AS n_sequences, coalesce(a.n, 0) + coalesce(b.n, 0) AS next_sequence FROM a FULL JOIN b ON a.partition_id = b.partition_id""",
    "set_confirmations": f"""WITH {_ONCE}, {_MARKS},
f AS (SELECT partition_id, min(partition_sequence) AS s FROM once JOIN marks USING (partition_id) WHERE partition_sequence >= confirmed_watermark AND coalesce(confirmation_count, 0) < {QUORUM} GROUP BY ALL),
n2 AS (SELECT num.*, CASE WHEN partition_sequence = f.s THEN {QUORUM} ELSE c END AS c2 FROM num LEFT JOIN f USING (partition_id))
SELECT partition_id, coalesce(min(rn) FILTER (rn <> partition_sequence OR c2 < {QUORUM}), max(rn) + 1) AS confirmed_watermark, max(partition_sequence) + 1 AS highest_version FROM n2 GROUP BY ALL""",
    "stuck_events": _ML + f""", t AS (SELECT partition_id, max(timestamp_ns) AS now_ns, max(partition_sequence) AS top FROM once GROUP BY ALL)
SELECT partition_id, partition_sequence, event_id, top - partition_sequence AS attempts FROM once JOIN marks USING (partition_id) JOIN t USING (partition_id)
WHERE partition_sequence >= confirmed_watermark AND coalesce(confirmation_count, 0) < {QUORUM} AND top - partition_sequence >= 3 AND now_ns - timestamp_ns >= 3600000000000""",
    "watermark_gap_block": f"""WITH {_ONCE}, num AS (SELECT partition_id, partition_sequence, coalesce(confirmation_count, 0) AS c, row_number() OVER (PARTITION BY partition_id ORDER BY partition_sequence) - 1 AS rn FROM once WHERE partition_sequence <> 20)
SELECT partition_id, coalesce(min(rn) FILTER (rn <> partition_sequence OR c < {QUORUM}), max(rn) + 1) AS confirmed_watermark, max(partition_sequence) + 1 AS highest_version FROM num GROUP BY ALL""",
    "watermark_reopen": _ML + "SELECT partition_id, confirmed_watermark, highest_version FROM marks",
    "sync_range": f"""WITH {_VISIBLE}, o AS (SELECT * FROM seen WHERE partition_sequence >= 10), i AS (SELECT * FROM o WHERE partition_sequence <= 60)
SELECT {_KEYS} FROM o WHERE partition_sequence <= 60 OR (NOT ({_SINGLE}) AND (partition_id, transaction_id) IN (SELECT (partition_id, transaction_id) FROM i WHERE NOT ({_SINGLE})))""",
    "accept_rules": f"""WITH {_ONCE} SELECT partition_id, partition_sequence, CASE WHEN partition_sequence > 0 AND confirmation_count IS NULL THEN 'MISSINGPARTSEQ' WHEN NOT (coalesce(confirmation_count, 0) > 1) THEN 'INVALIDSENDER' WHEN stream_version * 1000 > 30000 THEN 'STALEWRITE'
  WHEN partition_id % 3 = 2 THEN 'PARTNOTOWNED' ELSE 'OK' END AS status FROM once""",
    "memberships": f"""WITH {_ONCE}, b AS (SELECT 'node-' || partition_id AS node, timestamp_ns // 1000000 AS at_ms FROM once WHERE timestamp_ns IS NOT NULL),
f AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY node ORDER BY at_ms)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY node ORDER BY at_ms ROWS UNBOUNDED PRECEDING) AS spell FROM f)
SELECT node, min(at_ms) AS alive_since, max(at_ms) AS last_seen FROM s GROUP BY node, spell""",
    "replica_confirm": f"""WITH {_ONCE}, c AS (SELECT partition_id, CASE WHEN partition_sequence % 4 = 3 THEN 'other event' ELSE 'ok' END AS status FROM once UNION ALL SELECT DISTINCT partition_id, 'missing' FROM once)
SELECT partition_id, status, count(*) AS n FROM c GROUP BY ALL""",
}
