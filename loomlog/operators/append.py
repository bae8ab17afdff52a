"""Appends: optimistic concurrency, gapless numbering, atomic transactions.

Whether a request is accepted depends on those accepted before it, so requests
are folded in order. Single-event requests depend on their stream only and are
folded per stream; transactions over several streams are folded per bucket.
Rows stream through a task in order; what it holds is the state of its streams,
not their requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import ids
from loomlog.functions.versions import gap_of
from loomlog.operators.blocks import block_of, block_rank
from loomlog.scratch import sized

#: request_no orders requests; requests of one tx_no are one transaction.
REQUEST = "request_no bigint, tx_no bigint, partition_key string, partition_id int, stream_id string, event_name string, expected_version string"
RESULT = "request_no bigint, tx_no bigint, partition_id int, bucket_id int, stream_id string, status string, message string, stream_version bigint"


def checked(requests: DataFrame, strict: bool = False, partitions: int = ids.PARTITIONS, buckets: int = ids.BUCKETS) -> DataFrame:
    """Requests with their defaults filled in, and the error of those that fail before any state is asked.

    ``requests``: request_no, tx_no, stream_id, event_name, expected_version
    and, optionally, partition_key, event_id, timestamp_ms and
    expected_partition_sequence.
    """
    cols = requests.columns
    key = F.coalesce(F.col("partition_key"), ids.default_partition_key("stream_id")) if "partition_key" in cols else ids.default_partition_key("stream_id")
    r = requests.withColumn("partition_key", key).withColumn("partition_id", ids.partition_id("partition_key", partitions)).withColumn("bucket_id", ids.bucket_id("partition_id", buckets))
    from loomlog.functions.versions import parse

    e = F.coalesce(parse("expected_version"), F.when(F.col("expected_version").isNull(), "any"))
    r = r.withColumn("expected_version", e)
    error = F.when(F.col("expected_version").isNull(), "INVALIDARG invalid expected version").when(~ids.valid_stream_id("stream_id"), "INVALIDARG invalid stream id")
    if strict:
        error = error.when(F.col("expected_version").isin("any", "exists"), F.concat(F.lit("INVALIDARG strict versioning mode rejects EXPECTED_VERSION "), F.col("expected_version")))
    if "event_id" in cols:
        error = error.when(F.col("event_id").isNotNull() & ~ids.embeds_hash("event_id", "partition_key"), "INVALIDARG the event id must embed the partition hash")
    if "timestamp_ms" in cols:
        error = error.when(F.col("timestamp_ms").isNotNull() & ids.to_ns("timestamp_ms").isNull(), "INVALIDARG timestamp out of range")
    expected = F.lit(None).cast("string")
    if "expected_partition_sequence" in cols:
        expected = parse(F.col("expected_partition_sequence").cast("string"))
        error = error.when(F.col("expected_partition_sequence").isNotNull() & expected.isNull(), "INVALIDARG invalid expected partition sequence")
    return r.withColumn("expected_partition_sequence", expected).withColumn("error", error)


def fold_transaction(streams: dict, tx: list[tuple]) -> tuple[list[tuple], dict]:
    """Judge one transaction: ([(status, message, version)], the streams it changes).

    ``streams``: stream id -> (partition key, version); ``tx``: (stream id,
    partition key, expectation, error). All of it succeeds or none; the first
    failure is the message of every request.
    """
    running: dict = {}
    out = []
    failed = None
    for stream, key, expected, error in tx:
        if error:
            failed = tuple(error.split(" ", 1))
            break
        have = running.get(stream) or streams.get(stream)
        if have and have[0] != key:
            failed = ("DBOPFAILED", "partition key mismatch")
            break
        current = have[1] if have else None
        if gap_of(expected, current)[0] != "none":
            failed = ("WRONGVER", f"expected {expected}, current {'empty' if current is None else current}")
            break
        version = 0 if current is None else current + 1
        running[stream] = (key, version)
        out.append(("OK", None, version))
    if failed:
        return [(failed[0], failed[1] if len(failed) > 1 else "", None)] * len(tx), {}
    return out, running


def sequence_error(expected: str | None, following: int) -> tuple | None:
    """The refusal of a write that expects another sequence than its partition would give it next."""
    current = None if not following else following - 1
    if expected is None or gap_of(expected, current)[0] == "none":
        return None
    return ("WRONGSEQ", f"expected partition sequence {expected}, current {'empty' if current is None else current}")


def _fold(df: DataFrame, keys: list[str], heads: DataFrame | None = None, tops: DataFrame | None = None) -> DataFrame:
    """Fold transactions in order of tx_no within a key; rows of a key are contiguous in a task.

    What is stored already comes in the same rows and sorts first: ``heads``
    (bucket_id, stream_id, partition_key, stream_version) with the current
    version of streams, ``tops`` (bucket_id, partition_id, next_sequence). With
    a key that is a whole bucket, expected partition sequences are judged too.
    """
    names = ["kind", "tx_no", "request_no", "partition_id", "bucket_id", "stream_id", "partition_key", "expected_version", "error", "expected_partition_sequence", "known"]
    rows = df.withColumn("kind", F.lit(1)).withColumn("known", F.lit(None).cast("bigint"))
    none = F.lit(None)
    if heads is not None:
        rows = rows.unionByName(heads.select("bucket_id", "stream_id", "partition_key", F.col("stream_version").alias("known"), F.lit(0).alias("kind")), allowMissingColumns=True)
    if tops is not None and len(keys) == 1:
        rows = rows.unionByName(tops.select("bucket_id", "partition_id", F.col("next_sequence").alias("known"), F.lit(0).alias("kind"), none.cast("string").alias("stream_id")), allowMissingColumns=True)
    laid = rows.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *names).repartition(*[f"_key{i}" for i in range(len(keys))])
    laid = laid.sortWithinPartitions(*[f"_key{i}" for i in range(len(keys))], "kind", "tx_no", "request_no")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict = {}
        following: dict = {}
        key, tx_no, tx, out = None, None, [], []

        def close() -> None:
            verdicts, changed = fold_transaction(streams, [(r[5], r[6], r[7], r[8]) for r in tx])
            if changed:
                p = tx[0][3]
                wrong = next((w for w in (sequence_error(r[9], following.get(p, 0)) for r in tx) if w), None)
                if wrong:
                    verdicts, changed = [(*wrong, None)] * len(tx), {}
                else:
                    following[p] = following.get(p, 0) + len(tx)
            streams.update(changed)
            out.extend((r[2], r[1], r[3], r[4], r[5], *v) for r, v in zip(tx, verdicts))
            tx.clear()

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
            fields = ["request_no", "tx_no", "partition_id", "bucket_id", "stream_id", "status", "message", "stream_version"]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=fields)
            out.clear()
            return b

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                own, r = row[:width], row[width:]
                if tx and (own != key or r[1] != tx_no):
                    close()
                    if len(out) > 8192:
                        yield flush()
                if own != key:
                    streams, following = {}, {}
                key, tx_no = own, r[1]
                if r[0]:
                    tx.append(r)
                elif r[5] is None:
                    following[r[3]] = r[10]
                else:
                    streams[r[5]] = (r[6], r[10])
        if tx:
            close()
        if out:
            yield flush()

    return laid.mapInArrow(run, RESULT)


def too_large(requests: DataFrame, segment_bytes: int, header_bytes: int = 64) -> DataFrame:
    """Transactions that no segment can hold: (tx_no, n_bytes). ``requests``: tx_no, n_bytes (null: 0)."""
    size = F.sum(F.coalesce("n_bytes", F.lit(0)) + header_bytes)
    return requests.groupBy("tx_no").agg(size.alias("n_bytes")).where(F.col("n_bytes") > segment_bytes)


def append(
    requests: DataFrame, strict: bool = False, partitions: int = ids.PARTITIONS, buckets: int = ids.BUCKETS, atomic: bool = False,
    heads: DataFrame | None = None, tops: DataFrame | None = None, segment_bytes: int | None = None,
) -> DataFrame:
    """The verdict on every request: status OK or an error code, message, version and sequence.

    ``atomic``: requests of one tx_no succeed or fail together, judged in order
    within their bucket; a transaction spans one partition, others fail with
    INVALIDARG. Otherwise every request stands alone and order matters only
    within its stream, but for requests that expect a partition sequence: with
    such, all of a bucket are judged in order. A null request_no or tx_no has
    no order and is refused.

    ``heads`` and ``tops`` are what is stored: current versions of streams
    (bucket_id, stream_id, partition_key, stream_version) and next sequences
    (partition_id, next_sequence). ``segment_bytes`` refuses transactions whose
    payloads and metadata no segment can hold.
    """
    r = checked(requests, strict, partitions, buckets)
    if not atomic:
        r = r.withColumn("tx_no", F.col("request_no"))
    r = r.withColumn("error", F.coalesce("error", F.when(F.col("request_no").isNull() | F.col("tx_no").isNull(), "INVALIDARG a request needs a number")))
    if segment_bytes is not None:
        size = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("payload", "metadata") if c in requests.columns), F.lit(0)).cast("bigint")
        big = too_large(r.where("tx_no is not null").select("tx_no", size.alias("n_bytes")), segment_bytes).select("tx_no", F.lit(True).alias("_big"))
        r = r.join(big, "tx_no", "left").withColumn("error", F.coalesce("error", F.when(F.col("_big"), "DBOPFAILED events exceed the size of a segment")))
    tops = tops.withColumn("bucket_id", ids.bucket_id("partition_id", buckets)) if tops is not None else None
    if not atomic:
        in_order = "expected_partition_sequence" in requests.columns
        judged = _fold(r, ["bucket_id"] if in_order else ["bucket_id", "stream_id"], heads, tops)
    else:
        spans = r.groupBy("tx_no").agg((F.count_distinct("partition_id") > 1).alias("_spans"), F.min("bucket_id").alias("_home"))
        r = r.join(spans, F.equal_null(r["tx_no"], spans["tx_no"])).drop(spans["tx_no"])
        r = r.withColumn("error", F.coalesce("error", F.when(F.col("_spans"), "INVALIDARG a transaction must stay in one partition")))
        judged = _fold(r.withColumn("bucket_id", F.col("_home")), ["bucket_id"], heads, tops)
    return numbered(judged, tops)


def numbered(judged: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """Give accepted requests the next sequences of their partition, in request order, after what ``tops`` says is stored."""
    ok = block_rank(judged.where("status = 'OK'").withColumn("_block", block_of("request_no")), ["partition_id"], "_block", [F.col("request_no")], "partition_sequence").drop("_block")
    if tops is not None:
        known = sized(tops.select("partition_id", F.col("next_sequence").alias("_next")), 1 << 16, "tops")
        ok = ok.join(known, "partition_id", "left").withColumn("partition_sequence", F.col("partition_sequence") + F.coalesce("_next", F.lit(0))).drop("_next").select(*ok.columns)
    return ok.unionByName(judged.where("status <> 'OK'").withColumn("partition_sequence", F.lit(None).cast("bigint")))


def replies(results: DataFrame) -> DataFrame:
    """Per accepted transaction: first and last sequence and the last version of each of its streams."""
    ok = results.where("status = 'OK'")
    per = ok.groupBy("tx_no", "partition_id", "stream_id").agg(F.max("stream_version").alias("v"), F.min("partition_sequence").alias("a"), F.max("partition_sequence").alias("b"))
    return per.groupBy("tx_no", "partition_id").agg(
        F.min("a").alias("first_partition_sequence"), F.max("b").alias("last_partition_sequence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream_id", "v")))).alias("stream_versions")
    )
