"""The rules of replication as table operators: order, gaps, placement, membership, breakers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class OrderedQueue:
    """A buffer that delivers writes by key, in order, each once.

    ``insert`` says what happened: deliver, merge, conflict, stale, evict, full
    or buffer.
    """

    next: int = 0
    capacity: int = 100
    waiting: dict[int, tuple[str, list]] = field(default_factory=dict)

    def insert(self, key: int, tx: str, payload: object = None) -> tuple[str, int | None]:
        held = self.waiting.get(key)
        if key < self.next:
            return "stale", None
        if key == self.next:
            if held is None:
                self.waiting[key] = (tx, [payload])
                return "deliver", None
            if held[0] == tx:
                held[1].append(payload)
                return "deliver", None
            return "conflict", None
        evicted = None
        if len(self.waiting) >= self.capacity:
            top = max(self.waiting)
            if key >= top:
                return "full", None
            del self.waiting[top]
            evicted = top
            held = self.waiting.get(key)
        if held is None:
            self.waiting[key] = (tx, [payload])
        elif held[0] == tx:
            held[1].append(payload)
            return ("evict", evicted) if evicted is not None else ("merge", None)
        else:
            return "conflict", evicted
        return ("evict", evicted) if evicted is not None else ("buffer", None)

    def take(self, width: int = 1) -> tuple[str, list] | None:
        """The next write, if it has come; the key after it is expected next."""
        got = self.waiting.pop(self.next, None)
        if got is not None:
            self.next += width
        return got


class TimeoutQueue(OrderedQueue):
    """An ordered queue that forgets writes that waited too long."""

    def __init__(self, timeout: float, clock: Callable[[], float] = time.monotonic, **kw: object):
        super().__init__(**kw)
        self.timeout, self.clock, self.since = timeout, clock, {}

    def insert(self, key: int, tx: str, payload: object = None) -> tuple[str, int | None]:
        out = super().insert(key, tx, payload)
        if out[0] in ("buffer", "evict", "deliver"):
            self.since.setdefault(key, self.clock())
        return out

    def expired(self) -> list[int]:
        """Drop and return the keys that waited for ``timeout`` or longer."""
        gone = [k for k, t in self.since.items() if k in self.waiting and self.clock() - t >= self.timeout]
        for k in gone:
            del self.waiting[k]
            del self.since[k]
        return sorted(gone)


class CircuitBreaker:
    """Opens after repeated failures, lets a few calls try after a pause, closes on their success."""

    def __init__(self, failures: int = 10, pause: float = 30.0, trial_calls: int = 3, successes: int = 2, clock: Callable[[], float] = time.monotonic):
        self.limit, self.pause, self.trial_calls, self.needed, self.clock = failures, pause, trial_calls, successes, clock
        self.state, self.failed, self.passed, self.tried, self.since = "closed", 0, 0, 0, 0.0

    def allow(self) -> bool:
        if self.state == "open" and self.clock() - self.since >= self.pause:
            self.state, self.tried, self.passed = "half-open", 0, 0
        if self.state == "half-open":
            self.tried += 1
            return self.tried <= self.trial_calls
        return self.state == "closed"

    def success(self) -> None:
        self.failed = 0
        if self.state == "half-open":
            self.passed += 1
            if self.passed >= self.needed:
                self.state = "closed"

    def failure(self) -> None:
        self.failed += 1
        if self.state == "half-open" or self.failed >= self.limit:
            self.state, self.since = "open", self.clock()


def quorum_reached(acks: DataFrame, rf: int) -> DataFrame:
    """Per write: replicas that answered, the writer included, and whether they are a quorum. ``acks``: write_id, node."""
    n = F.count_distinct("node") + 1
    return acks.groupBy("write_id").agg(n.alias("copies"), (n >= rf // 2 + 1).alias("quorum"))


def accept_rules(writes: DataFrame) -> DataFrame:
    """What a replica answers: (…, expected_sequence, sender_known, age_ms, timeout_ms, owned) gives status."""
    strict = F.col("expected_sequence").isNotNull() & ~F.col("expected_sequence").isin("any", "exists")
    status = F.when(~strict, "MISSINGPARTSEQ").when(~F.col("sender_known"), "INVALIDSENDER").when(F.col("age_ms") > F.col("timeout_ms"), "STALEWRITE").when(~F.col("owned"), "PARTNOTOWNED").otherwise("OK")
    return writes.withColumn("status", status)


def missing_ranges(sequences: DataFrame, key: str, sequence: str) -> DataFrame:
    """Ranges [from, to] of sequences that a replica lacks below the ones it has.

    Runs on distinct sequences in blocks; a gap between blocks is found by the
    summary rows of the blocks.
    """
    from loomlog.operators.blocks import block_of, prefix_by_block

    s = sequences.where(F.col(key).isNotNull() & F.col(sequence).isNotNull()).select(F.col(key).alias("_k"), F.col(sequence).alias("_s"), block_of(sequence).alias("_b")).distinct()
    before = prefix_by_block(s, ["_k"], "_b", {"top": F.max("_s")}, {"top": "max"})
    w = Window.partitionBy("_k", "_b").orderBy("_s")
    prev = F.coalesce(F.lag("_s").over(w), F.col("prev_top"), F.lit(-1))
    return s.join(before, ["_k", "_b"]).withColumn("_prev", prev).where("_s - _prev > 1").select(F.col("_k").alias(key), (F.col("_prev") + 1).alias("from_sequence"), (F.col("_s") - 1).alias("to_sequence"))


def sync_range(log: DataFrame, commits: DataFrame, marks: DataFrame, first: int, last: int) -> DataFrame:
    """What a replica that lags is sent of the range from ``first`` to ``last`` of each partition.

    Only events of whole commits under the watermark; a commit that reaches
    over the end of the range is sent as a whole, one that began before it only
    from ``first`` on.
    """
    from loomlog.functions import ids
    from loomlog.operators.reads import below_watermark, committed

    done = committed(below_watermark(log, marks), commits).where(F.col("partition_sequence") >= first)
    single = ids.single_event("transaction_id")
    inside = done.where(F.col("partition_sequence") <= last)
    begun = inside.where(~single).select(F.col("partition_id").alias("_p"), F.col("transaction_id").alias("_t")).distinct()
    rest = done.where(~single & (F.col("partition_sequence") > last)).join(begun, (F.col("partition_id") == F.col("_p")) & (F.col("transaction_id") == F.col("_t")), "left_semi")
    return inside.unionByName(rest)


def confirmation_retries(tries: int = 5, first_ms: int = 100, most_ms: int = 5000) -> list[int]:
    """The pauses between the tries to confirm a write: doubled each time, up to a limit."""
    return [min(first_ms << i, most_ms) for i in range(tries - 1)]


def replica_sets(partitions: DataFrame, nodes: int, rf: int, buckets: int) -> DataFrame:
    """(partition_id, replica_no, node): the node of its bucket, then its followers in the ring."""
    first = (F.col("partition_id") % buckets) % nodes
    return partitions.select("partition_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(min(rf, nodes) - 1)), lambda i: ((first + i) % nodes).cast("int"))).alias("replica_no", "node"))


def coordinators(replicas: DataFrame, alive: DataFrame) -> DataFrame:
    """The coordinator of each partition: its live replica that has lived longest. ``alive``: node, alive_since."""
    return replicas.join(alive, "node").groupBy("partition_id").agg(F.min(F.struct("alive_since", "node")).alias("c"), F.count(F.lit(1)).alias("live")).select("partition_id", F.col("c.node").alias("coordinator"), "live")


def bucket_ranges(nodes: int, buckets: int) -> list[tuple[int, int, int]]:
    """Contiguous bucket ranges per node: (node, first, last); earlier nodes take what is left over."""
    out, at = [], 0
    for n in range(nodes):
        size = buckets // nodes + (n < buckets % nodes)
        if size:
            out.append((n, at, at + size - 1))
        at += size
    return out


def memberships(heartbeats: DataFrame, timeout_ms: int) -> DataFrame:
    """Spells of life per node: (node, alive_since, last_seen), a new one after silence longer than the timeout.

    Heartbeats less than the timeout apart are of one spell, so they are first
    reduced to one row per stretch of that length, with map-side combining; what
    meets in a window over a node depends on its time of life, not on how often
    it was heard.
    """
    known = heartbeats.where("node is not null and at_ms is not null").withColumn("_cell", F.floor(F.col("at_ms") / F.lit(max(timeout_ms, 1))))
    cells = known.groupBy("node", "_cell").agg(F.min("at_ms").alias("first"), F.max("at_ms").alias("last"))
    w = Window.partitionBy("node").orderBy("_cell")
    new = F.coalesce((F.col("first") - F.lag("last").over(w) > timeout_ms).cast("int"), F.lit(1))
    spells = cells.withColumn("_new", new).withColumn("_spell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spells.groupBy("node", "_spell").agg(F.min("first").alias("alive_since"), F.max("last").alias("last_seen")).drop("_spell")
