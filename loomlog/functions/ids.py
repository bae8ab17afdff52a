"""Identifiers and routing as column expressions, all on hex digits: a 64-bit integer cannot hold a UUID's half unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
NAMESPACE_PARTITION_KEY = "219bd637-e279-53e9-9e2b-eabe5d9120cc"
PARTITIONS = 32
BUCKETS = 4
MAX_REPLICATION = 12
MAX_STREAM_ID_BYTES = 64


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dashed(digits: Column) -> Column:
    """32 hex digits as a hyphenated UUID."""
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _byte(digits: Column, i: int) -> Column:
    return F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("bigint")


def default_partition_key(stream_id: Column | str) -> Column:
    """The key of a stream that names none: UUID v5 of its id."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_PARTITION_KEY.replace("-", ""))), F.encode(_c(stream_id), "UTF-8")))
    variant = F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8))
    return dashed(F.lower(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))))


def partition_hash(key: Column | str) -> Column:
    """16 bits of a UUID: bits 61 to 46."""
    d = F.regexp_replace(F.lower(_c(key)), "-", "")
    b8, b9, b10 = (_byte(d, i) for i in (8, 9, 10))
    return (F.shiftleft(b8.bitwiseAND(63), 10) + F.shiftleft(b9, 2) + F.shiftright(b10, 6)).cast("int")


def partition_id(key: Column | str, partitions: int = PARTITIONS) -> Column:
    return (partition_hash(key) % partitions).cast("int")


def bucket_id(partition: Column | str, buckets: int = BUCKETS) -> Column:
    return F.lit(0).cast("int") if buckets == 1 else (_c(partition) % buckets).cast("int")


def event_id(timestamp_ms: Column | str, hash16: Column | str, seed: Column | str) -> Column:
    """An event id: 48 bits of time, 12 random, version 7, variant 2, the hash, 46 random.

    ``seed`` gives 16 hex digits or more of randomness.
    """
    s = F.lower(_c(seed))
    r = F.conv(F.substring(s, 4, 1), 16, 10).cast("bigint").bitwiseAND(3)
    middle = F.lit(0x80000) + _c(hash16).cast("bigint") * 4 + r
    time = F.lpad(F.hex(_c(timestamp_ms).cast("bigint")), 12, "0")
    return dashed(F.lower(F.concat(time, F.substring(s, 1, 3), F.lit("7"), F.lpad(F.hex(middle), 5, "0"), F.substring(s, 5, 11))))


def embeds_hash(event: Column | str, key: Column | str) -> Column:
    """Whether an event id carries the hash of its partition key."""
    return partition_hash(event) == partition_hash(key)


def single_event(transaction_id: Column | str) -> Column:
    """Whether a transaction id is flagged as that of a single event."""
    d = F.regexp_replace(F.lower(_c(transaction_id)), "-", "")
    return F.substring(d, 17, 1) >= "8"


def with_flag(transaction_id: Column | str, single: Column | bool) -> Column:
    """A transaction id with the flag set or cleared."""
    d = F.regexp_replace(F.lower(_c(transaction_id)), "-", "")
    nibble = F.conv(F.substring(d, 17, 1), 16, 10).cast("bigint").bitwiseAND(7)
    on = single if isinstance(single, Column) else F.lit(single)
    return dashed(F.concat(F.substring(d, 1, 16), F.lower(F.hex(nibble + F.when(on, 8).otherwise(0))), F.substring(d, 18, 15)))


def valid_stream_id(stream_id: Column | str) -> Column:
    c = _c(stream_id)
    return F.coalesce((F.octet_length(c) >= 1) & (F.octet_length(c) <= MAX_STREAM_ID_BYTES) & ~c.contains("\0"), F.lit(False))


def confirmation_byte(count: Column | str) -> Column:
    """The stored byte of a confirmation count: its nibble twice; null outside 0..12."""
    c = _c(count).cast("int")
    return F.when((c >= 0) & (c <= MAX_REPLICATION), c * 17).cast("int")


def confirmation_count(byte: Column | str) -> Column:
    """The count of a stored byte; null if its nibbles disagree or exceed 12."""
    b = _c(byte).cast("int")
    return F.when((F.shiftright(b, 4) == b.bitwiseAND(15)) & (b.bitwiseAND(15) <= MAX_REPLICATION), b.bitwiseAND(15)).cast("int")


def record_header(timestamp_ns: Column | str, commit: Column | bool) -> Column:
    """(timestamp_ns, is_commit) of a record; null for a timestamp that needs the sign bit."""
    t = _c(timestamp_ns)
    return F.when(t >= 0, F.struct(t.alias("timestamp_ns"), (commit if isinstance(commit, Column) else F.lit(commit)).alias("is_commit")))


def to_ns(timestamp_ms: Column | str) -> Column:
    """Milliseconds to nanoseconds; null where that overflows or is negative."""
    n = F.try_multiply(_c(timestamp_ms).cast("bigint"), F.lit(1_000_000).cast("bigint"))
    return F.when(n >= 0, n)


def to_ms(timestamp_ns: Column | str) -> Column:
    return F.floor(_c(timestamp_ns).cast("decimal(20,0)") / 1_000_000).cast("bigint")


def select_partition(selector: Column | str, partitions: int = PARTITIONS) -> Column:
    """A partition from a key or a number; numbers up to 65535 are not checked against the range."""
    s = F.trim(_c(selector))
    is_key = F.regexp_replace(F.lower(s), "^urn:uuid:|[{}-]", "").rlike("^[0-9a-f]{32}$")
    number = s.try_cast("int")
    return F.when(is_key, partition_id(F.regexp_replace(F.lower(s), "^urn:uuid:|[{}-]", ""), partitions)).when((number >= 0) & (number <= 65535), number)


def distribute(hash16: Column | str, partitions: int, replication: int) -> Column:
    """Replica partitions of a hash: steps of a bit over half the ring, until one repeats."""
    p = (_c(hash16) % partitions).cast("int")
    jump = 1 if partitions <= 2 else partitions // 2 + 1
    if partitions > 2 and partitions % 2 == 0 and jump % 2 == 0:
        jump += 1
    seen: list[int] = []
    for i in range(min(replication, partitions, MAX_REPLICATION)):
        step = i * jump % partitions
        if step in seen:
            break
        seen.append(step)
    return F.array(*[((p + s) % partitions).cast("int") for s in seen])


def expand_range(text: str, partitions: int = PARTITIONS) -> list[int]:
    """Partitions of ``*``, ``a-b`` (clamped to what exists) or a comma-separated list."""
    t = text.strip()
    if t == "*":
        return list(range(partitions))
    out: set[int] = set()
    for part in t.split(","):
        a, dash, b = part.strip().partition("-")
        if dash:
            out.update(range(int(a), min(int(b), partitions - 1) + 1))
        elif int(a) < partitions:
            out.add(int(a))
    return sorted(out)
