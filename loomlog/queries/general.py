"""Queries of the data-processing operators over whole tables, and their SQL."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.names import payload_number, uuid_key, with_event_type
from loomlog.operators import dedupe, features, heavy, incremental, late
from loomlog.operators.blocks import block_of
from loomlog.scratch import new_folder, stage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events_once(log: DataFrame, *columns: str) -> DataFrame:
    """The log with rows of the same (partition_id, partition_sequence) as one event.

    Shuffled by blocks of the sequence: even, whatever partition is hot.
    """
    keep = [c for c in columns if c not in ("partition_id", "partition_sequence")]
    rows = log.where("partition_id is not null and partition_sequence is not null").select("partition_id", "partition_sequence", block_of("partition_sequence", 1 << 12).alias("_block"), *keep)
    return rows.repartition("partition_id", "_block").dropDuplicates(["partition_id", "_block", "partition_sequence"]).drop("_block")


def _delivered_points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Deliveries and acks in the columns of the incremental operator."""
    d = table(spark, sf, "deliveries").select(
        F.col("subscription_id").alias("consumer"), F.col("partition_id").alias("part"), F.col("partition_sequence").alias("seq"),
        F.col("cursor_no").alias("cursor"), F.col("delivery_id").alias("tie"), F.col("confirmation_count").alias("version"),
    )
    return d, table(spark, sf, "acks").where("outcome = 'ok'").select(F.col("subscription_id").alias("consumer"), F.col("cursor_no").alias("cursor"))


def _as_records(points: DataFrame) -> DataFrame:
    return points.select(F.col("consumer").alias("subscription_id"), F.col("part").alias("partition_id"), F.col("seq").alias("partition_sequence"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The next run of a ledger whose last run is what the acks cover."""
    last = stage(incremental.last_copies(*_delivered_points(spark, sf)), "copies")
    ledger = incremental.RunLedger(spark, new_folder(spark, "ledger"))
    ledger.run(incremental.processed(last))
    return _as_records(ledger.output(ledger.run(incremental.available(last))))


def p2_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same records after a history: a run to half of what was acked, one that fails, its repetition, then the next."""
    deliveries, acks = _delivered_points(spark, sf)
    half = acks.where("cursor is not null").groupBy("consumer").agg(F.floor(F.max("cursor") / 2).alias("cursor"))
    early = stage(incremental.last_copies(deliveries, half), "early")
    last = stage(incremental.last_copies(deliveries, acks), "copies")
    ledger = incremental.RunLedger(spark, new_folder(spark, "ledger"))
    ledger.run(incremental.processed(early))

    def dies(taken: DataFrame) -> DataFrame:
        return taken.select("consumer", F.raise_error(F.lit("the run died")).cast("string").alias("seq"))

    try:
        ledger.run(incremental.processed(last), dies)
    except Exception as e:  # noqa: BLE001  the failure is part of the history
        if "the run died" not in str(e):
            raise
    ledger.run(incremental.processed(last))
    return _as_records(ledger.output(ledger.run(incremental.available(last))))


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "event_log").select(F.col("partition_id").alias("key"), F.col("partition_sequence").alias("seq"), F.col("timestamp_ns").alias("ts"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return late.changelog(_timed(spark, sf)).select(F.col("key").alias("partition_id"), F.col("seq").alias("partition_sequence"))


def p4_changelog(spark: SparkSession, sf: str) -> DataFrame:
    log = late.deltas(late.changelog(_timed(spark, sf)))
    return log.select(F.col("key").alias("partition_id"), F.col("period").alias("hour"), "version", F.col("seq").alias("partition_sequence"), "sign", F.col("count").alias("n"))


def p4_hourly(spark: SparkSession, sf: str) -> DataFrame:
    c = late.corrected_counts(_timed(spark, sf))
    return c.select(F.col("key").alias("partition_id"), F.col("period").alias("hour"), "published_count", "corrections", F.col("count").alias("n"), "dropped")


def p4_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per day of all partitions, kept right by the deltas of the hourly counts below them."""
    c = late.corrected_counts(_timed(spark, sf), by={"day": F.expr("period div 24L")})
    return c.select("day", F.col("count").alias("n"), F.col("version").alias("corrections"))


def event_type_names(types: DataFrame, most: int = 5_000) -> list[str]:
    """The event types in order; a dimension of more than ``most`` is refused, not cut."""
    names = [r[0] for r in types.select("event_type").where("event_type is not null").distinct().orderBy("event_type").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} event types are no feature columns")
    return names


ENTITY = ["partition_id", "stream_id"]


def _typed_once(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Each event once, as (partition_id, stream_id, event_type, ts, amount)."""
    log = table(spark, sf, "event_log").withColumn("amount", payload_number("payload"))
    once = events_once(log, "stream_id", "event_name", "timestamp_ns", "amount", *more).withColumnRenamed("timestamp_ns", "ts")
    return with_event_type(once, table(spark, sf, "event_types"))


def _new_store(spark: SparkSession) -> features.FeatureStore:
    return features.FeatureStore(spark, new_folder(spark, "features"), ENTITY)


def p5_features(spark: SparkSession, sf: str) -> DataFrame:
    store = _new_store(spark)
    store.refresh(_typed_once(spark, sf))
    return store.read(event_type_names(table(spark, sf, "event_types")))


#: A range that cuts a day at both ends, and how far clocks were off before they were set right.
P5_RANGE = (1893546000123456789, 1893970000000000001)
P5_SKEW_NS = 129_600_000_000_000


def p5_store(spark: SparkSession, sf: str) -> DataFrame:
    """Features over a range, from a store that was filled early and then told of what changed.

    The first fill lacks the events without a confirmation and has those without
    a quorum under a wrong time; the second moves these to their days and adds
    the others, recomputing only the days that either time lies in.
    """
    now = stage(_typed_once(spark, sf, "confirmation_count"), "typed")
    weak = F.coalesce(F.col("confirmation_count") < 2, F.lit(True))
    was = F.when(F.col("confirmation_count") < 2, F.col("ts") + P5_SKEW_NS).otherwise(F.col("ts"))
    before = now.where("confirmation_count is not null").withColumn("ts", was)
    store = _new_store(spark)
    store.refresh(before)
    moved = now.where(weak)
    store.refresh(now, moved.select("ts").unionByName(moved.where("confirmation_count is not null").select(was.alias("ts"))))
    return store.read(event_type_names(table(spark, sf, "event_types")), *P5_RANGE, edges=now)


KEYS = ["partition_key", "partition_id", "stream_id"]


def p6_keys(spark: SparkSession, sf: str) -> DataFrame:
    once = events_once(table(spark, sf, "event_log"), *KEYS, "timestamp_ns")
    return heavy.per_key(once, KEYS, "timestamp_ns").select("key_field", "key_value", "n", F.col("first").alias("first_ns"), F.col("last").alias("last_ns"))


def p6_found(spark: SparkSession, sf: str, share: float = 0.03) -> DataFrame:
    counts = stage(p6_keys(spark, sf), "keys")
    total = counts.where("key_field = 'partition_id'").agg(F.sum("n").alias("total"))
    return counts.where(F.col("n") >= share * total.scalar()).select("key_field", "key_value")


def _delivered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "deliveries").select("delivery_id", "subscription_id", uuid_key("event_id").alias("uid"), "cursor_no")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.surplus_copies(_delivered(spark, sf), ["subscription_id", "uid"], ["cursor_no", "delivery_id"], "delivery_id")


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.first_copies(_delivered(spark, sf), ["subscription_id", "uid"], ["cursor_no", "delivery_id"])


def p7_batches(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept if deliveries come in four batches by cursor, each checked against the identifiers stored before it."""
    d = _delivered(spark, sf)
    top = d.agg(F.coalesce(F.max("cursor_no"), F.lit(0))).first()[0]
    return dedupe.in_batches(d, "cursor_no", [top // 8, top // 4, top // 2], ["subscription_id", "uid"], ["cursor_no", "delivery_id"])


QUERIES = {
    "p2_found": p2_found, "p2_rounds": p2_rounds, "p4_found": p4_found, "p4_changelog": p4_changelog, "p4_hourly": p4_hourly, "p4_daily": p4_daily, "p5_features": p5_features, "p5_store": p5_store,
    "p6_found": p6_found, "p6_keys": p6_keys, "p7_found": p7_found, "p7_kept": p7_kept, "p7_batches": p7_batches,
}

_ONCE = "SELECT DISTINCT ON (partition_id, partition_sequence) * FROM event_log"
_LATE = f"""
WITH once AS ({_ONCE}),
h AS (SELECT partition_id, partition_sequence, timestamp_ns AS ts,
        max(timestamp_ns) OVER (PARTITION BY partition_id ORDER BY partition_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM once),
c AS (SELECT *, ts // 3600000000000 AS hour,
        CASE WHEN high IS NULL OR ts // 3600000000000 >= high // 3600000000000 THEN 'on_time' WHEN high - ts <= 21600000000000 THEN 'late' ELSE 'dropped' END AS arrived FROM h)
"""
_UID = r"""CASE WHEN regexp_full_match(trim(event_id), '[0-9A-Fa-f]{32}') THEN lower(trim(event_id))
  ELSE lower(replace(regexp_extract(trim(event_id), '[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}'), '-', '')) END"""
_RANKED = f"WITH u AS (SELECT delivery_id, subscription_id, cursor_no, {_UID} AS uid FROM deliveries), r AS (SELECT *, row_number() OVER (PARTITION BY subscription_id, uid ORDER BY cursor_no, delivery_id) AS rk FROM u)"

#: The names of the feature columns are data: they are read from this table, which is the same at every scale.
TYPES_TABLE = "/root/testdata/sf0.001/event_types.parquet"


def _features_sql(where: str = "true", types: str = TYPES_TABLE) -> str | None:
    """One row per stream with the columns of every type written out; None where the table is missing."""
    try:
        names = sorted(set(pq.read_table(types, columns=["event_type"]).column(0).to_pylist()) - {None})
    except OSError:
        return None
    text = "decode(payload)"
    cells = [f"""coalesce(max(n) FILTER (event_type = '{t}'), 0) AS "{t}_n", max(last_ns) FILTER (event_type = '{t}') AS "{t}_last_ns", coalesce(max(amount) FILTER (event_type = '{t}'), 0) AS "{t}_amount\"""" for t in names]
    return rf"""
WITH once AS ({_ONCE}),
e AS (SELECT o.partition_id, o.stream_id, t.event_type, o.timestamp_ns AS ts,
  CASE WHEN json_valid(TRY({text})) THEN TRY_CAST(json_extract_string(TRY({text}), '$.amount') AS DECIMAL(28,6)) END AS amount
  FROM once o LEFT JOIN event_types t ON regexp_replace(regexp_replace(lower(o.event_name), '[^\p{{L}}\p{{Nd}}]', '', 'g'), '\p{{Nd}}+$', '') = t.event_type WHERE {where}),
g AS (SELECT partition_id, stream_id, event_type, count(*) AS n, max(ts) AS last_ns, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount FROM e GROUP BY ALL)
SELECT partition_id, stream_id, {", ".join(cells)} FROM g GROUP BY partition_id, stream_id"""


ORACLES = {
    "p2_found": """
WITH a AS (SELECT subscription_id, max(cursor_no) AS acked FROM acks WHERE outcome = 'ok' GROUP BY subscription_id),
d AS (SELECT d.*, d.cursor_no > coalesce(a.acked, -1) AS fresh FROM deliveries d LEFT JOIN a USING (subscription_id)),
l AS (SELECT subscription_id, partition_id, partition_sequence,
        arg_max(confirmation_count, (cursor_no, delivery_id)) FILTER (fresh) AS new_count, count(*) FILTER (fresh) AS n_new,
        arg_max(confirmation_count, (cursor_no, delivery_id)) FILTER (NOT fresh) AS old_count, count(*) FILTER (NOT fresh) AS n_old
      FROM d GROUP BY ALL)
SELECT subscription_id, partition_id, partition_sequence FROM l WHERE n_new > 0 AND (n_old = 0 OR new_count IS DISTINCT FROM old_count)""",
    "p4_found": _LATE + "SELECT partition_id, partition_sequence FROM c WHERE arrived = 'late'",
    "p4_changelog": _LATE + """,
b AS (SELECT partition_id, hour, count(*) AS base FROM c WHERE arrived = 'on_time' GROUP BY ALL),
l AS (SELECT partition_id, hour, partition_sequence, row_number() OVER (PARTITION BY partition_id, hour ORDER BY partition_sequence) AS version FROM c WHERE arrived = 'late'),
v AS (SELECT l.*, coalesce(base, 0) + version - 1 AS old_count FROM l LEFT JOIN b USING (partition_id, hour))
SELECT partition_id, hour, version, partition_sequence, CAST(-1 AS INT) AS sign, old_count AS n FROM v WHERE old_count > 0
UNION ALL SELECT partition_id, hour, version, partition_sequence, CAST(1 AS INT), old_count + 1 FROM v""",
    "p4_hourly": _LATE + """
SELECT partition_id, hour, count(*) FILTER (arrived = 'on_time') AS published_count, count(*) FILTER (arrived = 'late') AS corrections,
  count(*) FILTER (arrived <> 'dropped') AS n, count(*) FILTER (arrived = 'dropped') AS dropped FROM c GROUP BY ALL""",
    "p4_daily": _LATE + """
SELECT hour // 24 AS day, count(*) FILTER (arrived <> 'dropped') AS n, count(*) FILTER (arrived = 'late') AS corrections FROM c WHERE ts IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (arrived <> 'dropped') > 0""",
    "p6_keys": f"""
WITH once AS ({_ONCE}),
k AS (SELECT 'partition_key' AS key_field, partition_key AS key_value, timestamp_ns AS ts FROM once
  UNION ALL SELECT 'partition_id', CAST(partition_id AS VARCHAR), timestamp_ns FROM once UNION ALL SELECT 'stream_id', stream_id, timestamp_ns FROM once)
SELECT key_field, key_value, count(*) AS n, min(ts) AS first_ns, max(ts) AS last_ns FROM k WHERE key_value IS NOT NULL GROUP BY ALL""",
    "p6_found": f"""
WITH once AS ({_ONCE}),
k AS (SELECT 'partition_key' AS key_field, partition_key AS key_value FROM once
  UNION ALL SELECT 'partition_id', CAST(partition_id AS VARCHAR) FROM once UNION ALL SELECT 'stream_id', stream_id FROM once)
SELECT key_field, key_value FROM k GROUP BY ALL HAVING count(*) >= 0.03 * (SELECT count(*) FROM once)""",
    "p7_found": _RANKED + "SELECT delivery_id FROM r WHERE rk > 1",
    "p7_kept": _RANKED + "SELECT delivery_id, subscription_id, uid, cursor_no FROM r WHERE rk = 1",
}
ORACLES["p7_batches"] = ORACLES["p7_kept"]
ORACLES["p2_rounds"] = ORACLES["p2_found"]
ORACLES |= {k: q for k, q in {"p5_features": _features_sql(), "p5_store": _features_sql(f"timestamp_ns >= {P5_RANGE[0]} AND timestamp_ns < {P5_RANGE[1]}")}.items() if q}
