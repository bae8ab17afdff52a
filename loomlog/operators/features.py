"""One feature row per entity: count, recency and total for each event type.

Events are reduced to partial aggregates per (entity, type, time bucket). Those
are the persistent state: a change recomputes its bucket only, and features are
a merge of the wanted buckets with the events at the edges of the time range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.publish import Published
from loomlog.scratch import free_name, sized

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS
AMOUNT = "decimal(38,6)"
#: The bucket of events without a time.
UNTIMED = -(1 << 62)
MANIFEST = "bucket bigint, run string"
#: Rows of a bucket that one task writes.
FILE_ROWS = 4_000_000


def bucket_of(ts: str, bucket_ns: int):
    """The bucket that a time lies in, also before 1970."""
    return F.coalesce(F.expr(f"(`{ts}` - pmod(`{ts}`, {bucket_ns}L)) div {bucket_ns}L"), F.lit(UNTIMED)).cast("bigint")


def partials(events: DataFrame, entity: list[str], bucket_ns: int = DAY_NS) -> DataFrame:
    """(entity..., event_type, bucket, n, last_ns, amount) of events (entity..., event_type, ts, amount).

    An event without a time falls into the bucket ``UNTIMED`` and counts,
    without recency; a null amount adds nothing; events of no type keep a row
    of their entity with a null type; a null in the entity is no entity.
    """
    known = F.lit(True)
    for c in entity:
        known = known & F.col(c).isNotNull()
    return events.where(known).groupBy(*entity, "event_type", bucket_of("ts", bucket_ns).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ns"), F.coalesce(F.sum("amount"), F.lit(0)).cast(AMOUNT).alias("amount")
    )


def merge(parts: DataFrame, entity: list[str]) -> DataFrame:
    """Sum the buckets of each (entity, type)."""
    return parts.groupBy(*entity, "event_type").agg(F.sum("n").alias("n"), F.max("last_ns").alias("last_ns"), F.sum("amount").cast(AMOUNT).alias("amount"))


def wide(merged: DataFrame, entity: list[str], types: list[str]) -> DataFrame:
    """One row per entity with ``<type>_n``, ``<type>_last_ns`` and ``<type>_amount`` for every type.

    A type that the entity never had: 0, null and 0.0. The rows of an entity
    come together as one map from type to its aggregates, at most one entry a
    type, so no entity is large; the columns are look-ups in that map.
    """
    of = free_name(merged.select(*entity), "_of")
    entry = F.when(F.col("event_type").isNotNull(), F.struct("event_type", F.struct("n", "last_ns", F.col("amount").cast("double").alias("amount"))))
    by = merged.groupBy(*entity).agg(F.map_from_entries(F.collect_list(entry)).alias(of))
    cols = []
    for t in types:  # as text: hundreds of columns are parsed faster than they are built call by call
        own, name = f"try_element_at(`{of}`, {_quoted(t)})", t.replace("`", "``")
        cols += [f"coalesce({own}.n, 0L) AS `{name}_n`", f"{own}.last_ns AS `{name}_last_ns`", f"coalesce({own}.amount, 0D) AS `{name}_amount`"]
    return by.selectExpr(*[f"`{c}`" for c in entity], *cols)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def features(events: DataFrame, entity: list[str], types: list[str], start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Feature rows over [start_ns, end_ns), computed at once; entities without events there have none."""
    if start_ns is not None:
        events = events.where(F.col("ts") >= start_ns)
    if end_ns is not None:
        events = events.where(F.col("ts") < end_ns)
    return wide(merge(partials(events, entity), entity), entity, types)


class FeatureStore:
    """Partials on disk by time bucket, replaced bucket by bucket.

    Every refresh writes the buckets it recomputed to a folder of its own and a
    manifest (bucket, run) that says which run holds each bucket now; a bucket
    that lost all its events is no longer in it. One marker publishes both, so
    readers see a refresh as a whole or not at all. The manifest has one row a
    bucket: as many as there are periods, however many events there are.
    """

    def __init__(self, spark: SparkSession, path: str, entity: list[str], bucket_ns: int = DAY_NS):
        self.spark, self.path, self.entity, self.bucket_ns = spark, path.rstrip("/"), entity, bucket_ns
        self.published = Published(spark, self.path)

    def manifest(self) -> DataFrame | None:
        last = self.published.last()
        return self.spark.read.schema(MANIFEST).parquet(f"{last}/manifest") if last else None

    def refresh(self, events: DataFrame, changed: DataFrame | None = None) -> int:
        """Recompute the buckets of ``changed`` from ``events``; all buckets if None. Returns the number of the refresh.

        ``changed`` has the ``ts`` of every event that came, went or changed; of
        an event that moved, its old and its new time. The reach of the changed
        times goes to the scan of ``events`` as a filter, the exact buckets are
        a semi join behind it.
        """
        number, now = self.published.next_number(), self.manifest()
        folder = self.published.new_folder(number)
        run = folder.rpartition("/")[2]
        buckets = None
        if changed is not None and now is not None:
            at = free_name(events, "_bucket")
            buckets = sized(changed.select(bucket_of("ts", self.bucket_ns).alias(at)).distinct(), name="changed")
            low, high, untimed = buckets.agg(F.min(F.when(F.col(at) != UNTIMED, F.col(at))), F.max(at), F.max((F.col(at) == UNTIMED).cast("int"))).first()
            reach = F.col("ts").isNull() if untimed else F.lit(False)
            if low is not None:
                reach = reach | ((F.col("ts") >= low * self.bucket_ns) & (F.col("ts") < (high + 1) * self.bucket_ns))
            events = events.where(reach).withColumn(at, bucket_of("ts", self.bucket_ns)).join(buckets, at, "left_semi").drop(at)
        data = f"{self.path}/data/run={run}"
        parts = partials(events, self.entity, self.bucket_ns)
        # rows of a bucket go to a bounded number of tasks, so that many files come of it and no more
        spread = F.pmod(F.xxhash64(*self.entity), F.lit(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
        laid = parts.withColumn("_part", spread).repartition("bucket", "_part").drop("_part")
        laid.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(data)
        held = self.spark.read.schema(self._schema(parts)).parquet(data).select("bucket").distinct().select("bucket", F.lit(run).alias("run"))
        if buckets is not None:
            held = now.join(buckets, now["bucket"] == buckets[buckets.columns[0]], "left_anti").unionByName(held)
        held.coalesce(1).write.parquet(f"{folder}/manifest")
        self.published.publish(number, folder)
        return number

    def _schema(self, parts: DataFrame) -> str:
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "bucket")
        return f"{own}, bucket bigint"

    def parts(self, like: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
        """The partials of the buckets from ``start`` to before ``end``; only their directories are read."""
        now = self.manifest()
        if now is None:
            return like.limit(0)
        if start is not None:
            now = now.where(F.col("bucket") >= start)
        if end is not None:
            now = now.where(F.col("bucket") < end)
        held = self.spark.read.schema(f"{self._schema(like)}, run string").parquet(f"{self.path}/data")
        return held.join(sized(now, name="manifest"), ["run", "bucket"]).select(*like.columns)

    def read(self, types: list[str], start_ns: int | None = None, end_ns: int | None = None, edges: DataFrame | None = None) -> DataFrame:
        """Features over [start_ns, end_ns): whole buckets from the store, the events of cut ones from ``edges``.

        Events without a time are in no range; without a range they count.
        """
        b = self.bucket_ns
        like = partials(edges, self.entity, b) if edges is not None else self._empty()
        first = None if start_ns is None else -(-start_ns // b)
        last = None if end_ns is None else end_ns // b
        if first is None and last is not None:
            first = UNTIMED + 1
        found = self.parts(like, first, last)
        if edges is not None and (start_ns is not None or end_ns is not None):
            cut, inside = F.lit(False), F.lit(True)
            if start_ns is not None:
                inside = inside & (F.col("ts") >= start_ns)
                cut = cut | ((F.col("ts") >= start_ns) & (F.col("ts") < first * b))
            if end_ns is not None:
                inside = inside & (F.col("ts") < end_ns)
                cut = cut | ((F.col("ts") >= last * b) & (F.col("ts") < end_ns))
            found = found.unionByName(partials(edges.where(inside & cut), self.entity, b))
        return wide(merge(found, self.entity), self.entity, types)

    def _empty(self) -> DataFrame:
        """No partials, with the columns that the store has."""
        runs = self.published.runs()
        if not runs:
            raise ValueError("the store is empty: nothing was refreshed")
        held = self.spark.read.parquet(f"{self.path}/data")
        return held.select(*[c for c in held.columns if c not in ("run", "bucket")], F.col("bucket").cast("bigint").alias("bucket")).limit(0)
