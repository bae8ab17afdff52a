"""Process only what is new or changed since the last successful run.

What a consumer has processed is kept as disjoint intervals of sequence
numbers, each with the version its records had. A run subtracts the intervals
from what is available: the remaining gaps, late commits included, are its
work. Output and merged intervals are published together by one marker.

Intervals never cross a border between blocks of sequence numbers, so all that
is ordered is ordered within a (consumer, part, block): however many records a
part has and however often versions change in it, no task meets more than the
borders that fit into a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.operators.blocks import BLOCK, block_of
from loomlog.publish import Published
from loomlog.scratch import sized

INTERVALS = "consumer string, part int, lo bigint, hi bigint, version int"


def to_intervals(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Disjoint maximal intervals (consumer, part, lo, hi, version) of points.

    ``points`` has (consumer, part, seq, version); repeated points count once
    if their version agrees. Intervals end at multiples of ``block``, which
    bounds every group; nulls in consumer, part or seq are left out.
    """
    p = points.where("consumer is not null and part is not null and seq is not null").select("consumer", "part", "seq", "version", block_of("seq", block).alias("block")).distinct()
    w = Window.partitionBy("consumer", "part", "block").orderBy("seq")
    new = (F.lag("seq").over(w).isNull()) | (F.col("seq") - F.lag("seq").over(w) > 1) | ~F.col("version").eqNullSafe(F.lag("version").over(w))
    island = p.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("consumer", "part", "block", "island", "version").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).select("consumer", "part", "lo", "hi", "version")


def merge_intervals(intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Join touching or overlapping intervals of one version within each block; they must lie in one each."""
    w = Window.partitionBy("consumer", "part", "block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("lo") > reach + 1) | ~F.col("version").eqNullSafe(F.lag("version").over(w))
    g = intervals.withColumn("block", block_of("lo", block)).withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("consumer", "part", "block", "island", "version").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("consumer", "part", "lo", "hi", "version")


def subtract(available: DataFrame, processed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Available points that no processed interval of the same version covers.

    Points and interval starts are sorted together inside (consumer, part,
    block) and each point looks back at the last start: one pass, no range
    join, no pairs. An interval is cut at block borders first. Repeated points
    come back once. Nulls in consumer, part or seq are left out.
    """
    size = 1 << (block - 1).bit_length()
    pieces = processed.withColumn("block", F.explode(F.sequence(block_of("lo", block), block_of("hi", block)))).select(
        "consumer", "part", "block", F.greatest("lo", F.col("block") * size).alias("seq"), F.lit(0).alias("kind"),
        F.struct(F.least("hi", F.col("block") * size + size - 1).alias("hi"), F.col("version").alias("version")).alias("span"), F.lit(None).cast("int").alias("version"),
    )
    points = available.where("consumer is not null and part is not null and seq is not null").select(
        "consumer", "part", block_of("seq", block).alias("block"), "seq", F.lit(1).alias("kind"),
        F.lit(None).cast("struct<hi:bigint,version:int>").alias("span"), F.col("version").cast("int").alias("version"),
    ).distinct()
    w = Window.partitionBy("consumer", "part", "block").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = pieces.unionByName(points).withColumn("span", F.last("span", True).over(w)).where("kind = 1")
    covered = F.coalesce((F.col("seq") <= F.col("span.hi")) & F.col("version").eqNullSafe(F.col("span.version")), F.lit(False))
    return seen.where(~covered).select("consumer", "part", "seq", "version")


def last_copies(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """(consumer, part, seq, done, old, found, new): the versions of each record's last copies at and above the last ack.

    ``deliveries``: (consumer, part, seq, cursor, tie, version); ``acks``:
    (consumer, cursor) of successful runs. ``old`` is the version of the last
    copy at or below the largest acked cursor (``done``: there is one), ``new``
    that of the last copy above it (``found``: there is one). A consumer without
    an ack starts at -1. Rows with a null consumer, part, seq or cursor are no
    deliveries.
    """
    acked = sized(acks.where("consumer is not null and cursor is not null").groupBy("consumer").agg(F.max("cursor").alias("acked")), name="acked")
    d = deliveries.where("consumer is not null and part is not null and seq is not null and cursor is not null").join(acked, "consumer", "left")
    copy = F.struct("cursor", "tie", "version")
    after = F.col("cursor") > F.coalesce("acked", F.lit(-1))
    last = d.groupBy("consumer", "part", "seq").agg(F.max(F.when(~after, copy)).alias("old"), F.max(F.when(after, copy)).alias("new"))
    return last.select("consumer", "part", "seq", F.col("old").isNotNull().alias("done"), F.col("old.version").alias("old"), F.col("new").isNotNull().alias("found"), F.col("new.version").alias("new"))


def processed(last: DataFrame) -> DataFrame:
    """The points (consumer, part, seq, version) that the last ack covers."""
    return last.where("done").select("consumer", "part", "seq", F.col("old").alias("version"))


def available(last: DataFrame) -> DataFrame:
    """The points (consumer, part, seq, version) that were delivered above the last ack."""
    return last.where("found").select("consumer", "part", "seq", F.col("new").alias("version"))


class RunLedger:
    """Batches of output with their interval ledger, published atomically.

    A run writes its output and the ledger that includes it to a folder of its
    own, then publishes that folder by one marker. Readers go by markers only,
    so a run that died anywhere before leaves nothing visible and its records
    stay pending; a number that is taken is refused, so of two runs over the
    same records one fails and publishes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.block = spark, block
        self.published = Published(spark, path)

    def runs(self) -> list[tuple[int, str]]:
        """(number, folder) of the published runs, in order."""
        return self.published.runs()

    def intervals(self) -> DataFrame:
        """The ledger after the last published run."""
        last = self.published.last()
        return self.spark.read.schema(INTERVALS).parquet(f"{last}/ledger") if last else self.spark.createDataFrame([], INTERVALS)

    def output(self, number: int | None = None) -> DataFrame | None:
        """All published output, or that of one run; None if there is none."""
        folders = [d for n, d in self.runs() if number is None or n == number]
        return self.spark.read.parquet(*[f"{d}/output" for d in folders]) if folders else None

    def run(self, available: DataFrame, process=lambda df: df) -> int:
        """Process what is pending in ``available`` (consumer, part, seq, version); returns the run's number.

        The pending records are written before they are processed, so output
        and ledger speak of the same records even if the source changes
        meanwhile. A record whose version changed replaces its old interval.
        """
        number, old = self.published.next_number(), self.intervals()
        folder = self.published.new_folder(number)
        first = self.published.last() is None  # nothing to subtract, cut or merge
        pending = subtract(available, old, self.block) if not first else _points(available)
        pending.write.parquet(f"{folder}/taken")
        taken = self.spark.read.schema("consumer string, part int, seq bigint, version int").parquet(f"{folder}/taken")
        process(taken).write.parquet(f"{folder}/output")
        fresh = to_intervals(taken, self.block)
        if not first:
            cut = _without(old, fresh.select("consumer", "part", "lo", "hi"), self.block)
            fresh = merge_intervals(cut.unionByName(fresh), self.block)
        fresh.write.parquet(f"{folder}/ledger")
        self.published.publish(number, folder)
        return number


def _points(available: DataFrame) -> DataFrame:
    return available.where("consumer is not null and part is not null and seq is not null").select("consumer", "part", "seq", F.col("version").cast("int").alias("version")).distinct()


def _without(intervals: DataFrame, holes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Intervals with the holes cut out, by one sorted sweep over the borders in each block; all lie in one each."""
    none = F.lit(None).cast("struct<version:int>")
    kinds = [(intervals, F.col("lo"), 1, 0, F.struct("version")), (intervals, F.col("hi") + 1, -1, 0, none), (holes, F.col("lo"), 0, 1, none), (holes, F.col("hi") + 1, 0, -1, none)]
    borders = None
    for df, at, a, h, v in kinds:
        own = df.select("consumer", "part", block_of("lo", block).alias("block"), at.alias("at"), F.lit(a).alias("a"), F.lit(h).alias("h"), v.alias("v"))
        borders = own if borders is None else borders.unionByName(own)
    at = borders.groupBy("consumer", "part", "block", "at").agg(F.sum("a").alias("a"), F.sum("h").alias("h"), F.first("v", True).alias("v"))
    w = Window.partitionBy("consumer", "part", "block").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = at.select("consumer", "part", F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"), F.sum("a").over(upto).alias("in_a"), F.sum("h").over(upto).alias("in_h"), F.last("v", True).over(upto).alias("v"))
    return swept.where("in_a > 0 and in_h = 0 and hi >= lo").select("consumer", "part", "lo", "hi", F.col("v.version").alias("version"))
