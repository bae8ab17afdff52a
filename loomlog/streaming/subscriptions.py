"""Subscriptions: history first, then live, each record once and in order per partition.

As a batch, a subscription's records are a filter with a cursor. As a stream, a
data source keeps one offset per partition or stream and admits at most
``window`` records past the last acknowledged cursor; acks are a table of their
own. What has been admitted is written down beside the acks before Spark is
told, so a restarted query goes on from there and never back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomlog.operators.blocks import block_of, block_rank
from loomlog.plans.commands import Subscribe, hash_of
from loomlog.scratch import sized


def records(log: DataFrame, r: Subscribe, window: bool = True, acked: int | None = None) -> DataFrame:
    """(cursor, event fields...) of a subscription's history, ordered by partition and position.

    A key without a start is live only and has no history. With ``window``, only
    cursors that may be sent before the next ack are returned.
    """
    position = "stream_version" if r.kind == "stream" else "partition_sequence"
    df = log
    key = F.col("stream_id") if r.kind == "stream" else F.col("partition_id")
    if r.keys is not None:
        if r.kind == "stream":
            own = F.lit(False)
            for k, s in r.keys:
                own = own | ((F.col("stream_id") == s) & (F.col("partition_key") == k))
            df = df.where(own)
        else:
            df = df.where(F.col("partition_id").isin(list(r.keys)))
    if isinstance(r.start, dict):
        start = F.lit(r.fallback).cast("bigint")
        for k, n in r.start.items():
            start = F.when(key == k, F.lit(n)).otherwise(start)
    else:
        start = F.lit(r.start).cast("bigint")
    df = df.where(start.isNotNull() & (F.col(position) >= start))
    if not window:
        return with_cursor(df)
    return first_cursors(df, (-1 if acked is None else acked) + 1 + r.window)


def with_cursor(df: DataFrame) -> DataFrame:
    """Number records from 0 in (partition, sequence) order, in blocks: no task orders everything."""
    blocks = df.withColumn("_block", F.col("partition_id").cast("bigint") * (1 << 46) + block_of("partition_sequence")).withColumn("_all", F.lit(0))
    return block_rank(blocks, ["_all"], "_block", [F.col("partition_sequence")], "cursor").drop("_block", "_all")


def first_cursors(df: DataFrame, end: int) -> DataFrame:
    """The records with cursors from 0 to before ``end``, numbered as ``with_cursor`` does.

    Counts say in which blocks these are: per partition first, then per block
    of the one partition that the window ends in. Only these blocks are ranked.
    """
    per = df.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("partition_id").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    per = per.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < end)
    per = sized(per.select(F.col("partition_id").alias("_p"), "before"), 1 << 16, "partitions")
    near = df.join(per, F.col("partition_id") == F.col("_p")).withColumn("_block", block_of("partition_sequence")).drop("_p")
    w = Window.partitionBy("partition_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = near.groupBy("partition_id", "_block").agg(F.count(F.lit(1)).alias("n"), F.max("before").alias("base"))
    blocks = blocks.withColumn("base", F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("base") < end)
    blocks = sized(blocks.select(F.col("partition_id").alias("_p"), F.col("_block").alias("_b"), "base"), name="blocks")
    own = near.drop("before").join(blocks, (F.col("partition_id") == F.col("_p")) & (F.col("_block") == F.col("_b"))).drop("_p", "_b")
    rank = F.row_number().over(Window.partitionBy("partition_id", "_block").orderBy("partition_sequence")) - 1
    return own.withColumn("cursor", (F.col("base") + rank).cast("bigint")).drop("base", "_block").where(F.col("cursor") < end)


def start_offsets(marks: DataFrame, keys: list[int] | None, start: None | int | dict, fallback: int | None) -> dict[int, int]:
    """The first sequence of each partition: its mapped start, the fallback, or the watermark (live only)."""
    out = {}
    for p, w in marks.select("partition_id", "confirmed_watermark").collect():  # one row a partition
        if keys is None or p in keys:
            if isinstance(start, dict):
                out[p] = start.get(p, fallback if fallback is not None else w)
            else:
                out[p] = w if start is None else start
    return out


def options_of(r: Subscribe, subscription_id: str, path: str, state: str, partitions: int = 32) -> dict[str, str]:
    """The options of the stream source for a parsed subscription."""
    if r.kind == "stream":
        keys = [[hash_of(k) % partitions, k, s] for k, s in r.keys]
        start = {s: n for s, n in r.start.items()} if isinstance(r.start, dict) else r.start
    else:
        keys, start = r.keys, {str(p): n for p, n in r.start.items()} if isinstance(r.start, dict) else r.start
    matcher = {"kind": r.kind, "keys": keys, "start": start, "fallback": r.fallback}
    return {"path": path, "state": state, "subscription_id": subscription_id, "window": str(r.window), "matcher": json.dumps(matcher)}


class _Range(InputPartition):
    """Positions from ``first`` to before ``end`` of one key; the first has the given cursor."""

    def __init__(self, key: str, first: int, end: int, cursor: int):
        self.key, self.first, self.end, self.cursor = key, first, end, cursor


#: Records that one task reads of a key at once.
RANGE = 1 << 18
COLUMNS = ["partition_id", "partition_sequence", "event_id", "stream_id", "stream_version", "event_name"]
RECORD = "subscription_id string, cursor bigint, partition_id int, partition_sequence bigint, event_id string, stream_id string, stream_version bigint, event_name string"


class SubscriptionReader(DataSourceStreamReader):
    """Offsets: ``next`` position per key and the ``cursor`` of the next record.

    A key is a partition, or a stream as "partition/stream". Positions are
    gapless in both, so how many records lie between two offsets is known
    without reading them.
    """

    def __init__(self, options: dict):
        self.path, self.window = options["path"], int(options.get("window", "1000"))
        self.subscription_id = options.get("subscription_id", "")
        self.table = AckTable(options["state"])
        matcher = json.loads(options["matcher"])
        self.kind, self.keys, self.start, self.fallback = matcher["kind"], matcher["keys"], matcher.get("start"), matcher.get("fallback")
        self.position = "stream_version" if self.kind == "stream" else "partition_sequence"
        self.streams = {f"{p}/{s}": (p, k, s) for p, k, s in self.keys} if self.kind == "stream" else {}
        self.tops: dict[str, int] = {}
        self.seen: set[str] = set()

    def _start_of(self, key: str, opening: bool) -> int:
        """Where a key begins: its number, the fallback, or live only; a key that appears later was empty at the start."""
        name = self.streams[key][2] if self.streams else key
        if isinstance(self.start, dict):
            at = self.start.get(name, self.fallback)
        else:
            at = self.start
        return at if at is not None else self.tops.get(key, -1) + 1 if opening else 0

    def initialOffset(self) -> dict:
        """Where the subscription was opened. It is written down, so live only means since then, not since a restart."""
        opened = self.table.load(self.subscription_id, "opened")
        if opened is None:
            self._look()
            known = list(self.streams) if self.streams else [str(k) for k in self.keys] if self.keys is not None else sorted(self.tops, key=int)
            opened = {"next": {k: self._start_of(k, True) for k in known}, "cursor": 0}
            self.table.save(self.subscription_id, "opened", opened)
        return opened

    def latestOffset(self) -> dict:
        """As far as the window allows: at most ``window`` records past the last ack are ever admitted."""
        at = self.table.load(self.subscription_id, "admitted") or self.initialOffset()
        acked = self.table.get(self.subscription_id)
        room = (-1 if acked is None else acked) + 1 + self.window - at["cursor"]
        self._look()
        nxt, cursor = dict(at["next"]), at["cursor"]
        known = nxt if self.keys is not None else {**nxt, **{k: 0 for k in self.tops}}
        for k in sorted(known, key=_order):
            first = nxt.get(k)
            if first is None:
                first = self._start_of(k, False)
            n = max(0, min(self.tops.get(k, -1) + 1 - first, room))
            nxt[k] = first + n
            room -= n
            cursor += n
        end = {"next": nxt, "cursor": cursor}
        if end != at:
            self.table.save(self.subscription_id, "admitted", end)  # before Spark knows: never behind what it was told
        return end

    def _look(self) -> None:
        """Highest position per key, from the footers of files not seen before.

        Files are immutable. Rows are only read of a row group that holds
        several keys, and then of the columns that tell them apart.
        """
        filesystem, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        for fragment in ds.dataset(root, format="parquet", partitioning="hive", filesystem=filesystem).get_fragments():
            if fragment.path in self.seen:
                continue
            where = ds.get_partition_keys(fragment.partition_expression).get("partition_id")
            for group in fragment.split_by_row_group():
                self._look_into(group, where)
            self.seen.add(fragment.path)

    def _look_into(self, group: ds.Fragment, where: int | None) -> None:
        stats = group.row_groups[0].statistics or {}
        position, ids = stats.get(self.position), stats.get("partition_id")
        one = where if where is not None else ids["min"] if ids and ids["min"] == ids["max"] else None
        if self.streams:
            names = [s for p, _, s in self.streams.values() if one is None or p == one]
            if not names:
                return
            columns = ["stream_id", "stream_version", "partition_key"] + ["partition_id"] * (where is None)
            t = group.to_table(columns=columns, filter=ds.field("stream_id").isin(names))
            if where is not None:
                t = t.append_column("partition_id", pa.array([where] * len(t), pa.int64()))
            for r in t.group_by(["partition_id", "partition_key", "stream_id"]).aggregate([("stream_version", "max")]).to_pylist():
                key = f"{r['partition_id']}/{r['stream_id']}"
                if key in self.streams and self.streams[key][1] == r["partition_key"] and r["stream_version_max"] is not None:
                    self.tops[key] = max(self.tops.get(key, -1), r["stream_version_max"])
            return
        if position and one is not None:
            self.tops[str(one)] = max(self.tops.get(str(one), -1), position["max"])
            return
        t = group.to_table(columns=[self.position] + ["partition_id"] * (where is None))
        if where is not None:
            t = t.append_column("partition_id", pa.array([where] * len(t), pa.int64()))
        for r in t.group_by("partition_id").aggregate([(self.position, "max")]).to_pylist():
            if r["partition_id"] is not None and r[f"{self.position}_max"] is not None:
                self.tops[str(r["partition_id"])] = max(self.tops.get(str(r["partition_id"]), -1), r[f"{self.position}_max"])

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges in order of cursors; a long range of one key is read by several tasks."""
        out, cursor = [], start["cursor"]
        for k in sorted(end["next"], key=_order):
            first = start["next"].get(k)
            at = self._start_of(k, False) if first is None else first
            while at < end["next"][k]:
                upto = min(end["next"][k], at + RANGE)
                out.append(_Range(k, at, upto, cursor))
                cursor += upto - at
                at = upto
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        p = self.streams[part.key][0] if self.streams else int(part.key)
        where = (ds.field("partition_id") == p) & (ds.field(self.position) >= part.first) & (ds.field(self.position) < part.end)
        if self.streams:
            where = where & (ds.field("stream_id") == self.streams[part.key][2]) & (ds.field("partition_key") == self.streams[part.key][1])
        filesystem, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        t = ds.dataset(root, format="parquet", partitioning="hive", filesystem=filesystem).to_table(columns=COLUMNS, filter=where).sort_by(self.position)
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        cursor = pc.add(pc.subtract(t[self.position], part.first), part.cursor)
        columns = [pa.array([self.subscription_id] * len(t), pa.string()), cursor.cast(pa.int64()), *[c.cast(k) for c, k in zip(t.columns, kinds)]]
        yield from pa.table(columns, names=["subscription_id", "cursor", *COLUMNS]).to_batches()

    def commit(self, end: dict) -> None:
        pass


def _order(key: str) -> tuple:
    p, _, s = key.partition("/")
    return int(p), s


class SubscriptionSource(DataSource):
    """``spark.readStream.format("loomlog_subscription")`` over a folder of log files.

    The folder holds confirmed events, each once, gapless per partition; files
    are only added. Options (see ``options_of``): path; state, a folder for acks
    and offsets, of this subscription and this query only; subscription_id;
    window; matcher.
    """

    @classmethod
    def name(cls) -> str:
        return "loomlog_subscription"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SubscriptionReader(self.options)


class AckTable:
    """Acknowledged cursors and offsets of subscriptions, in any file system; an ack never moves back."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.rstrip("/"))

    def _path(self, subscription_id: str, what: str) -> str:
        return f"{self.folder}/{subscription_id or 'subscription'}.{what}.json"

    def save(self, subscription_id: str, what: str, value: object) -> None:
        """Replace a value: written under another name, then renamed."""
        self.fs.create_dir(self.folder, recursive=True)
        path = self._path(subscription_id, what)
        with self.fs.open_output_stream(path + ".new") as f:
            f.write(json.dumps(value).encode())
        self.fs.move(path + ".new", path)

    def load(self, subscription_id: str, what: str) -> object | None:
        path = self._path(subscription_id, what)
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def ack(self, subscription_id: str, cursor: int) -> int:
        now = self.get(subscription_id)
        if now is None or cursor > now:
            self.save(subscription_id, "acked", cursor)
            return cursor
        return now

    def get(self, subscription_id: str) -> int | None:
        return self.load(subscription_id, "acked")
