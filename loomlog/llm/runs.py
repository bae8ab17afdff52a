"""Runs of identical or near-identical consecutive events, each collapsed into one.

A segmentation costs, for every run, the dissimilarity of its events to the
label that represents it, and a penalty for every boundary. The cheapest one is
found by dynamic programming over the labels that can still win: a label that
is behind by the penalty or more can be opened again later at no loss, so it is
pruned.

If the penalty is under half the least dissimilarity, every event is
represented by its own label in every optimum, so a sequence may be cut
anywhere, solved in blocks and stitched at the cuts. Other penalties keep a
sequence in one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.blocks import block_of

BLOCK = 1 << 14


def segment(labels: list, penalty: float, near: Callable[[object], dict] | None = None, far: float = 1.0) -> list[tuple]:
    """The cheapest segmentation: (label, first index, last index) per run.

    ``near(x)`` gives the labels less than ``far`` away from ``x`` with their
    distance; all others are at ``far``, and ``x`` itself at 0. Ties go to the
    fewest boundaries, then to the label that was open longest.
    """
    live: dict = {}  # label -> (cost, start of its run, the closed runs before it)
    for i, x in enumerate(labels):
        close = near(x) if near else {}
        if len(live) == 1 and x in live:
            continue  # nothing else can win: its cost stays, as x costs itself nothing
        if live:
            lead = min(live, key=lambda c: (live[c][0], live[c][1]))
            cost, start, before = live[lead]
            best = cost
            opened = (best + penalty, i, (before, lead, start, i - 1))
        else:
            opened = (0.0, i, None)
            if far < penalty:  # the first run may be represented by a label that only comes later
                close = {c: far for c in set(labels)} | close | {x: 0.0}
        nxt = {}
        for c, (cost, start, before) in live.items():
            nxt[c] = (cost + (0.0 if c == x else close.get(c, far)), start, before)
        for c, d in ((x, 0.0), *close.items()):
            new = (opened[0] + d, opened[1], opened[2])
            if c not in nxt or new[0] < nxt[c][0]:
                nxt[c] = new
        limit = min(v[0] for v in nxt.values()) + penalty
        live = {c: v for c, v in nxt.items() if v[0] < limit or penalty == 0 and v[0] <= limit}
    if not live:
        return []
    lead = min(live, key=lambda c: (live[c][0], live[c][1]))
    out = [(lead, live[lead][1], len(labels) - 1)]
    link = live[lead][2]
    while link is not None:
        link, c, a, b = link
        out.append((c, a, b))
    out.reverse()
    return out


def collapse(events: DataFrame, entity: list[str], penalty: float = 0.25, near: dict | None = None, far: float = 1.0, block: int = BLOCK) -> DataFrame:
    """One row per run: entity..., label, first_version, last_version, n, first_ts, last_ts, duration.

    ``events``: entity..., version, seq, ts, label. Runs end where versions are
    not consecutive and at events without a label, which are in no run. Rows of
    the same (entity, version, seq) are one event; a null version or entity has
    no place in a sequence; null timestamps count but have no part in times.
    ``near`` maps pairs of labels to their dissimilarity where it is under ``far``.
    """
    least = min([far, *(near or {}).values()])
    split = penalty < least / 2
    known = F.col("version").isNotNull()
    for c in entity:
        known = known & F.col(c).isNotNull()
    keys = [*entity, "block"]
    where = block_of("version", block) if split else F.lit(0).cast("bigint")
    e = events.where(known).select(*entity, where.alias("block"), "version", "seq", "ts", "label")
    once = e.repartition(*keys).dropDuplicates([*keys, "version", "seq"]).sortWithinPartitions(*keys, "version", "seq")
    size = 1 << (block - 1).bit_length()
    width = len(keys)
    table: dict = {}
    for (a, b), d in (near or {}).items():
        table.setdefault(a, {})[b] = d
        table.setdefault(b, {})[a] = d
    lookup = (lambda x: table.get(x, {})) if table else None
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.select(*entity).schema)
    schema = f"{key_types}, label string, first_version bigint, last_version bigint, n bigint, first_ts bigint, last_ts bigint, open boolean"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, labels, versions, times = None, [], [], []
        types = None

        def close() -> None:
            for c, a, b in segment(labels, penalty, lookup, far):
                own = [t for t in times[a : b + 1] if t is not None]
                at_edge = split and (versions[a] % size == 0 and versions[a] > 0 or (versions[b] + 1) % size == 0)
                done.append((*key[:-1], c, versions[a], versions[b], b - a + 1, min(own, default=None), max(own, default=None), at_edge))
            labels.clear(), versions.clear(), times.clear()

        def flush() -> pa.RecordBatch:
            kinds = [*types, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=[*entity, "label", "first_version", "last_version", "n", "first_ts", "last_ts", "open"])
            done.clear()
            return b

        for batch in batches:
            types = types or [batch.schema.field(i).type for i in range(width - 1)]
            for *own, version, ts, label in zip(*[batch.column(i).to_pylist() for i in range(width + 3)]):
                if own != key or label is None or versions and version - versions[-1] > 1:
                    if labels:
                        close()
                        if len(done) > 8192:
                            yield flush()
                    key = own
                if label is not None:
                    labels.append(label), versions.append(version), times.append(ts)
        if labels:
            close()
        if done:
            yield flush()

    found = once.select(*keys, "version", "ts", "label").mapInArrow(runs, schema)
    measure = (F.col("last_ts") - F.col("first_ts")).alias("duration")
    names = [*entity, "label", "first_version", "last_version", "n", "first_ts", "last_ts"]
    if not split:
        return found.select(*names, measure)
    # only runs that touch a cut meet again: at most two a block
    w = Window.partitionBy(*entity).orderBy("first_version", "last_version")
    new = ~(F.col("label").eqNullSafe(F.lag("label").over(w)) & (F.col("first_version") - F.lag("last_version").over(w) <= 1) & (F.col("first_version") % size == 0))
    joined = found.where("open").withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*entity, "run", "label").agg(
        F.min("first_version").alias("first_version"), F.max("last_version").alias("last_version"), F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    return found.where("not open").select(*names).unionByName(joined.select(*names)).select(*names, measure)
