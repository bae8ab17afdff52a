"""Items of varying length in containers of fixed capacity.

The plan is made over the histogram of lengths, which the capacity bounds
however many documents there are: best fit, longest first, for all items of a
length at once. Each step of the plan says which ranks within a length go to
which containers; documents then take their slots by their rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.blocks import block_rank
from loomlog.scratch import stage

#: Largest capacity, in tokens, that is planned; it bounds the histogram and the plan.
MOST_CAPACITY = 1 << 20
#: Budgets of one call; every document is read once for all of them.
MOST_BUDGETS = 1000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: (length, first rank, items, first container, items per container, offset).

    ``items`` items of ``length`` from ``first rank`` on fill consecutive
    containers, ``items per container`` side by side from ``offset`` on.
    """
    room: dict[int, list[list[int]]] = {}  # room left -> ranges of containers [first, count]
    sizes: list[int] = []  # the keys of room, sorted
    steps, containers = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left > 0 and count:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append([first, count])

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                left = sizes[i]
                first, count = room[left].pop()
            else:
                left = capacity
                first, count = containers, -(-todo // (capacity // length))
                containers += count
            each = left // length
            full = min(count, todo // each)
            steps.append((length, rank, full * each, first, each, capacity - left)) if full else None
            put(left - each * length, first, full)
            todo, rank = todo - full * each, rank + full * each
            used = full
            if todo and full < count:  # fewer than ``each`` are left: they share the next container
                steps.append((length, rank, todo, first + full, todo, capacity - left))
                put(left - todo * length, first + full, 1)
                used, todo = full + 1, 0
            if i < len(sizes) and used < count:
                put(left, first + used, count - used)
            if left in room and not room[left]:
                del room[left]
                sizes.remove(left)
    return steps


def pieces(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, capacity, doc_id, piece_no, start_token, size): one row per item of each budget.

    Only a text that exceeds the capacity is cut, into full containers and a
    rest. An empty text is one piece of size 0. Budgets need a capacity of at
    least 1.
    """
    n, c = F.col("n_tokens"), F.col("capacity")
    kinds = budgets.select("budget_name", "capacity").limit(MOST_BUDGETS + 1).collect()
    if len(kinds) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    if not kinds:
        kinds = [(None, 1)]
    item = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(n / c), F.lit(1)) - 1)).alias("piece_no")
    budget = F.explode(F.array(*[F.struct(F.lit(name).cast("string").alias("budget_name"), F.lit(size).cast("bigint").alias("capacity")) for name, size in kinds])).alias("b")
    each = sized.select("doc_id", "n_tokens", budget).where("b.budget_name is not null").select("b.budget_name", "b.capacity", "doc_id", "n_tokens").select("*", item)
    start = F.col("piece_no") * c
    return each.select("budget_name", "capacity", "doc_id", "piece_no", start.alias("start_token"), F.least(c.cast("bigint"), n - start).alias("size"))


def pack(sized: DataFrame, budgets: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """Place every piece: (budget_name, doc_id, piece_no, start_token, n_tokens, container_no, at_token).

    ``sized``: doc_id, n_tokens (null counts as 0). ``budgets``: budget_name,
    capacity_tokens; a null name or a capacity under 1 holds nothing and is
    left out. Empty texts take no room: their container is null. Repeated
    documents are packed as often as they occur.
    """
    caps = budgets.where("budget_name is not null and capacity_tokens >= 1").select("budget_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).dropDuplicates(["budget_name"])
    if caps.where(F.col("capacity") > MOST_CAPACITY).count():
        raise ValueError(f"capacities over {MOST_CAPACITY} tokens are not planned")
    items = stage(pieces(sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), caps), "items")
    histogram: dict[tuple, dict[int, int]] = {}
    for name, capacity, size, count in items.where("size > 0").groupBy("budget_name", "capacity", "size").count().collect():  # at most the sum of the capacities
        histogram.setdefault((name, capacity), {})[size] = count
    steps: dict[str, dict[int, np.ndarray]] = {}
    for (name, capacity), h in histogram.items():
        by: dict[int, list] = {}
        for length, *step in plan(h, capacity):
            by.setdefault(length, []).append(step)
        steps[name] = {length: np.array(s, np.int64).T for length, s in by.items()}
    most = max((c for h in histogram.values() for c in h.values()), default=0)
    parts = max(1, -(-most // block_rows))
    placed = items.where("size > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)))
    ranked = block_rank(placed, ["budget_name", "size"], "part", [F.col("doc_id"), F.col("piece_no")])
    names = ["budget_name", "doc_id", "piece_no", "start_token", "n_tokens", "container_no", "at_token"]
    doc_type = sized.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pandas()
            container, at = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
            for (name, size), rows in t.groupby(["budget_name", "size"], sort=False).indices.items():
                first_rank, _, first, each, offset = steps[name][size]
                rank = t["rank"].to_numpy()[rows]
                step = np.searchsorted(first_rank, rank, side="right") - 1
                k = rank - first_rank[step]
                container[rows] = first[step] + k // each[step]
                at[rows] = offset[step] + k % each[step] * size
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(container), pa.array(at)], names=names)

    out = ranked.select("budget_name", "doc_id", "piece_no", "start_token", "size", "rank").mapInArrow(
        place, f"budget_name string, doc_id {doc_type}, piece_no bigint, start_token bigint, n_tokens bigint, container_no bigint, at_token bigint"
    )
    none = F.lit(None).cast("bigint")
    empty = items.where("size = 0").select("budget_name", "doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens"), none.alias("container_no"), none.alias("at_token"))
    return out.unionByName(empty)


def report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: items, containers, tokens and the share of the room that is filled."""
    p = packed.where("container_no is not null").groupBy("budget_name").agg(F.count(F.lit(1)).alias("items"), (F.max("container_no") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    caps = budgets.where("budget_name is not null and capacity_tokens >= 1").dropDuplicates(["budget_name"])
    return p.join(caps, "budget_name").select("budget_name", "capacity_tokens", "items", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def check(packed: DataFrame, sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: documents packed, containers over capacity, tokens left out, overlaps, texts cut without need, unused container numbers."""
    caps = budgets.where("budget_name is not null and capacity_tokens >= 1").select("budget_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).dropDuplicates(["budget_name"])
    p = packed.join(caps, "budget_name")
    size = sized.select(F.col("doc_id").alias("_d"), F.coalesce("n_tokens", F.lit(0)).alias("whole"))
    docs = p.groupBy("budget_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("capacity").alias("capacity")).join(size, F.col("doc_id") == F.col("_d"))
    per_doc = docs.groupBy("budget_name").agg(
        F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col("tokens") != F.col("whole"), 1)).alias("docs_incomplete"),
        F.count(F.when((F.col("pieces") > 1) & (F.col("whole") <= F.col("capacity")) | (F.col("pieces") > F.ceil(F.col("whole") / F.col("capacity"))) & (F.col("whole") > 0), 1)).alias("docs_cut_needlessly"),
    )
    # a container holds no more than its capacity in pieces, and these lie side by side
    boxes = p.where("container_no is not null").groupBy("budget_name", "container_no").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("at_token") + F.col("n_tokens")).alias("end"), F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("n"), F.count_distinct("at_token").alias("places"))
    per_box = boxes.groupBy("budget_name").agg(
        F.count(F.when((F.col("tokens") > F.col("capacity")) | (F.col("end") > F.col("capacity")), 1)).alias("overfull"), F.count(F.when((F.col("end") != F.col("tokens")) | (F.col("places") != F.col("n")), 1)).alias("overlapping"),
        (F.max("container_no") + 1 - F.count(F.lit(1))).alias("unused_numbers"),
    )
    return per_doc.join(per_box, "budget_name")
