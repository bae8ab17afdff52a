"""Frequent subsequences, with gaps, across many sequences.

Sequences are kept short without changing any answer: two words with the same
subsequences up to length k (Simon's congruence) have the same patterns, and the
congruence holds under concatenation. So long sequences are cut in blocks, each
block is reduced on its own, and neighbours are joined and reduced again in
rounds; no task ever holds a long sequence.

Shards of a few thousand sequences are compressed into sequence decision
diagrams, which are mined by pushing the conditional diagram of each prefix
item. A pattern that reaches the threshold overall reaches its share in at
least one shard, so the union of the shards' patterns misses nothing; patterns
that some shard did not report are counted there exactly in a second pass.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.blocks import block_of
from loomlog.scratch import stage

BLOCK = 1 << 12
FAN_IN = 64
SHARD = 8192
#: Partitions that shards are laid out in; more shards than that share them in order.
MOST_TASKS = 20_000


def reduce_word(word: list, k: int) -> list:
    """A shorter word with exactly the same subsequences of up to ``k`` letters.

    A position's left rank is the length of the shortest word whose leftmost
    embedding ends there, its right rank the mirror image; a position whose
    ranks sum to more than k + 1 can go (Fleischer and Kufleitner, "Testing
    Simon's congruence", 2018).
    """
    low: dict = {}
    kept: list[tuple] = []
    for c in word:
        x = low.get(c, 1)
        if x > k:
            continue
        kept.append((c, x))
        for d in low:
            if low[d] > x + 1:
                low[d] = x + 1
        low[c] = x + 1
    high: dict = {}
    out = []
    for c, x in reversed(kept):
        y = high.get(c, 1)
        if x + y > k + 1:
            continue
        out.append(c)
        for d in high:
            if high[d] > y + 1:
                high[d] = y + 1
        high[c] = y + 1
    out.reverse()
    return out


class Diagram:
    """A sequence decision diagram over weighted sequences, with hash-consed nodes.

    Node: (item, hi, lo): ``hi`` has the sequences that start with the item,
    without it; ``lo`` those that start with a larger item, or end. A chain of
    ``lo`` ends in a leaf that holds the weight of the empty sequence.
    """

    def __init__(self) -> None:
        self.item: list[int] = []
        self.hi: list[int] = []
        self.lo: list[int] = []
        self.weight: list[int] = []  # sequences below the node, by weight
        self.items: list[int] = []  # bit mask of the items below the node
        self._unique: dict[tuple, int] = {}
        self._sum: dict[tuple[int, int], int] = {}
        self.empty = self.leaf(0)

    def leaf(self, weight: int) -> int:
        return self._node((-1, weight, -1), weight, 0)

    def node(self, item: int, hi: int, lo: int) -> int:
        if hi == self.empty:
            return lo
        return self._node((item, hi, lo), self.weight[hi] + self.weight[lo], self.items[hi] | self.items[lo] | 1 << item)

    def _node(self, key: tuple, weight: int, items: int) -> int:
        n = self._unique.get(key)
        if n is None:
            n = self._unique[key] = len(self.item)
            self.item.append(key[0] if key[0] >= 0 else 1 << 60)
            self.hi.append(key[1])
            self.lo.append(key[2])
            self.weight.append(weight)
            self.items.append(items)
        return n

    def build(self, words: list[tuple], at: int = 0) -> int:
        """From (sequence, weight) pairs sorted by sequence."""
        i, ended = 0, 0
        while i < len(words) and len(words[i][0]) == at:
            ended += words[i][1]
            i += 1
        groups = []
        while i < len(words):
            x, j = words[i][0][at], i
            while j < len(words) and words[j][0][at] == x:
                j += 1
            groups.append((x, i, j))
            i = j
        n = self.leaf(ended)
        for x, i, j in reversed(groups):
            n = self.node(x, self.chain(words[i], at + 1) if j == i + 1 else self.build(words[i:j], at + 1), n)
        return n

    def chain(self, word: tuple, at: int) -> int:
        n = self.leaf(word[1])
        for x in reversed(word[0][at:]):
            n = self.node(x, n, self.empty)
        return n

    def add(self, a: int, b: int) -> int:
        """The sum of two weighted sets of sequences."""
        if a == self.empty:
            return b
        if b == self.empty:
            return a
        if a > b:
            a, b = b, a
        n = self._sum.get((a, b))
        if n is None:
            x, y = self.item[a], self.item[b]
            if x == y:
                n = self.leaf(self.weight[a] + self.weight[b]) if x == 1 << 60 else self.node(x, self.add(self.hi[a], self.hi[b]), self.add(self.lo[a], self.lo[b]))
            elif x < y:
                n = self.node(x, self.hi[a], self.add(self.lo[a], b))
            else:
                n = self.node(y, self.hi[b], self.add(a, self.lo[b]))
            self._sum[a, b] = n
        return n

    def after(self, n: int, x: int, keep: int) -> int:
        """The conditional diagram: what follows the first ``x``, of the sequences that have one.

        Only items of the mask ``keep`` stay in it.
        """
        item, hi, lo, items = self.item, self.hi, self.lo, self.items
        done: dict[int, int] = {}
        kept: dict[int, int] = {}

        def project(n: int) -> int:
            if not items[n] & ~keep:
                return n
            p = kept.get(n)
            if p is None:
                y = item[n]
                p = kept[n] = self.node(y, project(hi[n]), project(lo[n])) if keep >> y & 1 else self.add(project(hi[n]), project(lo[n]))
            return p

        def find(n: int) -> int:
            if not items[n] >> x & 1:
                return self.empty
            c = done.get(n)
            if c is None:
                c = done[n] = self.add(project(hi[n]) if item[n] == x else find(hi[n]), find(lo[n]))
            return c

        return find(n)

    def pairs(self, n: int) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
        """Weight of the sequences that contain each item, and each ordered pair of different items.

        Follows the paths with the items met so far and, per item, those that
        it has already been seen to follow.
        """
        one: dict[int, int] = {}
        two: dict[tuple[int, int], int] = {}
        item, hi, lo, weight, items = self.item, self.hi, self.lo, self.weight, self.items
        todo = [(n, 0, {})]
        while todo:
            n, met, follows = todo.pop()
            while items[n]:
                x, h = item[n], hi[n]
                bit, w = 1 << x, weight[h]
                if not met & bit:
                    one[x] = one.get(x, 0) + w
                fresh = met & ~follows.get(x, 0) & ~bit
                if items[h]:
                    todo.append((h, met | bit, follows | {x: met} if fresh else follows))
                while fresh:
                    b = fresh & -fresh
                    fresh ^= b
                    k = (b.bit_length() - 1, x)
                    two[k] = two.get(k, 0) + w
                n = lo[n]
        return one, two


def mine(d: Diagram, root: int, least: int, longest: int) -> dict[tuple, int]:
    """All sequences of up to ``longest`` different items in at least ``least`` (by weight) of the sequences.

    The conditional diagram of a prefix keeps only the items that are frequent
    after it. Subproblems are identical if they have the same conditional
    diagram and the same length left; their patterns are found once.
    """
    memo: dict[tuple[int, int], list] = {}

    def below(n: int, left: int) -> list:
        found = memo.get((n, left))
        if found is None:
            found = memo[n, left] = []
            if d.weight[n] >= least:
                one, two = d.pairs(n)
                keep: dict[int, int] = {}
                for (x, y), s in two.items():
                    if s >= least:
                        keep[x] = keep.get(x, 0) | 1 << y
                        if left == 2:
                            found.append(((x, y), s))
                found += [((x,), s) for x, s in one.items() if s >= least]
                if left > 2:
                    for x, mask in keep.items():
                        found += [((x, *p), w) for p, w in below(d.after(n, x, mask), left - 1) if x not in p]
        return found

    return {p: s for p, s in below(root, longest) if len(p) <= longest}


def count(d: Diagram, root: int, patterns: Iterable[tuple]) -> dict[tuple, int]:
    """Exact support of the given patterns, along their shared prefixes."""
    out: dict[tuple, int] = {}

    def push(n: int, prefix: tuple, rest: list[tuple]) -> None:
        nxt: dict[int, list[tuple]] = {}
        for p in rest:
            if p:
                nxt.setdefault(p[0], []).append(p[1:])
            else:
                out[prefix] = d.weight[n]
        for x, tails in nxt.items():
            keep = 0
            for t in tails:
                for y in t:
                    keep |= 1 << y
            push(d.after(n, x, keep), (*prefix, x), tails)

    push(root, (), list(patterns))
    return out


def words(events: DataFrame, entity: list[str], longest: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per entity: (entity..., word array<string>), reduced to what patterns of ``longest`` can see.

    ``events``: entity..., version, seq, label. Rows of the same (entity,
    version, seq) are one event; a null label is an event of no type and leaves
    the word unchanged; a null version or entity has no place in a sequence.
    """
    known = F.col("version").isNotNull()
    for c in entity:
        known = known & F.col(c).isNotNull()
    keys = [*entity, "block"]
    e = events.where(known).select(*entity, "version", "seq", "label", block_of("version", block).alias("block"))
    once = e.repartition(*keys).dropDuplicates([*keys, "version", "seq"]).sortWithinPartitions(*keys, "version", "seq")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in e.select(*keys).schema)}, word array<string>"
    k, width = longest, len(keys)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, word = None, []
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [pa.array([r[0][i] for r in done], out_schema.field(i).type) for i in range(width)]
            b = pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in done], pa.list_(pa.string()))], names=[*keys, "word"])
            done.clear()
            return b

        out_schema = None
        for b in batches:
            out_schema = out_schema or b.schema.remove(width)
            for *own, label in zip(*[b.column(i).to_pylist() for i in range(width + 1)]):
                if own != key:
                    if key is not None:
                        done.append((key, reduce_word(word, k)))
                        if len(done) >= 4096:
                            yield flush()
                    key, word = own, []
                if label is not None and (not word or word[-1] != label):
                    word.append(label)
        if key is not None:
            done.append((key, reduce_word(word, k)))
        if done:
            yield flush()

    short = stage(once.select(*keys, "label").mapInArrow(shorten, schema), "words")
    most = short.agg(F.max("block")).first()[0] or 0
    while most > 0:  # a round joins FAN_IN neighbours of the streams that have several blocks
        short = stage(_join_blocks(short, entity, k), "words")
        most //= FAN_IN
    return short.select(*entity, "word")


def _join_blocks(short: DataFrame, entity: list[str], k: int) -> DataFrame:
    reduce_udf = F.pandas_udf(lambda s: s.map(lambda w: reduce_word(list(w), k)), "array<string>")
    up = F.floor(F.col("block") / FAN_IN).cast("bigint")
    g = short.groupBy(*entity, up.alias("up")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("block", "word"))).alias("parts"))
    flat = g.select(*entity, F.col("up").alias("block"), "n", F.flatten(F.col("parts.word")).alias("word"))
    one = flat.where("n = 1").drop("n")
    return one.unionByName(flat.where("n > 1").select(*entity, "block", reduce_udf("word").alias("word")))


def frequent(sequences: DataFrame, share: float, least: int, longest: int, shard: int = SHARD, at_once: int = 200_000) -> DataFrame:
    """(pattern array<string>, support): ordered patterns of different items in enough sequences.

    Enough: at least ``least`` and at least ``share`` of all ``sequences`` (an
    entity's row counts even if its word is empty). Patterns have one to
    ``longest`` items. Candidates, whose number depends on the threshold and not
    on the number of sequences, are divided by hash into parts of some
    ``at_once``; a part is broadcast, counted and stored before the next comes
    to the driver. Every part builds the diagrams again.
    """
    spark = sequences.sparkSession
    total = sequences.count()
    need = max(least, math.ceil(share * total - 1e-9), 1)
    result = "pattern array<string>, support bigint"
    if not total:
        return spark.createDataFrame([], result)
    seen = sequences.select(F.explode(F.array_distinct("word")).alias("item")).groupBy("item").count().where(F.col("count") >= need)
    names = sorted(r[0] for r in seen.select("item").collect())  # each of them in a fixed share of the sequences
    code = {x: i for i, x in enumerate(names)}
    shards = max(1, math.ceil(total / shard))
    sharded = sequences.select(F.pmod(F.xxhash64(F.to_json(F.struct(*[c for c in sequences.columns if c != "word"]))), F.lit(shards)).alias("shard"), "word")
    # ranges of shards as partitions: a shard is mined for seconds, however few bytes it has, so none wait for another in one task
    sharded = stage(sharded, "shards").repartitionByRange(min(shards, MOST_TASKS), "shard")
    share_of = need / total

    def threshold(t: pa.Table) -> int:
        return max(1, math.ceil(share_of * t.num_rows - 1e-9))

    def diagram(t: pa.Table) -> tuple[Diagram, int]:
        weight: dict[tuple, int] = defaultdict(int)
        for w in t.column("word").to_pylist():
            own, last = [], -1
            for x in w or ():
                c = code.get(x, -1)
                if c >= 0 and c != last:
                    own.append(c)
                    last = c
            weight[tuple(own)] += 1
        sys.setrecursionlimit(1_000_000)  # as deep as the longest word has letters and siblings
        d = Diagram()
        return d, d.build(sorted(weight.items()))

    def local(t: pa.Table) -> pa.Table:
        d, root = diagram(t)
        found = mine(d, root, threshold(t), longest)
        return pa.table({"pattern": pa.array([list(p) for p in found], pa.list_(pa.int32())), "support": pa.array(list(found.values()), pa.int64())})

    def recount(wanted):
        def one(t: pa.Table) -> pa.Table:
            d, root = diagram(t)
            own = threshold(t)
            got = {p: n for p, n in count(d, root, wanted.value).items() if 0 < n < own}  # the others were reported
            return pa.table({"pattern": pa.array([list(p) for p in got], pa.list_(pa.int32())), "support": pa.array(list(got.values()), pa.int64())})

        return one

    mined = stage(sharded.groupBy("shard").applyInArrow(local, "pattern array<int>, support bigint"), "mined")
    sizes = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select(F.sum(F.ceil(F.lit(share_of) * F.col("n") - 1e-9) - 1).alias("slack"), F.count(F.lit(1)).alias("shards"))
    slack, filled = sizes.first()
    per = mined.groupBy("pattern").agg(F.sum("support").alias("support"), F.count(F.lit(1)).alias("reports"))
    # a shard that did not report a pattern holds it less often than its own threshold
    open_ = per.where((F.col("reports") < filled) & (F.col("support") + F.lit(int(slack)) >= need)).select("pattern")
    open_ = stage(open_, "open")
    chunks = -(-open_.count() // at_once)
    missing = spark.createDataFrame([], "pattern array<int>, support bigint")
    for c in range(chunks):  # one after the other: each is counted and stored before the next is read
        own = open_.where(F.pmod(F.xxhash64("pattern"), F.lit(chunks)) == c) if chunks > 1 else open_
        wanted = spark.sparkContext.broadcast(sorted(tuple(r[0]) for r in own.collect()))
        counted = stage(sharded.groupBy("shard").applyInArrow(recount(wanted), "pattern array<int>, support bigint").groupBy("pattern").agg(F.sum("support").alias("support")), "recount")
        wanted.unpersist()  # a lost task of a later stage reads what is stored
        missing = missing.unionByName(counted)
    exact = mined.select("pattern", "support").unionByName(missing).groupBy("pattern").agg(F.sum("support").alias("support")).where(F.col("support") >= need)
    lookup = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    return exact.select(F.transform("pattern", lambda i: F.get(lookup, i)).alias("pattern"), "support")
