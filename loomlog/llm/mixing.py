"""Mix sources to target shares of the total size, with capped repetition.

Every document of a source is wanted the same number of times, or in
proportion to a weight. The whole part of that number are certain copies; the
fraction is an inclusion probability, and Pareto order sampling takes the
documents with the least random odds over inclusion odds until the source has
its tokens. The order is never sorted as a whole: binned sums show the bin that
holds the cut, and only that bin is ranked. The prefix ends before the first
document that does not fit. The rest of the goal, less than that document, is
filled by a plan over the lengths of the undrawn ones, longest first, so a source
never exceeds its goal and misses it by less than any document that it could
still have had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.scratch import stage

BINS = 1 << 14


def source_key(source: Column | str) -> Column:
    """A source's own name, however it is spelled: lower case, trimmed, one hyphen for blanks, hyphens and underscores."""
    c = F.col(source) if isinstance(source, str) else source
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")), r"(?U)[\s_\-]+", "-")


def uniform(key: Column | str, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only: reruns draw the same sample."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)


def goals(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: available and wanted tokens.

    Without ``total_tokens`` the mixture is the largest in which every source
    that has tokens can reach its share. Sources without tokens reach nothing.
    ``targets`` is a small dimension; spellings of one source are summed.
    """
    t = targets.where("source is not null and target_share > 0").groupBy(source_key("source").alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats")
    )
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_docs"))
    g = t.join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("available_docs", F.lit(0)).alias("available_docs")
    )
    g = stage(g, "goals")
    most = F.col("max_repeats") * F.col("available_tokens")
    if total_tokens is None:
        total_tokens = g.where(most > 0).agg(F.min(most / F.col("target_share"))).first()[0] or 0
    return g.withColumn("wanted_tokens", F.least(most.cast("double"), F.col("target_share") * F.lit(float(total_tokens))))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with their copies, report of the shares reached).

    ``docs``: doc_id, source (any spelling), n_tokens and, if documents are to
    be unequal, ``weight`` (> 0; null or less is never drawn). A null source,
    a source without a target, and texts without tokens are in no mixture.
    A document has at most ``max_repeats`` copies. Repeated rows of one
    (doc_id, source) are one document; ties in the order are broken by doc_id.
    """
    weight = F.col("weight").cast("double") if "weight" in docs.columns else F.lit(1.0)
    d = docs.where("source is not null and n_tokens > 0").select("doc_id", source_key("source").alias("source"), "n_tokens", weight.alias("weight")).where("weight > 0").dropDuplicates(["doc_id", "source"])
    d = stage(d, "mixable")
    g = goals(d, targets, total_tokens)
    few = g.count() <= 10_000
    mass = d.groupBy("source").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("mass"))
    rate = g.join(mass, "source").select("source", (F.col("wanted_tokens") / F.col("mass")).alias("rate"), "max_repeats", "wanted_tokens")
    rate = F.broadcast(stage(rate, "rates")) if few else rate
    copies = F.least(F.col("rate") * F.col("weight"), F.col("max_repeats").cast("double"))
    e = d.join(rate, "source").withColumn("expected", copies).withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("bigint"))
    p = F.least(F.greatest(F.col("expected") - F.col("whole"), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = uniform("doc_id", seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    open_ = F.col("whole") < F.col("max_repeats")
    e = e.withColumn("order", F.when(open_, odds / (1 + odds))).withColumn("bin", F.floor(F.col("order") * bins).cast("int"))
    e = stage(e.select("doc_id", "source", "n_tokens", "whole", "order", "bin", "wanted_tokens"), "ordered")
    sums = e.groupBy("source", "bin").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("whole") * F.col("n_tokens")).alias("sure"), F.max("wanted_tokens").alias("wanted"))
    per = Window.partitionBy("source")
    upto = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = sums.withColumn("need", F.col("wanted") - F.sum("sure").over(per)).where("bin is not null")
    reach = reach.select("source", "bin", "need", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"), "tokens")
    # bins wholly before the cut are in; the first that reaches it is ranked
    cut = reach.where("before < need and before + tokens >= need").groupBy("source").agg(F.min(F.struct("bin", "before", "need")).alias("cut"))
    ends = cut.select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"), F.col("cut.need").alias("need"))
    short = reach.groupBy("source").agg(F.max("need").alias("all_need"), F.max(F.col("before") + F.col("tokens")).alias("all"))
    ends = short.join(ends, "source", "left")
    ends = F.broadcast(stage(ends, "ends")) if few else ends
    placed = e.join(ends, "source", "left")
    everything = F.col("cut_bin").isNull() & (F.col("all_need") > 0)
    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    before_cut = F.coalesce((F.col("bin") < F.col("cut_bin")) | (F.col("bin").isNotNull() & everything), F.lit(False))
    columns = ["doc_id", "source", "n_tokens", "whole", "order", "extra"]
    w = Window.partitionBy("source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.where(at_cut).withColumn("reach", F.col("before") + F.sum("n_tokens").over(w)).withColumn("extra", (F.col("reach") <= F.col("need")).cast("int"))
    ranked = stage(ranked.select(*columns, "reach", "before", "need"), "cut")
    # the gap that the prefix leaves is less than the document that did not fit: a plan over lengths fills it
    gap = ranked.groupBy("source").agg((F.max("need") - F.coalesce(F.max(F.when(F.col("extra") == 1, F.col("reach"))), F.max("before"))).alias("gap"))
    gap = F.broadcast(stage(gap, "gap")) if few else gap
    undrawn = placed.where(F.col("bin") > F.col("cut_bin")).select("doc_id", "source", "n_tokens", "order").unionByName(ranked.where("extra = 0").select("doc_id", "source", "n_tokens", "order"))
    fits = stage(undrawn.join(gap, "source").where(F.col("n_tokens") <= F.col("gap")), "fits")
    # distinct lengths, all below one document's
    taken = fits.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap")).groupBy("source").agg(F.max("gap").alias("gap"), F.array_sort(F.collect_list(F.struct((-F.col("n_tokens")).alias("order"), "n_tokens", "n"))).alias("steps"))
    zero = F.struct(F.col("gap").cast("double").alias("gap"), F.array().cast("array<struct<n_tokens:bigint,take:bigint>>").alias("plan"))

    def take(state: Column, step: Column) -> Column:
        k = F.least(step["n"], F.floor(state["gap"] / step["n_tokens"])).cast("bigint")
        here = F.array(F.struct(step["n_tokens"].cast("bigint").alias("n_tokens"), k.alias("take")))
        return F.struct((state["gap"] - k * step["n_tokens"]).alias("gap"), F.when(k > 0, F.concat(state["plan"], here)).otherwise(state["plan"]).alias("plan"))

    planned = taken.select("source", F.explode(F.aggregate("steps", zero, take, lambda x: x["plan"])).alias("p")).select("source", "p.n_tokens", "p.take")
    planned = stage(planned, "fill")
    most = planned.agg(F.coalesce(F.max("take"), F.lit(0))).first()[0]
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("order", "doc_id"))
    own = fits.join(F.broadcast(planned) if planned.count() <= 100_000 else planned, ["source", "n_tokens"]).withColumn("rank", rank).where(F.col("rank") <= most)
    fill = stage(own.where(F.col("rank") <= F.col("take")).select("source", "doc_id", F.lit(1).alias("filled")), "filled")
    all_ = placed.where(~at_cut).withColumn("extra", before_cut.cast("int")).select(*columns).unionByName(ranked.select(*columns))
    extra = F.greatest("extra", F.coalesce("filled", F.lit(0)))
    chosen = all_.join(fill, ["source", "doc_id"], "left").select("doc_id", "source", "n_tokens", (F.col("whole") + extra).alias("copies")).where("copies > 0")
    return chosen, g


def check(chosen: DataFrame, goal: DataFrame, docs: DataFrame) -> DataFrame:
    """Per target source: whether caps are kept, and the goal neither exceeded nor missed by a document that still fitted.

    ``docs`` as for ``mix``. A document fits if it has copies left and is no
    longer than what is missing.
    """
    d = docs.where("source is not null and n_tokens > 0").select("doc_id", source_key("source").alias("source"), "n_tokens").dropDuplicates(["doc_id", "source"])
    got = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed"), F.max("copies").alias("most"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("twice"))
    r = goal.join(got, "source", "left").select("source", "max_repeats", "wanted_tokens", F.coalesce("mixed", F.lit(0)).alias("mixed"), F.coalesce("most", F.lit(0)).alias("most"), F.coalesce("twice", F.lit(0)).alias("twice"))
    left = d.join(chosen.select("doc_id", "source", "copies"), ["doc_id", "source"], "left").join(r.select("source", "max_repeats", "wanted_tokens", "mixed"), "source")
    fits = left.where((F.coalesce("copies", F.lit(0)) == 0) & (F.col("max_repeats") > 0) & (F.col("n_tokens") <= F.col("wanted_tokens") - F.col("mixed") - 1e-6)).groupBy("source").agg(F.count(F.lit(1)).alias("fits"))
    return r.join(fits, "source", "left").select(
        "source", (F.col("most") <= F.col("max_repeats")).alias("caps_kept"), (F.col("twice") == 0).alias("once_each"), (F.col("mixed") <= F.col("wanted_tokens") + 1e-6).alias("not_exceeded"), F.coalesce("fits", F.lit(0)).alias("undrawn_that_fit"),
    )


def shares(chosen: DataFrame, goal: DataFrame) -> DataFrame:
    """Per target source: tokens and documents in the mixture and the share of all its tokens that it reached."""
    got = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"), F.max("copies").alias("most_copies"))
    all_ = Window.partitionBy()  # one row per target
    r = goal.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("mixed_docs", F.lit(0)).alias("mixed_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
    return r.withColumn("reached_share", F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(all_)))
