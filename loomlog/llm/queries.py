"""Queries of the language-model operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.names import with_event_type
from loomlog.llm import garbled, mixing, packing, runs, sequences, tokens
from loomlog.scratch import stage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "event_log").select("partition_id", "stream_id", "stream_version", "partition_sequence", "timestamp_ns", "event_name")
    return with_event_type(log, table(spark, sf, "event_types")).select(
        "partition_id", "stream_id", F.col("stream_version").alias("version"), F.col("partition_sequence").alias("seq"), F.col("timestamp_ns").alias("ts"), F.col("event_type").alias("label")
    )


STREAM = ["partition_id", "stream_id"]


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.frequent(sequences.words(typed_events(spark, sf), STREAM), share=0.025, least=4, longest=4)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf).where(F.size("pattern") >= 3).select(F.array_join("pattern", ">").alias("pattern"))


def p1_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _patterns(spark, sf).select(F.array_join("pattern", ">").alias("pattern"), F.size("pattern").alias("steps"), F.col("support").alias("n_streams"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs.collapse(typed_events(spark, sf), STREAM).where("n >= 2").select("partition_id", "stream_id", "first_version", "last_version")


def p3_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = runs.collapse(typed_events(spark, sf), STREAM)
    return r.select("partition_id", "stream_id", "first_version", "last_version", F.col("label").alias("event_type"), "n", F.col("first_ts").alias("first_ns"), F.col("last_ts").alias("last_ns"), F.col("duration").alias("duration_ns"))


def sized_documents(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return tokens.with_tokens(table(spark, sf, "documents").select("doc_id", *keep, "text"))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(sized_documents(spark, sf), table(spark, sf, "pack_budgets"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(p8_packed(spark, sf), table(spark, sf, "pack_budgets"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, sf, "source"), table(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*mixing.mix(sized_documents(spark, sf, "source"), table(spark, sf, "mix_targets")))


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can say of the packing: every document once and whole, nothing overfull, cut or overlapping without need."""
    sized = stage(sized_documents(spark, sf), "sized")
    budgets = table(spark, sf, "pack_budgets")
    return packing.check(stage(packing.pack(sized, budgets), "packed"), sized, budgets)


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can say of the mixture: caps kept, goals not exceeded, no undrawn document fits into what is missing."""
    sized = stage(sized_documents(spark, sf, "source"), "sized")
    chosen, goal = mixing.mix(sized, table(spark, sf, "mix_targets"))
    return mixing.check(stage(chosen, "chosen"), goal, sized)


def weighted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are wanted in proportion to their votes, at most 64 times the least."""
    votes = F.least(F.greatest(F.coalesce("votes", F.lit(0)), F.lit(0)), F.lit(63))
    return sized_documents(spark, sf, "source", "votes").withColumn("weight", (1 + votes).cast("double"))


def p9_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture of a third of what is there, documents drawn with unequal probabilities: (doc_id, source, n_tokens, copies)."""
    return _weighted(stage(weighted_documents(spark, sf), "sized"), spark, sf)[0]


def _weighted(sized: DataFrame, spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    total = sized.where("source is not null").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return mixing.mix(sized, table(spark, sf, "mix_targets"), total_tokens=total // 3)


def p9_weighted_check(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of a mixture, and whether documents of more weight have the larger share of draws in each source with both."""
    sized = stage(weighted_documents(spark, sf), "sized")
    chosen, goal = _weighted(sized, spark, sf)
    chosen = stage(chosen, "chosen")
    drawn = sized.where("n_tokens > 0 and source is not null").withColumn("source", mixing.source_key("source")).join(chosen.select("doc_id", "copies"), "doc_id", "left").fillna(0, ["copies"])
    per = drawn.groupBy("source").agg((F.sum(F.col("weight") * F.col("copies")) / F.sum("copies")).alias("drawn"), F.avg("weight").alias("all"))
    heavier = per.select("source", (F.coalesce("drawn", "all") >= F.col("all")).alias("heavier_drawn"))
    return mixing.check(chosen, goal, sized).join(heavier, "source", "left").withColumn("heavier_drawn", F.coalesce("heavier_drawn", F.lit(True)))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.find(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.find(table(spark, sf, "documents").select("doc_id", "text"))


QUERIES = {
    "p1_found": p1_found, "p1_patterns": p1_patterns, "p3_found": p3_found, "p3_runs": p3_runs,
    "p8_packed": p8_packed, "p8_report": p8_report, "p8_check": p8_check, "p9_check": p9_check, "p9_weighted": p9_weighted, "p9_weighted_check": p9_weighted_check, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_restored": p10_restored,
}

_TYPED = r"""
WITH once AS (SELECT DISTINCT ON (partition_id, partition_sequence) * FROM event_log),
e AS (SELECT o.partition_id, o.stream_id, o.stream_version AS v, o.timestamp_ns AS ts, t.event_type
      FROM once o JOIN event_types t ON regexp_replace(regexp_replace(lower(o.event_name), '[^\p{L}\p{Nd}]', '', 'g'), '\p{Nd}+$', '') = t.event_type),
"""
_ISLANDS = _TYPED + """
f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND lag(v) OVER w = v - 1 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY partition_id, stream_id ORDER BY v)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY partition_id, stream_id ORDER BY v) AS run FROM f),
r AS (SELECT partition_id, stream_id, min(v) AS first_version, max(v) AS last_version, event_type, count(*) AS n, min(ts) AS first_ns, max(ts) AS last_ns, max(ts) - min(ts) AS duration_ns
      FROM g GROUP BY partition_id, stream_id, run, event_type)
"""

_TARGETS = """SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_-]+', '-', 'g') AS source, true AS caps_kept, true AS once_each, true AS not_exceeded, CAST(0 AS BIGINT) AS undrawn_that_fit"""
ORACLES = {
    "p8_check": """SELECT budget_name, (SELECT count(*) FROM documents) AS docs, CAST(0 AS BIGINT) AS docs_incomplete, CAST(0 AS BIGINT) AS docs_cut_needlessly,
  CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS unused_numbers FROM pack_budgets""",
    "p9_check": _TARGETS + " FROM mix_targets",
    "p9_weighted_check": _TARGETS + ", true AS heavier_drawn FROM mix_targets",
    "p3_found": _ISLANDS + "SELECT partition_id, stream_id, first_version, last_version FROM r WHERE n >= 2",
    "p3_runs": _ISLANDS + "SELECT * FROM r",
}
