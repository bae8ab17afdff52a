"""Commands, appends, watermarks, replication rules and subscriptions."""

import random
import uuid

import pytest

from loomlog.config import LogConfig
from loomlog.engine import Engine
from loomlog.errors import EngineError
from loomlog.functions.versions import gap_of
from loomlog.operators import append, confirm, reads, replicate
from loomlog.plans import commands as c
from loomlog.sources import log as store
from loomlog.streaming.subscriptions import RECORD, AckTable, SubscriptionSource, options_of, start_offsets

SINGLE = "c3a16874-9c57-4a30-b14e-b341d48e8a68"
EVENT = "event_id string, partition_key string, partition_id int, transaction_id string, partition_sequence bigint, stream_version bigint, timestamp_ns bigint, confirmation_count int, stream_id string, event_name string, metadata binary, payload binary"
COMMIT = "transaction_id string, event_count int"


# a stream of another partition than that of "a"
B = next(x for x in "bcdefgh" if c.hash_of(c.default_key(x)) % 32 != c.hash_of(c.default_key("a")) % 32)


def make(spark, streams=("a", B), n=12, low=()):
    rows, versions, sequences = [], {}, {}
    for i in range(n):
        s = streams[i % len(streams)]
        key = c.default_key(s)
        p = c.hash_of(key) % 32
        v, q = versions.get(s, -1) + 1, sequences.get(p, -1) + 1
        versions[s], sequences[p] = v, q
        h = c.hash_of(key)
        e = uuid.UUID(int=(i << 80) | (7 << 64) | (2 << 62) | (h << 46) | i)
        rows.append((str(e), key, p, SINGLE, q, v, i * 1_000_000_000, 1 if i in low else 2, s, "E", bytearray(b""), bytearray(b"{}")))
    return spark.createDataFrame(rows, EVENT), rows


def test_parser():
    assert c.parse("escan s - + count 5") == c.ScanStream("s", 0, None, None, 5)
    assert c.parse("ESUB a b FROM MAP a=3 z=9 WINDOW 7").start == {"a": 3}
    assert [k[1] for k in c.parse("ESUB a a b").keys] == ["a", "b"]
    assert c.parse("EPSUB 3,1-2,1 FROM MAP 1=5 DEFAULT 0") == c.Subscribe("partition", [1, 2, 3], {1: 5}, 0, 1000)
    assert c.parse("EPSUB * FROM LATEST").keys is None
    assert c.parse(["EAPPEND", "s", "N", "PAYLOAD", "x y"]).events[0].payload == b"x y"
    key = str(uuid.uuid4())
    assert len(c.parse(f"EMAPPEND {key} s N EXPECTED_VERSION empty t M").events) == 2
    for text, says in [
        ("ESCAN s + +", "INVALIDARG start version cannot be '+'"), ("ESCAN s - -", "INVALIDARG end version cannot be '-'"), ("EPSCAN 1 + +", "INVALIDARG start sequence cannot be '+'"), ("NOPE", "INVALIDARG unknown command 'NOPE'"),
        ("HELLO 2", "INVALIDARG unsupported version 2, only 3 is supported"), ("PING x", "SYNTAX"), ("EAPPEND s N TIMESTAMP 1 TIMESTAMP 2", "SYNTAX timestamp already specified"), ("ESUB a WINDOW 0", "INVALIDARG"),
        ("EMAPPEND " + key + " s N EXPECTED_VERSION bad", "INVALIDARG"), ("EPSCAN 70000 - +", "INVALIDARG"), ("EGET x", "INVALIDARG invalid event id"), ("ESCAN", "SYNTAX"), ("", "SYNTAX"),
    ]:
        with pytest.raises(EngineError) as e:
            c.parse(text)
        assert str(e.value).startswith(says), (text, str(e.value))


def test_engine(spark):
    df, rows = make(spark, n=12, low=(8,))
    e = Engine(df, spark.createDataFrame([], COMMIT), LogConfig(nodes=3, cluster=True))
    page = e.execute("ESCAN a - + COUNT 2").first()
    assert page.has_more and [x.stream_version for x in page.events] == [0, 1]
    assert e.execute("ESCAN a 3 2").first().events == [] and e.execute("ESCAN nope - +").first().has_more is False
    assert e.execute("ESCAN a - + COUNT 0").first().events == []
    assert e.execute("ESVER a").first()[0] == 3  # its fifth event lacks a quorum
    assert e.execute(f"ESVER {B}").first()[0] == 5
    assert e.execute("ESVER nope").first()[0] is None
    got = e.execute(f"EGET {rows[0][0].upper()}").first()
    assert got.event_id == rows[0][0] and got.timestamp == 0
    assert e.execute(f"EGET {rows[8][0]}").count() == 0
    p = c.hash_of(c.default_key(B)) % 32
    assert e.execute(f"EPSEQ {p}").first().partition_sequence == 5
    page = e.execute(f"EPSCAN {p} 1 3").first()
    assert page.has_more and [x.partition_sequence for x in page.events] == [1, 2, 3]
    assert e.execute("PING").first()[0] == "PONG" and e.execute("HELLO 3").first().num_partitions == 32 and e.execute("INFO CACHE").count() == 1
    with pytest.raises(EngineError) as err:
        e.execute(f"EAPPEND {B} N EXPECTED_VERSION 5")
    assert err.value.code == "DBOPFAILED"
    sub = e.execute("EPSUB * FROM 0 WINDOW 4").orderBy("cursor").collect()
    assert [r.cursor for r in sub] == [0, 1, 2, 3]
    assert e.execute("ESUB a FROM LATEST").count() == 0


def test_transactions_hide_until_whole(spark):
    multi = "c3a16874-9c57-4a30-014e-b341d48e8a68"
    df, rows = make(spark, streams=("a",), n=4)
    rows = [(*r[:3], multi if i in (1, 2) else SINGLE, *r[4:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, EVENT)
    for commits, want in (([], [0, 3]), ([(multi, 2)], [0, 1, 2, 3]), ([(multi, 3)], [0, 3]), ([(multi, None)], [0, 1, 2, 3])):
        got = reads.committed(df, spark.createDataFrame(commits, COMMIT)).collect()
        assert sorted(r.partition_sequence for r in got) == want
    tail = reads.read_transaction(df, rows[2][0]).collect()
    assert [r.partition_sequence for r in tail] == [2]


def test_long_transactions_keep_all_ids(spark):
    multi = "c3a16874-9c57-4a30-014e-b341d48e8a68"
    df, rows = make(spark, streams=("a",), n=3)
    first = rows[0]
    at = EVENT.replace(",", "").split()[::2].index
    rows = []
    for i in range(10_050):
        r = list(first)
        r[at("event_id")], r[at("partition_sequence")], r[at("transaction_id")] = f"id{i}", i, multi
        rows.append(tuple(r))
    commits = spark.createDataFrame([(multi, 10_050)], COMMIT)
    got = reads.transactions(spark.createDataFrame(rows, EVENT).repartition(5), commits).collect()
    assert [(r.n, r.first_sequence, r.last_sequence) for r in got] == [(10_050, 0, 10_049)]
    assert got[0].event_ids == ",".join(f"id{i}" for i in range(10_050))


def test_watermarks_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(p, s, rng.choice([2, 2, 2, 2, 2, 3, 1, None])) for p in range(20) for s in range(30) if rng.random() > 0.04]
    rows += rows[::9]
    df = spark.createDataFrame(rows, "partition_id int, partition_sequence bigint, confirmation_count int")
    want = {}
    for p in {r[0] for r in rows}:
        have = {r[1]: r[2] or 0 for r in rows if r[0] == p}
        w = 0
        while have.get(w, 0) >= 2:
            w += 1
        want[p] = w
    assert {r[0]: r[1] for r in confirm.watermarks(df, 2, block=8).select("partition_id", "confirmed_watermark").collect()} == want
    steps = [([(1, 1)], 0), ([(1, 2)], 1), ([(1, 2), (2, 2)], 2), ([(1, 2), (2, 2), (3, 2)], 3), ([(1, 2), (2, 2), (3, 2), (5, 2)], 3), ([(1, 2), (2, 2), (3, 2), (5, 2), (4, 2)], 5)]
    for counts, w in steps:
        d = spark.createDataFrame([(0, v - 1, n) for v, n in counts], "partition_id int, partition_sequence bigint, confirmation_count int")
        assert confirm.watermarks(d, 2).first().confirmed_watermark == w
    assert confirm.watermarks(df.limit(0), 2).count() == 0


def test_append_fold_against_a_model(spark):
    rng = random.Random(3)
    streams = ["s1", "s2", "s3", "s4"]
    keys = {s: c.default_key(s) for s in streams}
    rows = [(i, i // 3, rng.choice(streams), "E", rng.choice(["any", "exists", "empty", "0", "1", "2", None, "bad"])) for i in range(200)]
    df = spark.createDataFrame(rows, "request_no bigint, tx_no bigint, stream_id string, event_name string, expected_version string")
    version, want = {}, {}
    for i, _, s, _, e in rows:
        if e == "bad":
            want[i] = ("INVALIDARG", None)
            continue
        ok = gap_of(e or "any", version.get(s))[0] == "none"
        if ok:
            version[s] = version.get(s, -1) + 1
        want[i] = ("OK", version[s]) if ok else ("WRONGVER", None)
    got = append.append(df).collect()
    assert {r.request_no: (r.status, r.stream_version) for r in got} == want
    for p in {r.partition_id for r in got}:
        own = sorted((r.request_no, r.partition_sequence) for r in got if r.partition_id == p and r.status == "OK")
        assert [q for _, q in own] == list(range(len(own)))
    # atomic, one partition key for all
    key = keys["s1"]
    tx = df.selectExpr("*", f"'{key}' partition_key")
    version, want = {}, {}
    for t in range(67):
        own = [r for r in rows if r[1] == t]
        trial, bad = dict(version), None
        for i, _, s, _, e in own:
            if bad:
                break
            if e == "bad":
                bad = "INVALIDARG"
            elif gap_of(e or "any", trial.get(s))[0] != "none":
                bad = "WRONGVER"
            else:
                trial[s] = trial.get(s, -1) + 1
        if not bad:
            version = trial
        want |= {r[0]: bad or "OK" for r in own}
    res = append.append(tx, atomic=True)
    assert {r.request_no: r.status for r in res.collect()} == want
    assert append.replies(res).count() == len({r[1] for r in rows if want[r[0]] == "OK"})
    strict = append.append(df, strict=True).where("status = 'INVALIDARG'").count()
    assert strict == sum(r[4] in ("any", "exists", None, "bad") for r in rows)


def test_key_mismatch():
    out, changed = append.fold_transaction({"s": ("k1", 4)}, [("s", "k2", "any", None)])
    assert out[0][0] == "DBOPFAILED" and not changed
    assert append.fold_transaction({}, [("s", "k", "empty", None), ("s", "k", "empty", None)])[0][0][0] == "WRONGVER"


def test_stored_log(spark, tmp_path):
    df, rows = make(spark, n=10)
    store.write(df, str(tmp_path / "log"), 32, 4)
    back = store.read(spark, str(tmp_path / "log"), 32, 4)
    assert back.count() == 10
    plan = reads.get_event(back, rows[3][0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_id" in plan and "PushedFilters: [IsNotNull(event_id)" in plan
    assert reads.get_event(back, rows[3][0]).first().stream_id == rows[3][8]
    with pytest.raises(ValueError):
        store.read(spark, str(tmp_path / "log"), 64)


def follow(spark, tmp_path, r, name="x", path="log"):
    """Run a subscription's query until nothing more is admitted; all records that it ever delivered."""
    spark.dataSource.register(SubscriptionSource)
    options = options_of(r, name, str(tmp_path / path), str(tmp_path / "acks"))
    q = spark.readStream.format("loomlog_subscription").options(**options).load()
    q = q.writeStream.format("parquet").option("path", str(tmp_path / f"out-{name}")).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(spark.read.schema(RECORD).parquet(str(tmp_path / f"out-{name}")).collect(), key=lambda x: x.cursor)


def test_subscription_goes_on_after_a_restart(spark, tmp_path):
    """Restarts with new data in an earlier partition: no record twice, none lost, never more than the window."""
    df, rows = make(spark, n=20)
    early = sorted({r[2] for r in rows})[0]
    held = df.where(f"partition_id <> {early} or partition_sequence < 3")
    held.write.parquet(str(tmp_path / "log"))
    r = c.Subscribe("partition", None, 0, None, 6)
    acks = AckTable(str(tmp_path / "acks"))
    got = follow(spark, tmp_path, r)
    assert [x.cursor for x in got] == list(range(6)) and {x.subscription_id for x in got} == {"x"}
    df.where(f"partition_id = {early} and partition_sequence >= 3").write.mode("append").parquet(str(tmp_path / "log"))
    assert len(follow(spark, tmp_path, r)) == 6  # nothing was acknowledged: the window is full
    for cursor in (3, 9, 15, 19, 25):
        assert acks.ack("x", cursor) == cursor
        got = follow(spark, tmp_path, r)
        assert [x.cursor for x in got] == list(range(min(20, cursor + 7)))
    assert len({(x.partition_id, x.partition_sequence) for x in got}) == 20
    for p in {x.partition_id for x in got}:
        own = [x.partition_sequence for x in got if x.partition_id == p]
        assert own == list(range(len(own)))
    assert acks.ack("x", 2) == 25 and acks.get("y") is None


def test_live_and_stream_subscriptions(spark, tmp_path):
    df, rows = make(spark, n=20)
    df.where("stream_version < 4").write.parquet(str(tmp_path / "log"))
    live = c.parse("EPSUB * FROM LATEST")
    stream = c.parse(f"ESUB a {B} FROM MAP a=2")
    assert follow(spark, tmp_path, live, "live") == []
    assert [(x.stream_id, x.stream_version) for x in follow(spark, tmp_path, stream, "stream")] == [("a", 2), ("a", 3)]
    df.where("stream_version >= 4").write.mode("append").parquet(str(tmp_path / "log"))
    got = follow(spark, tmp_path, live, "live")
    assert len(got) == 12 and min(x.stream_version for x in got) == 4 and [x.cursor for x in got] == list(range(12))
    got = follow(spark, tmp_path, stream, "stream")
    assert sorted(x.stream_version for x in got if x.stream_id == "a") == list(range(2, 10)) and sorted(x.stream_version for x in got if x.stream_id == B) == list(range(4, 10))
    assert [x.cursor for x in got] == list(range(14))
    assert start_offsets(confirm.watermarks(df, 2), None, {}, 0) == {p: 0 for p in {r[2] for r in rows}}


def test_stateful_append_stream(spark, tmp_path):
    from loomlog.streaming import appends

    schema = "request_no bigint, stream_id string, event_name string, expected_version string"
    one = [(0, "s", "E", "empty"), (1, "s", "E", "0"), (2, "s", "E", "5")]
    two = [(3, "s", "E", "1"), (4, "t", "E", "exists")]
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        appends.publish(appends.judge(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.request_no: (r.status, r.stream_version, r.partition_sequence) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: ("OK", 0, 0), 1: ("OK", 1, 1), 2: ("WRONGVER", None, None), 3: ("OK", 2, 2), 4: ("WRONGVER", None, None)}


def test_queue_and_breaker():
    q = replicate.OrderedQueue(next=5, capacity=2)
    assert q.insert(4, "x") == ("stale", None) and q.insert(5, "x") == ("deliver", None)
    assert q.insert(5, "x") == ("deliver", None) and q.insert(5, "y") == ("conflict", None)
    assert q.take()[0] == "x" and q.next == 6
    assert q.insert(9, "a") == ("buffer", None) and q.insert(9, "a") == ("merge", None) and q.insert(9, "b") == ("conflict", None)
    assert q.insert(8, "c") == ("buffer", None) and q.insert(9, "a") == ("full", None) and q.insert(7, "d") == ("evict", 9)
    now = [0.0]
    t = replicate.TimeoutQueue(10, lambda: now[0], next=0)
    t.insert(3, "x")
    now[0] = 11
    assert t.expired() == [3] and t.expired() == []
    b = replicate.CircuitBreaker(failures=2, pause=30, clock=lambda: now[0])
    b.failure(), b.failure()
    assert not b.allow()
    now[0] += 31
    assert [b.allow() for _ in range(4)] == [True, True, True, False]
    b.success(), b.success()
    assert b.allow()


def test_membership_and_placement(spark):
    h = spark.createDataFrame([("n", 0), ("n", 5), ("n", 30), ("m", 1), (None, 2)], "node string, at_ms bigint")
    assert sorted(tuple(r) for r in replicate.memberships(h, 10).collect()) == [("m", 1, 1), ("n", 0, 5), ("n", 30, 30)]
    assert replicate.bucket_ranges(3, 8) == [(0, 0, 2), (1, 3, 5), (2, 6, 7)]
    s = spark.createDataFrame([(1, 2), (1, 3), (1, 7), (1, None)], "p int, s bigint")
    assert [tuple(r) for r in replicate.missing_ranges(s, "p", "s").orderBy("from_sequence").collect()] == [(1, 0, 1), (1, 4, 6)]
    w = spark.createDataFrame([("5", True, 1, 9, True), ("any", True, 1, 9, True), ("5", False, 1, 9, True), ("5", True, 10, 9, True), ("5", True, 1, 9, False)], "expected_sequence string, sender_known boolean, age_ms int, timeout_ms int, owned boolean")
    assert [r.status for r in replicate.accept_rules(w).collect()] == ["OK", "MISSINGPARTSEQ", "INVALIDSENDER", "STALEWRITE", "PARTNOTOWNED"]


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"partitions": 64, "buckets": 8}')
    got = LogConfig.load(str(f), {"LOOMLOG_BUCKETS": "16", "OTHER": "1"}, strict_versioning=False)
    assert (got.partitions, got.buckets, got.strict_versioning, got.rf, got.quorum) == (64, 16, False, 1, 1)
    bad = LogConfig(buckets=0, partitions=2, nodes=3, replication_factor=4, segment_bytes=1, writer_threads=0, heartbeat_timeout_ms=1)
    assert len(bad.problems()) >= 7
    with pytest.raises(ValueError):
        LogConfig.load(None, {}, nothing=1)
