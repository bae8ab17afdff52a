"""A log that grows by batches: judged against what is stored, visible as a whole, recovered after crashes."""

import random
import uuid

import pytest

from loomlog.config import LogConfig
from loomlog.engine import Engine
from loomlog.errors import EngineError
from loomlog.functions.versions import gap_of
from loomlog.operators import confirm, reads
from loomlog.plans import commands as c
from loomlog.sources.stored import StoredLog
from test_engine import B, COMMIT, make

REQUEST = "request_no bigint, tx_no bigint, stream_id string, event_name string, expected_version string"


def ask(spark, rows, more=""):
    return spark.createDataFrame(rows, REQUEST + more)


@pytest.mark.parametrize("buckets,partitions", [(1, 32), (2, 32), (8, 64)])
def test_engine_reads_its_own_writes(spark, tmp_path, buckets, partitions):
    config = LogConfig(buckets=buckets, partitions=partitions, writer_threads=1)
    e = Engine.open(spark, str(tmp_path / "log"), config)
    key = str(uuid.UUID(int=(5 << 46) | 7))  # not the default key of the stream
    first = e.execute(f"EAPPEND s N PARTITION_KEY {key} EXPECTED_VERSION empty TIMESTAMP 7 PAYLOAD body").first()
    assert (first.partition_id, first.partition_sequence, first.stream_version, first.timestamp) == (c.hash_of(key) % partitions, 0, 0, 7)
    assert c.hash_of(first.event_id) == c.hash_of(key)
    again = Engine.open(spark, str(tmp_path / "log"), config)
    assert again.execute(f"EAPPEND s N PARTITION_KEY {key} EXPECTED_VERSION 0").first().stream_version == 1
    got = again.execute(f"EGET {first.event_id}").first()
    assert (got.stream_id, bytes(got.payload), bytes(got.metadata), got.timestamp) == ("s", b"body", b"", 7)
    assert [x.stream_version for x in again.execute(f"ESCAN s - + PARTITION_KEY {key}").first().events] == [0, 1]
    assert again.execute(f"ESVER s PARTITION_KEY {key}").first()[0] == 1
    assert [x.partition_sequence for x in again.execute(f"EPSCAN {key} - +").first().events] == [0, 1]
    assert again.execute(f"EPSEQ {key}").first()[1] == 1
    # a scan that names no key looks in the bucket of the default one
    same = c.hash_of(c.default_key("s")) % partitions % buckets == c.hash_of(key) % partitions % buckets
    assert len(again.execute("ESCAN s - +").first().events) == (2 if same else 0)
    assert {r.partition_id for r in again.execute(f"EPSUB {key} FROM 0").collect()} == {c.hash_of(key) % partitions}
    for text, code in [(f"EAPPEND s N PARTITION_KEY {key}", "INVALIDARG"), (f"EAPPEND s N PARTITION_KEY {key} EXPECTED_VERSION 4", "WRONGVER"), (f"EAPPEND s N PARTITION_KEY {key} EXPECTED_VERSION empty", "WRONGVER"), (f"EAPPEND s N EXPECTED_VERSION empty EVENT_ID {uuid.UUID(int=1)}", "INVALIDARG")]:
        with pytest.raises(EngineError) as err:
            again.execute(text)
        assert err.value.code == code, text
    if same:
        with pytest.raises(EngineError, match="DBOPFAILED"):
            again.execute("EAPPEND s N EXPECTED_VERSION 1")
    with pytest.raises(ValueError):
        StoredLog(spark, str(tmp_path / "log"), LogConfig(buckets=buckets, partitions=partitions * 2, writer_threads=1))


def test_batches_against_a_model(spark, tmp_path):
    rng = random.Random(11)
    stored = StoredLog(spark, str(tmp_path / "log"), LogConfig(strict_versioning=False))
    version, top = {}, {}
    streams = ["s1", "s2", "s3", "s4", "s5"]
    for batch in range(3):
        rows = [(i, i, rng.choice(streams), "E", rng.choice(["any", "exists", "empty", "0", "3", None])) for i in range(40)]
        want = {}
        for i, _, s, _, x in rows:
            ok = gap_of(x or "any", version.get(s))[0] == "none"
            if ok:
                version[s] = version.get(s, -1) + 1
                p = c.hash_of(c.default_key(s)) % 32
                top[p] = top.get(p, -1) + 1
            want[i] = ("OK", version[s], top[p]) if ok else ("WRONGVER", None, None)
        got = stored.append(ask(spark, rows)).collect()
        assert {r.request_no: (r.status, r.stream_version, r.partition_sequence) for r in got} == want
        if batch == 1:
            stored.compact()
            stored.recover()
            assert len(stored.batches()) == 1
    assert stored.events().count() == sum(v + 1 for v in version.values())
    assert {r.stream_id: r.stream_version for r in stored.heads().collect()} == version
    assert reads.committed(stored.events(), stored.commits()).count() == stored.events().count()


def test_transactions_and_expected_sequences(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"), LogConfig(strict_versioning=False, segment_bytes=128 << 10))
    key = c.default_key("a")
    rows = [
        (0, 0, "a", "E", "empty", key, "empty", b""), (1, 0, "b", "E", "empty", key, None, b""), (2, 1, "a", "E", "0", key, "0", b""), (3, 2, "a", "E", "0", key, "1", b""), (4, 2, "a", "E", "1", key, None, None),
        (5, 3, "a", "E", "any", key, None, b"x" * (130 << 10)), (6, 4, "a", "E", "empty", key, None, b""), (7, 5, "a", "E", "any", key, None, b""), (8, 5, "c", "E", "any", c.default_key(B), None, b""),
        (None, 6, "a", "E", "any", key, None, b""),
    ]
    got = {r.request_no: r for r in stored.append(ask(spark, rows, ", partition_key string, expected_partition_sequence string, payload binary"), atomic=True, now_ms=5).collect()}
    assert {n: r.status for n, r in got.items()} == {0: "OK", 1: "OK", 2: "WRONGSEQ", 3: "OK", 4: "OK", 5: "DBOPFAILED", 6: "WRONGVER", 7: "INVALIDARG", 8: "INVALIDARG", None: "INVALIDARG"}
    assert [got[n].partition_sequence for n in (0, 1, 3, 4)] == [0, 1, 2, 3] and got[4].stream_version == 2 and got[4].timestamp == 5
    assert got[0].transaction_id == got[1].transaction_id != got[3].transaction_id
    assert sorted(r.event_count for r in stored.commits().collect()) == [2, 2]
    visible = reads.visible(stored.events(), stored.commits(), 1)
    assert visible.count() == 4


def test_confirmations(spark, tmp_path):
    df, rows = make(spark, n=12, low=(0, 8))
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.load(df, spark.createDataFrame([], COMMIT))
    key = "partition_id int, partition_sequence bigint, confirmation_count int"
    bad = stored.set_confirmations(spark.createDataFrame([(rows[0][2], 0, 2), (rows[0][2], 99, 2)], key))
    assert sorted(r.status for r in bad.collect()) == ["NOTFOUND", "OK"]
    assert stored.events().where("confirmation_count < 2").count() == 2  # nothing was set
    assert stored.set_confirmations(spark.createDataFrame([(rows[0][2], 0, 13)], key)).first().status == "INVALIDARG"
    assert stored.set_confirmations(spark.createDataFrame([(rows[0][2], 0, 3)], key)).first().status == "OK"
    marks = {r.partition_id: r.confirmed_watermark for r in stored.watermarks(2).collect()}
    assert marks[rows[0][2]] == 4
    stored.set_confirmations(spark.createDataFrame([(rows[0][2], 0, 1)], key))  # set, not the highest
    stored.compact()
    assert {r.partition_sequence: r.confirmation_count for r in stored.events().where(f"partition_id = {rows[0][2]}").collect()}[0] == 1
    snap = confirm.Snapshots(spark, str(tmp_path / "marks"))
    snap.save(confirm.watermarks(df.where("partition_sequence < 2"), 2))
    want = sorted(map(tuple, confirm.watermarks(df, 2).collect()))
    assert sorted(map(tuple, snap.reopen(df, 2).collect())) == want
    assert snap.due(101, 0) and snap.due(1, 6) and not snap.due(0, 60) and not snap.due(100, 5)


def test_a_crash_leaves_no_batch(spark, tmp_path, monkeypatch):
    stored = StoredLog(spark, str(tmp_path / "log"), LogConfig(strict_versioning=False))
    stored.append(ask(spark, [(0, 0, "s", "E", "empty")]))
    with monkeypatch.context() as m:
        m.setattr(stored.published, "publish", lambda number, folder: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            stored.append(ask(spark, [(0, 0, "s", "E", "0")]))
    back = StoredLog(spark, str(tmp_path / "log"), LogConfig(strict_versioning=False))
    assert back.events().count() == 1 and len(list((tmp_path / "log/events").glob("batch=*"))) == 2
    back.recover()
    assert len(list((tmp_path / "log/events").glob("batch=*"))) == 1
    assert back.append(ask(spark, [(0, 0, "s", "E", "0")])).first().stream_version == 1


def test_point_reads_reach_the_scan(spark, tmp_path):
    df, rows = make(spark, n=12)
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.load(df, spark.createDataFrame([], COMMIT))
    e = Engine.open(spark, str(tmp_path / "log"))
    e.marks.count()
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = e.execute(f"EGET {rows[3][0]}")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id" in plan and f"(partition_id" in plan and "PartitionFilters: [" in plan
    plan = e.execute("ESCAN a 1 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stream_id,a)" in plan and "GreaterThanOrEqual(stream_version,1)" in plan
    assert "row_number" not in plan  # the watermarks come from the staged table
