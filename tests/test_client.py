"""The client's methods, subscriptions with acks, and stored watermarks."""

import pytest

from loomlog.client import Client
from loomlog.config import LogConfig
from loomlog.engine import Engine
from loomlog.errors import EngineError
from loomlog.operators import append, confirm
from test_engine import B, COMMIT, make


def test_client(spark, tmp_path):
    df, rows = make(spark, n=10)
    engine = Engine.open(spark, str(tmp_path / "log"), LogConfig())
    engine.store.load(df, spark.createDataFrame([], COMMIT))
    client = Client(Engine.open(spark, str(tmp_path / "log"), LogConfig()))
    key, p = rows[0][1], rows[0][2]
    assert client.escan("a", count=2).first().has_more
    assert client.escan_with_partition_key("a", key).first().events[4].stream_version == 4
    assert client.esver("a").first()[0] == client.esver_with_partition_key("a", key).first()[0] == 4
    assert client.epseq_by_id(p).first().partition_sequence == client.epseq_by_key(key).first().partition_sequence == 4
    assert client.eappend("a", "N", expected_version=4, payload=b"x").first().stream_version == 5
    got = client.emappend(key, [("a", "N", {"expected_version": 5}), ("new", "M", {"expected_version": "empty"})]).collect()
    assert [(r.stream_id, r.stream_version, r.partition_sequence, r.first_partition_sequence, r.last_partition_sequence) for r in got] == [("a", 6, 6, 6, 7), ("new", 0, 7, 6, 7)]
    with pytest.raises(EngineError):
        client.emappend(key, [("a", "N", {"expected_version": 4}), ("new", "M", {"expected_version": 3})])
    first = client.esub_from_versions({"a": 1, B: 0}, window=3).collect()
    assert [r.cursor for r in sorted(first, key=lambda r: r.cursor)] == [0, 1, 2]
    s = first[0].subscription_id
    assert client.eack(s, 1).first()[0] == 1 and client.eack(s, 0).first()[0] == 1
    assert sorted(r.cursor for r in client.engine.next_records(s).collect()) == [2, 3, 4]
    client.engine.unsubscribe(s)
    with pytest.raises(EngineError) as e:
        client.eack(s, 2)
    assert e.value.code == "NOTFOUND"
    assert client.epsub_from_sequences({p: 3}, default=0).count() == 10
    assert client.epsub_all().count() == 0


def test_subscriptions_of_a_client(spark, tmp_path):
    df, rows = make(spark, n=10)
    client = Client(Engine.open(spark, str(tmp_path / "log"), LogConfig(strict_versioning=False)))
    client.engine.store.load(df, spark.createDataFrame([], COMMIT))
    client.engine._refresh()
    m = client.manager()
    live, some = m.subscribe_to_all_partitions(), m.subscribe_to_stream("a", from_version=3, window=1)
    assert live.next_message() is None
    assert [(x.cursor, x.stream_version) for x in some] == [(0, 3)]
    some.acknowledge_up_to_cursor(0)
    assert [(x.cursor, x.stream_version) for x in some] == [(1, 4)] and some.next_message() is None
    client.eappend("a", "N")
    assert [(x.stream_id, x.stream_version, x.cursor) for x in live] == [("a", 5, 0)]
    p = rows[0][2]
    assert len(list(m.subscribe_to_partition(rows[0][1], from_sequence=4))) == 2
    assert len(list(m.subscribe_to_partitions([p, rows[1][2]], from_sequences={p: 5}, fallback=0))) == 6
    assert len(list(m.subscribe_to_partition_range(0, 31, from_sequence=0))) == 11
    assert len(list(m.subscribe_to_streams(["a", B], from_versions={"a": 0}))) == 6
    live.unsubscribe()
    with pytest.raises(EngineError):
        live.next_message()


def test_watermark_snapshots(spark, tmp_path):
    s = confirm.Snapshots(spark, str(tmp_path / "w"))
    assert s.load() is None
    marks = spark.createDataFrame([(1, 5, 9), (2, 3, 3)], confirm.MARKS)
    s.save(marks)
    s.save(spark.createDataFrame([(1, 4, 10)], confirm.MARKS))
    assert sorted(tuple(r) for r in s.load().collect()) == [(1, 5, 10), (2, 3, 3)]


def test_size_of_transactions(spark):
    r = spark.createDataFrame([(1, 100), (1, None), (2, 10)], "tx_no bigint, n_bytes bigint")
    assert [tuple(x) for x in append.too_large(r, 200).collect()] == [(1, 228)]
