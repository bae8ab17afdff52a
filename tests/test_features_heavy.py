"""Feature rows and per-key results."""

from collections import defaultdict
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.operators import features, heavy

EVENT = "part int, stream string, event_type string, ts bigint, amount decimal(28,6), n string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], EVENT)


def test_features(spark):
    rows = [(1, "a", "x", 5, Decimal("1.5")), (1, "a", "x", 7_200_000_000_001, Decimal("2")), (1, "a", "y", None, None), (1, "b", None, 3, None), (None, "a", "x", 1, None), (2, "a", "x", 9, None)]
    got = {(r.part, r.stream): r.asDict() for r in features.features(events(spark, rows), ["part", "stream"], ["x", "y", "z"]).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a")}
    assert set(got[1, "b"].values()) == {1, "b", 0, None, 0.0}  # an entity without a known type
    a = got[1, "a"]
    assert (a["x_n"], a["x_last_ns"], a["x_amount"]) == (2, 7_200_000_000_001, 3.5)
    assert (a["y_n"], a["y_last_ns"], a["y_amount"]) == (1, None, 0.0)
    assert (a["z_n"], a["z_last_ns"], a["z_amount"]) == (0, None, 0.0)
    assert features.features(events(spark, []), ["part", "stream"], ["x"]).count() == 0


def held(store):
    return {r.bucket: r.run for r in store.manifest().collect()}


def test_store_recomputes_changed_buckets_only(spark, tmp_path):
    old = [(1, "a", "x", 1, Decimal(1)), (1, "a", "x", 11, Decimal(2)), (1, "a", "x", 25, Decimal(4)), (1, "a", "z", None, Decimal(1)), (1, "a", "x", -1, None)]
    store = features.FeatureStore(spark, str(tmp_path / "f"), ["part", "stream"], bucket_ns=10)
    store.refresh(events(spark, old))
    before = held(store)
    assert set(before) == {-1, 0, 1, 2, features.UNTIMED}
    new = (1, "a", "y", 12, Decimal(8))
    store.refresh(events(spark, [*old, new]), changed=events(spark, [new]))
    assert {b: r for b, r in held(store).items() if b != 1} == {b: r for b, r in before.items() if b != 1} and held(store)[1] != before[1]
    r = store.read(["x", "y", "z"]).first()
    assert (r.x_n, r.x_amount, r.y_n, r.y_last_ns, r.z_n, r.z_last_ns) == (4, 7.0, 1, 12, 1, None)
    for start, end in ((5, 25), (12, 13), (None, 12), (11, None), (0, 20), (13, 15)):
        cut = store.read(["x", "y"], start, end, edges=events(spark, [*old, new])).collect()
        assert cut == features.features(events(spark, [*old, new]), ["part", "stream"], ["x", "y"], start, end).collect(), (start, end)


def test_a_moved_event_leaves_no_trace(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path / "f"), ["part", "stream"], bucket_ns=10)
    store.refresh(events(spark, [(1, "a", "x", 5, Decimal(1))]))
    assert store.refresh(events(spark, [(1, "a", "x", 55, Decimal(1))]), changed=spark.createDataFrame([(5,), (55,)], "ts bigint")) == 1
    assert set(held(store)) == {5} and store.read(["x"]).first().x_n == 1
    store.refresh(events(spark, []), changed=spark.createDataFrame([(55,)], "ts bigint"))
    assert held(store) == {} and store.read(["x"]).count() == 0
    assert store.refresh(events(spark, []), changed=spark.createDataFrame([], "ts bigint")) == 3


def test_files_of_a_bucket_are_few(spark, tmp_path):
    store = features.FeatureStore(spark, str(tmp_path / "f"), ["part", "stream"], bucket_ns=10)
    store.refresh(spark.range(2000).selectExpr("1 part", "concat('s', id) stream", "'x' event_type", "id % 50 ts", "cast(1 as decimal(28,6)) amount", "'' n").repartition(16))
    files = [len(list(d.glob("*.parquet"))) for d in (tmp_path / "f" / "data").glob("run=*/bucket=*")]
    assert len(files) == 5 and max(files) <= 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["k1", "k2", "k3", None, ""]), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(-5, 5))), max_size=40))
def test_dense_accumulators(spark, rows):
    df = spark.createDataFrame(rows, "a string, b int, ts bigint")
    want = defaultdict(lambda: [0, []])
    for a, b, t in rows:
        for f, v in (("a", a), ("b", None if b is None else str(b))):
            if v is not None:
                want[f, v][0] += 1
                want[f, v][1] += [t] * (t is not None)
    got = {(r.key_field, r.key_value): (r.n, r.first, r.last) for r in heavy.per_key(df, ["a", "b"], "ts").collect()}
    assert got == {k: (n, min(t, default=None), max(t, default=None)) for k, (n, t) in want.items()}


def test_arrays_grow_and_flush(spark):
    df = spark.range(20_000).selectExpr("cast(id % 7000 as string) k", "id ts")
    few = heavy.dense_partials(df, ["k"], "ts", limit=100).groupBy("key_value").sum("n")
    assert few.count() == 7000 and few.agg({"sum(n)": "sum"}).first()[0] == 20_000
