"""Copies of messages: one of each stays."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.operators import dedupe

SCHEMA = "row_no bigint, sub string, uid string, cursor bigint, _rank string, extra string"
ID, ARRIVAL = ["sub", "uid"], ["cursor", "row_no"]


def brute(rows):
    best = {}
    for r in rows:
        if r[1] is None or r[2] is None:
            continue
        k = (r[3] is None, r[3] or 0, r[0])
        if (r[1], r[2]) not in best or k < best[r[1], r[2]][0]:
            best[r[1], r[2]] = (k, r[0])
    kept = {v[1] for v in best.values()}
    return {r[0] for r in rows if r[1] is not None and r[2] is not None and r[0] not in kept}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", "z", None]), st.one_of(st.none(), st.integers(0, 3))), max_size=30))
def test_surplus_is_all_but_first(spark, data):
    rows = [(i, *r, "name clash", "e") for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r[0] for r in dedupe.surplus_copies(df, ID, ARRIVAL, "row_no").collect()]
    assert sorted(got) == sorted(brute(rows))
    kept = dedupe.first_copies(df.drop("_rank"), ID, ARRIVAL)
    assert sorted(r[0] for r in kept.select("row_no").collect()) == sorted({r[0] for r in rows} - brute(rows))


def test_repeated_rows_and_long_identifiers(spark):
    long = "u" * 100_000
    df = spark.createDataFrame([(1, "a", long, 0), (1, "a", long, 0), (2, "a", long, 0)], "row_no bigint, sub string, uid string, cursor bigint")
    assert dedupe.first_copies(df, ID, ARRIVAL).count() == 1
    assert [r[0] for r in dedupe.surplus_copies(df, ID, ARRIVAL, "row_no").collect()] == [2]


def test_hot_group_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id row_no", "cast(id % 1 as string) sub", "cast(id % 1 as string) uid", "id cursor")
    plan = dedupe.first_copies(df, ID, ARRIVAL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert dedupe.surplus_copies(df, ID, ARRIVAL, "row_no").count() == 999


def test_batches_against_store(spark):
    batch = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "x", 4), (3, "a", "y", 1), (4, None, "y", 1)], "row_no bigint, sub string, uid string, cursor bigint")
    seen = spark.createDataFrame([("a", "y"), ("a", "y")], "sub string, uid string")
    assert sorted(r[0] for r in dedupe.only_unseen(batch, seen, ID, ARRIVAL).select("row_no").collect()) == [2, 4]
    assert dedupe.only_unseen(batch.limit(0), seen, ID, ARRIVAL).count() == 0
