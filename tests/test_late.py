"""Hourly counts corrected by late events, against a loop over the events."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.operators import late

SCHEMA = "key int, seq bigint, ts bigint"


def brute(rows, period, cut):
    by = defaultdict(dict)
    for k, s, t in rows:
        if k is not None and s is not None:
            by[k][s] = min([x for x in (by[k].get(s), t) if x is not None], default=None)
    counts, log, dropped = defaultdict(int), [], defaultdict(int)
    versions = defaultdict(int)
    for k, events in by.items():
        high = None
        for s in sorted(events):
            t = events[s]
            if t is None:
                continue
            p = t // period
            if high is None or p >= high // period:
                counts[k, p] += 1
            elif high - t <= cut:
                versions[k, p] += 1
                log.append((k, p, versions[k, p], s, counts[k, p], counts[k, p] + 1))
                counts[k, p] += 1
            else:
                dropped[k, p] += 1
            high = t if high is None else max(high, t)
    return counts, log, dropped


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 1, 2, None]), st.one_of(st.integers(0, 40), st.none()), st.one_of(st.integers(0, 120), st.none())), max_size=60))
def test_against_a_loop(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    counts, log, dropped = brute(rows, 10, 30)
    got = [tuple(r) for r in late.changelog(df, 10, 30, block=8).collect()]
    assert sorted(got) == sorted(log)
    state = {(r.key, r.period): (r["count"], r.dropped) for r in late.corrected_counts(df, 10, 30, block=8).collect()}
    assert state == {k: (counts.get(k, 0), dropped.get(k, 0)) for k in {*counts, *dropped}}
    # the deltas alone turn what was published into the corrected counts
    published = defaultdict(int)
    for r in late.classify(df, 10, 30, block=8).where("arrived = 'on_time'").collect():
        published[r.key, r.period] += 1
    for r in late.deltas(late.changelog(df, 10, 30, block=8)).collect():
        published[r.key, r.period] += r.sign * r["count"]
    assert dict(published) == {k: v for k, v in counts.items() if v}


def test_runs_continue_from_state(spark):
    rows = [(1, 0, 5), (1, 1, 25), (1, 2, 8), (1, 3, 47), (1, 4, 26), (1, 5, 9)]
    _, want, _ = brute(rows, 10, 30)
    first, second = rows[:3], rows[3:]
    a = late.changelog(spark.createDataFrame(first, SCHEMA), 10, 30)
    state = late.apply_deltas(
        late.classify(spark.createDataFrame(first, SCHEMA), 10, 30).where("arrived = 'on_time'").groupBy("key", "period").count().selectExpr("key", "period", "count", "0L version"), late.deltas(a), ["key", "period"]
    )
    highs = spark.createDataFrame([(1, 25)], "key int, high bigint")
    b = late.changelog(spark.createDataFrame(second, SCHEMA), 10, 30, highs, state)
    assert sorted(tuple(r) for r in a.union(b).collect()) == sorted(want)


def test_empty_and_extremes(spark):
    assert late.changelog(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, (1 << 63) - 1), (1, 1, 0), (1, 2, -5)]
    got = {r.seq: r.arrived for r in late.classify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: "on_time", 1: "dropped", 2: "dropped"}
