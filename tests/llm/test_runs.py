"""Runs: the segmentation against brute force, and blocks against one piece."""

import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.llm import runs as R

NEAR = {("a", "b"): 0.2}


def dist(x, c, near):
    return 0.0 if x == c else near.get((x, c), near.get((c, x), 1.0))


def cost(labels, cuts, penalty, near):
    total, names = 0.0, sorted(set(labels))
    bounds = [0, *cuts, len(labels)]
    for a, b in itertools.pairwise(bounds):
        total += min(sum(dist(x, c, near) for x in labels[a:b]) for c in names)
    return total + penalty * len(cuts)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.sampled_from([0.25, 0.6, 1.5]), st.booleans())
def test_cheapest(labels, penalty, with_near):
    near = NEAR if with_near else {}
    best = min(cost(labels, cuts, penalty, near) for n in range(len(labels)) for cuts in itertools.combinations(range(1, len(labels)), n))
    table = {"a": {"b": 0.2}, "b": {"a": 0.2}} if with_near else {}
    found = R.segment(labels, penalty, (lambda x: table.get(x, {})) if with_near else None)
    assert [f[1] for f in found] == [0, *[f[2] + 1 for f in found[:-1]]] and found[-1][2] == len(labels) - 1
    got = sum(dist(labels[i], c, near) for c, a, b in found for i in range(a, b + 1)) + penalty * (len(found) - 1)
    assert abs(got - best) < 1e-9


SCHEMA = "part int, stream string, version bigint, seq bigint, ts bigint, label string, run string"


def brute(rows):
    by = {}
    for p, s, v, q, t, x, _ in rows:
        if None not in (p, s, v):
            by.setdefault((p, s), {})[v, q] = (t, x)
    out = []
    for k, events in by.items():
        cur = None
        for (v, _), (t, x) in sorted(events.items()):
            if x is not None and cur and cur["x"] == x and v - cur["b"] <= 1:
                cur["b"], cur["n"] = v, cur["n"] + 1
                cur["t"].append(t)
            else:
                if cur:
                    out.append((*k, cur))
                cur = None if x is None else {"x": x, "a": v, "b": v, "n": 1, "t": [t]}
        if cur:
            out.append((*k, cur))
    return sorted((p, s, c["x"], c["a"], c["b"], c["n"]) for p, s, c in out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, None]), st.sampled_from(["s", "t"]), st.one_of(st.none(), st.integers(0, 40)), st.sampled_from(["a", "a", "b", None])), max_size=60))
def test_blocks_are_stitched(spark, data):
    seen = {}
    for p, s, v, x in data:
        seen.setdefault((p, s, v), x)
    rows = [(p, s, v, i, i if i % 5 else None, x, "clash") for i, ((p, s, v), x) in enumerate(seen.items())]
    df = spark.createDataFrame(rows + rows[::3], SCHEMA)
    got = sorted((r.part, r.stream, r.label, r.first_version, r.last_version, r.n) for r in R.collapse(df, ["part", "stream"], block=8).collect())
    assert got == brute(rows)


def test_one_run_over_many_blocks(spark):
    df = spark.range(1000).selectExpr("1 part", "'s' stream", "id version", "id seq", "id * 10 ts", "'a' label", "'' run")
    r = R.collapse(df, ["part", "stream"], block=16).collect()
    assert [(x.first_version, x.last_version, x.n, x.duration) for x in r] == [(0, 999, 1000, 9990)]


def test_near_identical_events_join(spark):
    rows = [(1, "s", i, i, i, x, "") for i, x in enumerate("aaabaaccc")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.label, r.n) for r in R.collapse(df, ["part", "stream"], penalty=0.6).orderBy("first_version").collect()]
    assert got == [("a", 6), ("c", 3)]
    assert R.collapse(df.limit(0), ["part", "stream"]).count() == 0
