"""Packing and mixing: every item in its place, shares reached, caps kept."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.llm import mixing as M
from loomlog.llm import packing as P
from loomlog.llm import tokens as T

BUDGET = "budget_name string, capacity_tokens int"


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 40), min_size=1), st.integers(20, 50))
def test_plan_places_every_item_once(histogram, capacity):
    used, ranks = Counter(), {n: set() for n in histogram}
    spans = {}
    for length, rank, n, first, each, offset in P.plan(histogram, capacity):
        for r in range(rank, rank + n):
            k = r - rank
            c, at = first + k // each, offset + k % each * length
            assert r not in ranks[length]
            ranks[length].add(r)
            used[c] += length
            spans.setdefault(c, []).append((at, at + length))
    assert all(len(ranks[n]) == c for n, c in histogram.items())
    assert max(used.values()) <= capacity and set(used) == set(range(len(used)))
    for s in spans.values():
        s.sort()
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    total = sum(n * c for n, c in histogram.items())
    # no two containers are half empty: best fit would have joined them
    assert len(used) <= 2 * -(-total // capacity) + 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 70)), max_size=40))
def test_pack(spark, sizes):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, size string")
    budgets = spark.createDataFrame([("a", 16), ("b", 64), (None, 8), ("c", 0), ("d", None)], BUDGET)
    rows = P.pack(df, budgets, block_rows=4).collect()
    for name, cap in (("a", 16), ("b", 64)):
        own = [r for r in rows if r.budget_name == name]
        by = Counter()
        for r in own:
            by[r.doc_id] += r.n_tokens
            assert (r.container_no is None) == (r.n_tokens == 0)
        assert by == {i: n or 0 for i, n in enumerate(sizes)} or not sizes
        room = Counter()
        for r in own:
            if r.container_no is not None:
                room[r.container_no] += r.n_tokens
        assert all(v <= cap for v in room.values())
        pieces = Counter(r.doc_id for r in own)
        assert all(pieces[i] == max(1, -(-(n or 0) // cap)) for i, n in enumerate(sizes))
    assert {r.budget_name for r in rows} <= {"a", "b"}


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert P.pack(df, spark.createDataFrame([("a", 4)], BUDGET)).count() == 0
    assert P.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint"), spark.createDataFrame([], BUDGET)).count() == 0


def test_tokens_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "one two", "k"), (4, "ab " * 200_000, "k"), (5, "<|endoftext|>", "k")], "doc_id int, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in T.with_tokens(docs).collect()}
    texts = ["", "", "one two", "ab " * 200_000, "<|endoftext|>"]
    assert list(got.values()) == T.counter(T.VOCABULARY)(texts) and got[3] == 2 and got[4] > 200_000 and got[5] > 1


def test_both_vocabulary_formats_agree():
    texts = ["It’s naïve — isn't it?  \n\n  x\t", "Почему 123 кран", "日本語のテスト。", "   ", "a" * 5000, "=" * 300 + "\r\n"]
    other = T.VOCABULARY.rpartition(".")[0] + ".json"
    assert T.counter(T.VOCABULARY)(texts) == T.counter(other)(texts)


TARGET = "source string, target_share double, max_repeats int"
DOC = "doc_id bigint, source string, n_tokens bigint"


def test_mix_reaches_shares_and_keeps_caps(spark):
    rows = [(i, ["Big_One", "big-one", " BIG ONE "][i % 3], 5 + i % 40) for i in range(3000)] + [(i, "small", 10) for i in range(3000, 3050)]
    rows += [(9000, None, 10), (9001, "other", 10), (9002, "small", 0), (9003, "small", None)]
    rows += rows[:10]  # repeated rows
    targets = spark.createDataFrame([("big-one", 0.75, 1), ("small", 0.25, 4), ("gone", 0.0, 2)], TARGET)
    chosen, goals = M.mix(spark.createDataFrame(rows, DOC), targets)
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got)
    assert max(r.copies for r in got if r.source == "small") <= 4 and max(r.copies for r in got if r.source == "big-one") == 1
    assert {r.source for r in got} == {"big-one", "small"}
    report = {r.source: r for r in M.shares(chosen, goals).collect()}
    assert abs(report["big-one"].reached_share - 0.75) < 0.005 and abs(report["small"].reached_share - 0.25) < 0.005
    for r in M.check(chosen, goals, spark.createDataFrame(rows, DOC)).where("source <> 'gone'").collect():
        assert (r.caps_kept, r.once_each, r.not_exceeded, r.undrawn_that_fit) == (True, True, True, 0), r
    again = M.mix(spark.createDataFrame(rows[::-1], DOC), targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_unequal_weights(spark):
    df = spark.createDataFrame([(i, "s", 10, 4.0 if i % 2 else 1.0) for i in range(4000)], DOC + ", weight double")
    chosen, _ = M.mix(df, spark.createDataFrame([("s", 1.0, 1)], TARGET), total_tokens=10_000)
    odd = [r.doc_id % 2 for r in chosen.collect()]
    assert abs(len(odd) - 1000) <= 1 and 0.72 < sum(odd) / len(odd) < 0.88


def test_the_gap_before_a_long_document_is_filled(spark):
    """The first document that does not fit is a giant: many short ones take what it leaves."""
    rows = [(i, "s", 100_000 if i % 3 == 0 else 700 + i) for i in range(60)]
    docs = spark.createDataFrame(rows, DOC)
    for seed in range(3):
        chosen, goals = M.mix(docs, spark.createDataFrame([("s", 1.0, 1)], TARGET), total_tokens=130_000, seed=seed)
        got = sum(r.copies * r.n_tokens for r in chosen.collect())
        assert 129_000 < got <= 130_000, (seed, got)
        assert M.check(chosen, goals, docs).first().undrawn_that_fit == 0


def test_mix_nothing(spark):
    none = spark.createDataFrame([], DOC)
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGET)
    chosen, goals = M.mix(none, targets)
    assert chosen.count() == 0 and M.shares(chosen, goals).first().reached_share is None
    assert M.mix(spark.createDataFrame([(1, "a", 5)], DOC), targets.limit(0))[0].count() == 0
