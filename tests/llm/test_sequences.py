"""Frequent subsequences: the reduction, the diagram, and the whole operator against brute force."""

import itertools
import sys
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.llm import sequences as S

sys.setrecursionlimit(100_000)
WORDS = st.lists(st.lists(st.integers(0, 5), max_size=9).map(tuple), min_size=1, max_size=14)


def subsequences(word, k):
    return {c for n in range(1, k + 1) for c in itertools.combinations(word, n)}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=16), st.integers(1, 4))
def test_reduction_keeps_all_short_subsequences(word, k):
    short = S.reduce_word(word, k)
    assert len(short) <= len(word)
    assert subsequences(short, k) == subsequences(word, k)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=10), st.lists(st.integers(0, 2), max_size=10))
def test_reduction_holds_under_concatenation(a, b):
    assert subsequences(S.reduce_word(S.reduce_word(a, 3) + S.reduce_word(b, 3), 3), 3) == subsequences(a + b, 3)


def test_a_long_word_becomes_short():
    word = [i * 7919 % 30 for i in range(50_000)]
    assert len(S.reduce_word(word, 4)) < 600


def brute(words, least, longest):
    n = Counter()
    for w in words:
        n.update({p for p in subsequences(w, longest) if len(set(p)) == len(p)})
    return {p: c for p, c in n.items() if c >= least}


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(1, 4), st.integers(1, 4))
def test_diagram_mines_and_counts(words, least, longest):
    d = S.Diagram()
    root = d.build(sorted(Counter(words).items()))
    assert d.weight[root] == len(words)
    want = brute(words, least, longest)
    assert S.mine(d, root, least, longest) == want
    patterns = sorted({p for w in words for p in itertools.permutations(sorted(set(w)), min(3, len(set(w)))) if p})
    assert S.count(d, root, patterns) == {p: brute(words, 1, 3).get(p, 0) for p in patterns}


SCHEMA = "part int, stream string, version bigint, seq bigint, label string, block string"


def test_operator_in_blocks_and_shards(spark):
    rows, words, seq = [], {}, 0
    for i in range(60):
        word = [chr(97 + (i * j * 7 + j * j + i) % 6) for j in range(3 + i % 12)] if i else [chr(97 + j * 13 % 5) for j in range(300)]
        words[i] = word
        for v, x in enumerate(word):
            rows.append((i % 3, f"s{i}", v, seq, x, "clash"))
            seq += 1
    rows += rows[::7]  # exported twice
    rows += [(1, "untyped", 0, seq, None, ""), (None, "s", 0, 1, "a", ""), (1, None, 0, 1, "a", ""), (1, "z", None, 1, "a", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    w = S.words(df, ["part", "stream"], 4, block=16)
    assert w.count() == 61
    got = {tuple(r.pattern): r.support for r in S.frequent(w, 0.3, 4, 4, shard=8).collect()}
    assert got == brute(words.values(), max(4, -(-61 * 3 // 10)), 4)


def test_empty_ties_and_long_labels(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.frequent(S.words(df, ["part", "stream"]), 0.1, 1, 3).count() == 0
    long = "x" * 50_000
    rows = [(1, s, 0, i, lab, "") for s in "ab" for i, lab in ((0, long), (1, "y"))]  # ties in version fall to seq
    got = {tuple(r.pattern): r.support for r in S.frequent(S.words(spark.createDataFrame(rows, SCHEMA), ["part", "stream"]), 0.5, 2, 3).collect()}
    assert got == {(long,): 2, ("y",): 2, (long, "y"): 2}
