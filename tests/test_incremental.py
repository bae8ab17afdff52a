"""Only what is new or changed, whatever failed before."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomlog.operators import incremental as inc

POINT = "consumer string, part int, seq bigint, version int"


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 1), st.integers(0, 25), st.sampled_from([1, 2, None]))), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 1), st.integers(0, 25), st.sampled_from([1, 2, None]))))
def test_subtract(spark, done, have):
    done = list({r[:3]: r for r in done}.values())
    have = list({r[:3]: r for r in have}.values())
    iv = inc.to_intervals(points(spark, done), block=8)
    covered = [r for r in iv.collect()]
    assert sum(r.hi - r.lo + 1 for r in covered) == len(done)
    got = sorted((r.consumer, r.part, r.seq) for r in inc.subtract(points(spark, have), iv, block=8).collect())
    old = {r[:3]: r[3] for r in done}
    assert got == sorted(r[:3] for r in have if r[:3] not in old or old[r[:3]] != r[3])


def test_nulls_empty_and_repeats(spark):
    rows = [(None, 1, 1, 1), ("a", None, 1, 1), ("a", 1, None, 1), ("a", 1, 3, 1), ("a", 1, 3, 1)]
    assert [(r.lo, r.hi) for r in inc.to_intervals(points(spark, rows)).collect()] == [(3, 3)]
    assert inc.subtract(points(spark, rows), points(spark, []).selectExpr("consumer", "part", "seq lo", "seq hi", "version")).count() == 1
    assert inc.to_intervals(points(spark, [])).count() == 0


def test_pending_rules(spark):
    d = [
        ("s", 0, 1, 0, 10, 2), ("s", 0, 2, 1, 11, 2), ("s", 0, 2, 5, 12, 2), ("s", 0, 3, 6, 13, 2), ("s", 0, 1, 7, 14, 3), ("s", 0, 4, 2, 15, 1), ("s", 0, 4, 8, 16, 3), ("s", 0, 4, 9, 17, 1),
        ("t", 0, 1, 0, 18, None), ("t", 0, 1, 0, 18, None), (None, 0, 1, 9, 19, 1), ("s", 0, 9, None, 20, 1),
    ]
    deliveries = spark.createDataFrame(d, "consumer string, part int, seq bigint, cursor bigint, tie bigint, version int")
    acks = spark.createDataFrame([("s", 3), ("s", 4), ("s", None), (None, 99)], "consumer string, cursor bigint")
    last = inc.last_copies(deliveries, acks)
    pending = inc.subtract(inc.available(last), inc.to_intervals(inc.processed(last)))
    got = sorted((r.consumer, r.seq) for r in pending.collect())
    # 2 was processed and sent again unchanged, 4 was confirmed further and back
    assert got == [("s", 1), ("s", 3), ("t", 1)]


def test_runs_survive_failures(spark, tmp_path):
    ledger = inc.RunLedger(spark, str(tmp_path / "ledger"))
    log = [("c", 0, i, 1) for i in (0, 1, 2, 5, 6)]
    assert ledger.output() is None

    def broken(df):
        df.count()
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        ledger.run(points(spark, log), broken)
    assert ledger.runs() == [] and ledger.intervals().count() == 0
    ledger.run(points(spark, log))
    late = log + [("c", 0, 3, 1), ("c", 0, 4, 1), ("c", 0, 7, 1)]
    late = [r if r[2] != 1 else ("c", 0, 1, 2) for r in late]
    ledger.run(points(spark, late))
    out = sorted((r.seq, r.version) for r in ledger.output().collect())
    assert out == [(0, 1), (1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)]
    assert sorted((r.lo, r.hi, r.version) for r in ledger.intervals().collect()) == [(0, 0, 1), (1, 1, 2), (2, 7, 1)]
    ledger.run(points(spark, late))
    assert ledger.output().count() == len(out)


STEPS = ["taken", "output", "ledger", "marker", "rename"]


@pytest.mark.parametrize("step", STEPS)
def test_a_crash_at_any_step_leaves_no_trace(spark, tmp_path, monkeypatch, step):
    ledger = inc.RunLedger(spark, str(tmp_path / "ledger"), block=4)
    one = [("c", 0, i, 1) for i in (0, 1, 5)]
    two = [*one[:2], ("c", 0, 5, 2), ("c", 0, 2, 1), ("c", 0, 9, 1)]
    ledger.run(points(spark, one))
    before = sorted(map(tuple, ledger.intervals().collect()))

    class Crash(Exception):
        pass

    with monkeypatch.context() as m:
        if step == "marker":  # died while the marker was written
            m.setattr(ledger.published, "publish", lambda number, folder: ((tmp_path / "ledger/published/_new-x").write_text(""), (_ for _ in ()).throw(Crash())))
        elif step == "rename":  # a file system that leaves an empty marker behind
            m.setattr(ledger.published, "publish", lambda number, folder: ((tmp_path / f"ledger/published/{number}").write_text(""), (_ for _ in ()).throw(Crash())))
        else:
            real = type(points(spark, []).write).parquet

            def write(self, path, *a, **k):
                if path.endswith(step):
                    raise Crash
                return real(self, path, *a, **k)

            m.setattr(type(points(spark, []).write), "parquet", write)
        with pytest.raises(Crash):
            ledger.run(points(spark, two))
    assert sorted(map(tuple, ledger.intervals().collect())) == before and ledger.output().count() == 3
    number = ledger.run(points(spark, two))
    assert sorted((r.seq, r.version) for r in ledger.output(number).collect()) == [(2, 1), (5, 2), (9, 1)]
    # intervals end at the borders of blocks of four
    assert sorted((r.lo, r.hi, r.version) for r in ledger.intervals().collect()) == [(0, 2, 1), (5, 5, 2), (9, 9, 1)]


def test_of_two_runs_with_one_number_one_wins(spark, tmp_path):
    ledger = inc.RunLedger(spark, str(tmp_path / "ledger"))

    def meanwhile(taken):
        inc.RunLedger(spark, str(tmp_path / "ledger")).run(points(spark, [("c", 0, 1, 1)]))
        return taken

    with pytest.raises(Exception, match="already exists"):
        ledger.run(points(spark, [("c", 0, 1, 1)]), meanwhile)
    assert ledger.output().count() == 1 and ledger.intervals().count() == 1
