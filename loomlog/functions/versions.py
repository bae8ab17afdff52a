"""Algebra of expected and current versions.

An expectation is a string (``any``, ``exists``, ``empty`` or a number), a
current version a nullable BIGINT, null for a stream without events.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse(text: Column | str) -> Column:
    """Canonical expectation of a command's text (any case); null if it is none."""
    s = F.lower(F.trim(_c(text)))
    number = F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint"))
    return F.when(s.isin("any", "exists", "empty"), s).when(number.isNotNull(), number.cast("string"))


def exact(expected: Column | str) -> Column:
    return _c(expected).try_cast("bigint")


def from_next(n: Column | str) -> Column:
    """What a writer expects that wants its event to get version ``n``."""
    return F.when(_c(n) == 0, "empty").when(_c(n) > 0, (_c(n) - 1).cast("string"))


def into_next(expected: Column | str) -> Column:
    """The version an accepted event gets; null for any and exists, which do not say."""
    return F.when(_c(expected) == "empty", F.lit(0).cast("bigint")).otherwise(exact(expected) + 1)


def gap(expected: Column | str, current: Column | str) -> Column:
    """struct<kind, n>: none, ahead (the store is further), behind, or incompatible."""
    e, c, x = _c(expected), _c(current), exact(expected)

    def out(kind: str, n: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (n if n is not None else F.lit(None)).cast("bigint").alias("n"))

    return (
        F.when(e == "any", out("none"))
        .when(e == "exists", F.when(c.isNull(), out("incompatible")).otherwise(out("none")))
        .when(e == "empty", F.when(c.isNull(), out("none")).otherwise(out("ahead", c + 1)))
        .when(x.isNotNull(), F.when(c.isNull(), out("behind", x + 1)).when(x > c, out("behind", x - c)).when(x < c, out("ahead", c - x)).otherwise(out("none")))
    )


def satisfied(expected: Column | str, current: Column | str) -> Column:
    return gap(expected, current)["kind"] == "none"


def sequence_gap(expected: Column | str, next_sequence: Column | str) -> Column:
    """The same rule over a partition: its next sequence is one past its current one, 0 for none."""
    n = _c(next_sequence)
    return gap(expected, F.when(n > 0, n - 1))


def strict(expected: Column | str) -> Column:
    """Whether strict mode lets an expectation pass."""
    return _c(expected).isNotNull() & ~_c(expected).isin("any", "exists")


def next_of(current: Column | str) -> Column:
    return F.coalesce(_c(current) + 1, F.lit(0)).cast("bigint")


def as_expected(current: Column | str) -> Column:
    return F.coalesce(_c(current).cast("string"), F.lit("empty"))


def advance(current: Column | str, n: Column | int) -> Column:
    """The current version after ``n`` more events; unchanged for none."""
    k = n if isinstance(n, Column) else F.lit(n)
    return F.when(k > 0, F.coalesce(_c(current), F.lit(-1)) + k).otherwise(_c(current)).cast("bigint")


def gap_of(expected: str, current: int | None) -> tuple[str, int | None]:
    """The same rule for plain values."""
    if expected == "any":
        return "none", None
    if expected == "exists":
        return ("incompatible", None) if current is None else ("none", None)
    if expected == "empty":
        return ("none", None) if current is None else ("ahead", current + 1)
    e = int(expected)
    if current is None:
        return "behind", e + 1
    return ("none", None) if e == current else ("behind", e - current) if e > current else ("ahead", current - e)
