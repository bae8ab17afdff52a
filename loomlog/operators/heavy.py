"""Per-key results when a few keys hold most of the records.

Every task takes an equal split of the rows whatever their keys are, encodes
the keys of each batch as dense codes and scatters counts and extremes into
arrays indexed by code. Only the arrays travel: a key costs at most one row per
task however many records it has, and equal keys are reduced afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = "key_field string, key_value string, n bigint, first bigint, last bigint"
_MIN, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class _Dense:
    """Accumulator arrays of one field, grown as its dictionary grows; flushed at ``limit`` keys."""

    def __init__(self, field: str):
        self.field = field
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.n, self.first, self.last = np.zeros(1024, np.int64), np.full(1024, _MAX), np.full(1024, _MIN)

    def add(self, values: pa.Array, ts: np.ndarray, timed: np.ndarray) -> None:
        enc = pc.dictionary_encode(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
        code = self.code
        own = np.fromiter((code.setdefault(v, len(code)) for v in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
        while len(self.n) < len(code):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
            self.first = np.concatenate([self.first, np.full_like(self.first, _MAX)])
            self.last = np.concatenate([self.last, np.full_like(self.last, _MIN)])
        known = np.asarray(enc.indices.is_valid())
        local = enc.indices.fill_null(0).to_numpy(zero_copy_only=False)
        # reduced over the batch's own codes first: the arrays of the task are touched once per key
        self.n[own] += np.bincount(local[known], minlength=len(own)) if len(own) else 0
        use = known & timed
        low, high = np.full(len(own), _MAX), np.full(len(own), _MIN)
        np.minimum.at(low, local[use], ts[use])
        np.maximum.at(high, local[use], ts[use])
        self.first[own] = np.minimum(self.first[own], low)
        self.last[own] = np.maximum(self.last[own], high)

    def rows(self) -> pa.RecordBatch:
        k = len(self.code)
        has = self.first[:k] <= self.last[:k]
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.field] * k, pa.string()), pa.array(list(self.code), pa.string()), pa.array(self.n[:k]), pa.array(self.first[:k], mask=~has), pa.array(self.last[:k], mask=~has)],
            ["key_field", "key_value", "n", "first", "last"],
        )
        self.clear()
        return out


def dense_partials(df: DataFrame, fields: list[str], ts: str, limit: int = 200_000) -> DataFrame:
    """Per task and key: (key_field, key_value, n, first, last) of the rows it read.

    Null key values belong to no key; null timestamps count but have no part in
    first and last. ``limit`` keys in memory bound a task; beyond it the arrays
    are emitted and begun anew, which changes nothing in the sums.
    """
    typed = df.select(*[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)], F.col(ts).cast("bigint").alias("_ts"))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [_Dense(f) for f in fields]
        for b in batches:
            at = b.column(b.num_columns - 1)
            timed = np.asarray(at.is_valid())
            when = at.fill_null(0).to_numpy(zero_copy_only=False)
            for i, d in enumerate(dense):
                d.add(b.column(i), when, timed)
                if len(d.code) > limit:
                    yield d.rows()
        for d in dense:
            yield d.rows()

    return typed.mapInArrow(scatter, PARTIAL)


def per_key(df: DataFrame, fields: list[str], ts: str) -> DataFrame:
    """Count, first and last timestamp per value of each field; one row per (key_field, key_value)."""
    return dense_partials(df, fields, ts).groupBy("key_field", "key_value").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
