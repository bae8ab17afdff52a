"""Appends as a stream: state per bucket, judged in order of arrival.

State: stream -> (key, version) and partition -> next sequence. Results of a
batch are written by ``foreachBatch`` and published by batch id, so a batch
that is replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomlog.operators.append import checked, fold_transaction

OUTPUT = "request_no bigint, partition_id int, stream_id string, status string, message string, stream_version bigint, partition_sequence bigint"
STATE = "streams string, sequences string"


def judge(requests: DataFrame, strict: bool = False, partitions: int = 32, buckets: int = 4) -> DataFrame:
    """A streaming DataFrame of requests to one of verdicts.

    Requests need request_no, stream_id, event_name, expected_version; those of
    one micro-batch are judged in order of request_no.
    """
    import json

    r = checked(requests, strict, partitions, buckets).select("bucket_id", "request_no", "partition_id", "stream_id", "partition_key", "expected_version", "error")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streams, sequences = ({}, {}) if not state.exists else (json.loads(x) for x in state.get)
        rows = pd.concat(list(batches)).sort_values("request_no")
        out = []
        for x in rows.itertuples(index=False):
            (verdict,), changed = fold_transaction(streams, [(x.stream_id, x.partition_key, x.expected_version, x.error)])
            streams.update(changed)
            sequence = None
            if verdict[0] == "OK":
                sequence = sequences.get(str(x.partition_id), 0)
                sequences[str(x.partition_id)] = sequence + 1
            out.append((x.request_no, x.partition_id, x.stream_id, *verdict, sequence))
        state.update((json.dumps(streams), json.dumps(sequences)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"stream_version": "Int64", "partition_sequence": "Int64"})

    return r.groupBy("bucket_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def publish(verdicts: DataFrame, path: str, checkpoint: str, **trigger: object):
    """Write accepted and refused requests, one directory per batch id; a replayed batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("accepted", F.col("status") == "OK").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return verdicts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
