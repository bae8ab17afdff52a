"""A client's methods, each one command to an engine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loomlog.engine import Engine


def _words(**options: object) -> list[str]:
    return [w for k, v in options.items() if v is not None for w in (k.upper(), v.decode() if isinstance(v, bytes) else str(v))]


class Client:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _run(self, *words: object) -> DataFrame:
        return self.engine.execute([str(w) for w in words])

    def eappend(self, stream_id: str, event_name: str, **options: object) -> DataFrame:
        """Options: event_id, partition_key, expected_version, timestamp, payload, metadata."""
        return self._run("EAPPEND", stream_id, event_name, *_words(**options))

    def emappend(self, partition_key: str, events: Iterable[tuple[str, str, dict]]) -> DataFrame:
        """``events``: (stream id, event name, options); all are appended or none."""
        return self._run("EMAPPEND", partition_key, *[w for s, n, o in events for w in (s, n, *_words(**o))])

    def eget(self, event_id: str) -> DataFrame:
        return self._run("EGET", event_id)

    def escan(self, stream_id: str, start: object = "-", end: object = "+", count: int | None = None) -> DataFrame:
        return self._run("ESCAN", stream_id, start, end, *_words(count=count))

    def escan_with_partition_key(self, stream_id: str, partition_key: str, start: object = "-", end: object = "+", count: int | None = None) -> DataFrame:
        return self._run("ESCAN", stream_id, start, end, *_words(partition_key=partition_key, count=count))

    def epscan_by_id(self, partition_id: int, start: object = "-", end: object = "+", count: int | None = None) -> DataFrame:
        return self._run("EPSCAN", partition_id, start, end, *_words(count=count))

    def epscan_by_key(self, partition_key: str, start: object = "-", end: object = "+", count: int | None = None) -> DataFrame:
        return self._run("EPSCAN", partition_key, start, end, *_words(count=count))

    def esver(self, stream_id: str) -> DataFrame:
        return self._run("ESVER", stream_id)

    def esver_with_partition_key(self, stream_id: str, partition_key: str) -> DataFrame:
        return self._run("ESVER", stream_id, "PARTITION_KEY", partition_key)

    def epseq_by_id(self, partition_id: int) -> DataFrame:
        return self._run("EPSEQ", partition_id)

    def epseq_by_key(self, partition_key: str) -> DataFrame:
        return self._run("EPSEQ", partition_key)

    def esub(self, *stream_ids: str, window: int | None = None) -> DataFrame:
        return self._run("ESUB", *stream_ids, *_words(window=window))

    def esub_with_partition_key(self, stream_id: str, partition_key: str, window: int | None = None) -> DataFrame:
        return self._run("ESUB", stream_id, "PARTITION_KEY", partition_key, *_words(window=window))

    def esub_from_version(self, stream_id: str, version: int, window: int | None = None) -> DataFrame:
        return self._run("ESUB", stream_id, "FROM", version, *_words(window=window))

    def esub_with_partition_and_version(self, stream_id: str, partition_key: str, version: int, window: int | None = None) -> DataFrame:
        return self._run("ESUB", stream_id, "PARTITION_KEY", partition_key, "FROM", version, *_words(window=window))

    def esub_from_versions(self, versions: dict[str, int], window: int | None = None) -> DataFrame:
        return self._run("ESUB", *versions, "FROM", "MAP", *[f"{s}={v}" for s, v in versions.items()], *_words(window=window))

    def epsub_all(self, start: object = "LATEST", window: int | None = None) -> DataFrame:
        return self._run("EPSUB", "*", "FROM", start, *_words(window=window))

    def epsub_by_id(self, *partition_ids: int, window: int | None = None) -> DataFrame:
        return self._run("EPSUB", ",".join(map(str, partition_ids)), *_words(window=window))

    def epsub_by_key(self, partition_key: str, window: int | None = None) -> DataFrame:
        return self._run("EPSUB", partition_key, *_words(window=window))

    def epsub_by_id_from_sequence(self, partition_id: int, sequence: int, window: int | None = None) -> DataFrame:
        return self._run("EPSUB", partition_id, "FROM", sequence, *_words(window=window))

    def epsub_by_key_from_sequence(self, partition_key: str, sequence: int, window: int | None = None) -> DataFrame:
        return self._run("EPSUB", partition_key, "FROM", sequence, *_words(window=window))

    def epsub_from_sequences(self, sequences: dict[int, int], default: int | None = None, window: int | None = None) -> DataFrame:
        return self._run("EPSUB", "*", "FROM", "MAP", *[f"{p}={n}" for p, n in sequences.items()], *_words(default=default, window=window))

    def eack(self, subscription_id: str, cursor: int) -> DataFrame:
        return self._run("EACK", subscription_id, cursor)

    def hello(self, version: int = 3) -> DataFrame:
        return self._run("HELLO", version)

    def ping(self) -> DataFrame:
        return self._run("PING")

    def manager(self) -> SubscriptionManager:
        return SubscriptionManager(self)


#: Records that a subscription fetches at once.
PAGE = 1000


class Subscription:
    """An open subscription: its messages in order, acknowledged by cursor. It follows what is appended to the log."""

    def __init__(self, client: Client, subscription_id: str):
        self.client, self.subscription_id = client, subscription_id
        self._delivered, self._page = -1, iter(())

    def next_message(self) -> Row | None:
        """The next record with its cursor; None while nothing more may be sent: all was, or the window is full."""
        row = next(self._page, None)
        if row is None:
            more = self.client.engine.next_records(self.subscription_id).where(F.col("cursor") > self._delivered)
            self._page = iter(more.orderBy("cursor").limit(PAGE).collect())
            row = next(self._page, None)
        if row is not None:
            self._delivered = row["cursor"]
        return row

    def __iter__(self) -> Iterator[Row]:
        """Messages until nothing more may be sent."""
        return iter(self.next_message, None)

    def acknowledge_up_to_cursor(self, cursor: int) -> int:
        return self.client.engine.acknowledge(self.subscription_id, cursor)

    def unsubscribe(self) -> None:
        self.client.engine.unsubscribe(self.subscription_id)


class SubscriptionManager:
    """Opens subscriptions; every method takes a window, the most messages that may be out without an acknowledgement."""

    def __init__(self, client: Client):
        self.client = client

    def _open(self, *words: object, window: int | None = None) -> Subscription:
        opened = self.client.engine.open_subscription([str(w) for w in (*words, *_words(window=window))])
        return Subscription(self.client, opened)

    @staticmethod
    def _from(start: object, fallback: int | None = None) -> list:
        """Words of a start: None or "latest", a position, or a position per key."""
        if start is None or str(start).lower() == "latest":
            return ["FROM", "LATEST"]
        if isinstance(start, dict):
            return ["FROM", "MAP", *[f"{k}={n}" for k, n in start.items()], *(["DEFAULT", fallback] if fallback is not None else [])]
        return ["FROM", start]

    def subscribe_to_stream(self, stream_id: str, partition_key: str | None = None, from_version: object = None, window: int | None = None) -> Subscription:
        return self._open("ESUB", stream_id, *_words(partition_key=partition_key), *self._from(from_version), window=window)

    def subscribe_to_streams(self, stream_ids: Iterable[str], from_versions: object = None, window: int | None = None) -> Subscription:
        return self._open("ESUB", *stream_ids, *self._from(from_versions), window=window)

    def subscribe_to_partition(self, partition: int | str, from_sequence: object = None, window: int | None = None) -> Subscription:
        """By number or by key."""
        return self._open("EPSUB", partition, *self._from(from_sequence), window=window)

    def subscribe_to_partitions(self, partitions: Iterable[int], from_sequences: object = None, fallback: int | None = None, window: int | None = None) -> Subscription:
        return self._open("EPSUB", ",".join(map(str, partitions)), *self._from(from_sequences, fallback), window=window)

    def subscribe_to_partition_range(self, first: int, last: int, from_sequence: object = None, window: int | None = None) -> Subscription:
        return self._open("EPSUB", f"{first}-{last}", *self._from(from_sequence), window=window)

    def subscribe_to_all_partitions(self, from_sequence: object = None, fallback: int | None = None, window: int | None = None) -> Subscription:
        return self._open("EPSUB", "*", *self._from(from_sequence, fallback), window=window)
