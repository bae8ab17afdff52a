"""Engine settings: defaults, then a file, the environment (``LOOMLOG_``) and keywords, later ones first."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

KIB, GIB = 1 << 10, 1 << 30


@dataclass
class LogConfig:
    buckets: int = 4
    partitions: int = 32
    replication_factor: int | None = None
    nodes: int = 1
    node_index: int = 0
    cluster: bool = False
    strict_versioning: bool = True
    segment_bytes: int = 256 << 20
    writer_threads: int = 4
    reader_threads: int = 4
    cache_bytes: int = 256 << 20
    buffer_size: int = 1000
    buffer_timeout_ms: int = 8000
    heartbeat_interval_ms: int = 1000
    heartbeat_timeout_ms: int = 6000
    sync_interval_ms: int = 5
    sync_idle_ms: int = 5
    sync_bytes: int = 4096
    sync_events: int = 50
    bucket_ids: list[int] | None = None
    partition_ids: list[int] | None = None
    path: str = field(default="log")

    @property
    def rf(self) -> int:
        return self.replication_factor if self.replication_factor is not None else min(max(self.nodes, 1), 3)

    @property
    def quorum(self) -> int:
        return self.rf // 2 + 1

    def problems(self) -> list[str]:
        """Everything that is wrong with the settings."""
        out = []
        for name in ("buckets", "partitions", "buffer_size", "buffer_timeout_ms", "heartbeat_interval_ms", "heartbeat_timeout_ms", "segment_bytes", "writer_threads", "reader_threads", "nodes"):
            if getattr(self, name) < 1:
                out.append(f"{name} must be greater than 0")
        if self.replication_factor is not None and self.replication_factor < 1:
            out.append("replication_factor must be greater than 0")
        for ids, count, most, what in ((self.bucket_ids, self.buckets, self.buckets, "bucket"), (self.partition_ids, self.partitions, self.partitions, "partition")):
            if ids is not None:
                if len(set(ids)) != len(ids):
                    out.append(f"{what} ids must be unique")
                if len(ids) != count:
                    out.append(f"{what} ids must be as many as {what}s")
        if self.heartbeat_timeout_ms <= self.heartbeat_interval_ms:
            out.append("heartbeat_timeout_ms must be greater than heartbeat_interval_ms")
        if not 0 <= self.node_index < max(self.nodes, 1):
            out.append("node_index must be less than nodes")
        if self.nodes > 1 and not self.cluster:
            out.append("more than one node needs cluster mode")
        if self.rf > self.nodes and self.replication_factor is not None:
            out.append("replication_factor must not exceed nodes")
        if not 128 * KIB <= self.segment_bytes <= 10 * GIB:
            out.append("segment_bytes must be between 128 KiB and 10 GiB")
        if self.sync_idle_ms > self.sync_interval_ms:
            out.append("sync_idle_ms must not exceed sync_interval_ms")
        if max(self.writer_threads, self.reader_threads) > 1024:
            out.append("at most 1024 threads")
        if self.writer_threads >= 1 and self.buckets % self.writer_threads:
            out.append("writer_threads must divide buckets")
        if self.partitions < self.nodes or self.partitions < self.buckets:
            out.append("partitions must be at least nodes and buckets")
        return out

    def validate(self) -> LogConfig:
        if p := self.problems():
            raise ValueError("; ".join(p))
        return self

    @classmethod
    def load(cls, file: str | None = None, env: dict[str, str] | None = None, **given: object) -> LogConfig:
        values: dict[str, object] = {}
        if file:
            text = Path(file).read_text()
            if file.endswith(".toml"):
                import tomllib

                values |= tomllib.loads(text)
            elif file.endswith((".yaml", ".yml")):
                import yaml

                values |= yaml.safe_load(text) or {}
            else:
                values |= json.loads(text)
        kinds = {f.name: f.type for f in dataclasses.fields(cls)}
        for name, raw in (os.environ if env is None else env).items():
            key = name.removeprefix("LOOMLOG_").lower()
            if name.startswith("LOOMLOG_") and key in kinds:
                values[key] = raw == "true" if kinds[key] == "bool" else raw if kinds[key] == "str" else json.loads(raw)
        values |= {k: v for k, v in given.items() if v is not None}
        unknown = set(values) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values).validate()
