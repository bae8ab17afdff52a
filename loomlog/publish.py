"""Tables that become visible as a whole, by one marker, or not at all.

A run writes to a folder of its own and then publishes that folder under the
next number. The marker is written under another name, closed and renamed, so
it is never seen half written, and a number that is taken is refused: of two
runs that started from the same state, one wins and the other has done nothing.
What a run that died left behind has no marker and is never read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


class Published:
    """Numbered folders below ``path``; only those with a marker exist."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._never_replace = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _markers(self) -> list[tuple[int, str]]:
        folder = self._Path(f"{self.path}/published")
        if not self._fs.exists(folder):
            return []
        out = []
        for s in self._fs.listStatus(folder):
            name = s.getPath().getName()
            if name.isdigit():
                stream = self._fs.open(s.getPath())
                try:
                    out.append((int(name), bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return sorted(out)

    def runs(self) -> list[tuple[int, str]]:
        """(number, folder) of what is published, in order; an empty marker publishes nothing."""
        return [r for r in self._markers() if r[1]]

    def last(self) -> str | None:
        runs = self.runs()
        return runs[-1][1] if runs else None

    def next_number(self) -> int:
        return max((n for n, _ in self._markers()), default=-1) + 1

    def new_folder(self, number: int) -> str:
        """A folder that no other attempt writes to."""
        return f"{self.path}/work/{number}-{int(time.time())}-{uuid.uuid4().hex[:8]}"

    def publish(self, number: int, folder: str) -> None:
        """Make ``folder`` visible as ``number``; fails if another run has that number."""
        marks = f"{self.path}/published"
        new = self._Path(f"{marks}/_new-{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        try:
            stream.write(bytearray(folder.encode()))
        finally:
            stream.close()
        try:
            self._context.rename(new, self._Path(f"{marks}/{number}"), self._never_replace)
        except Exception:
            self._fs.delete(new, False)
            raise

    def forget(self, before: int) -> None:
        """Delete the data of runs under ``before`` that no kept run names, and folders without a marker."""
        kept = {f.rpartition("/")[2] for n, f in self.runs() if n >= before}
        work = self._Path(f"{self.path}/work")
        for s in self._fs.listStatus(work) if self._fs.exists(work) else []:
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)
