"""Shared scratch space for intermediate tables.

A staged table is written once to the folder that the cluster names in
``spark.checkpoint.dir``; executors that are lost later cost no recomputation,
and the plan behind the table starts at a file scan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own, which
    goes with the process; on a cluster, whose executors would each see another
    disk under that name, nothing can be staged.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jdir.get() if jdir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomlog-scratch-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_staged: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete what this application staged; for when no result that reads it is needed any more."""
    jvm = spark.sparkContext._jvm
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the scratch folder.

    It is deleted when the application ends, not before: a lazy result may
    still read it, and lost executors read it again.
    """
    path = f"{scratch_dir(spark)}/loomlog-{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of what was written."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_rows: int = 100_000, name: str = "side") -> DataFrame:
    """Stage a small join side and mark it for broadcast only if its counted rows fit.

    Above ``max_rows`` the staged table comes back without a hint, so the join
    is shuffled and adaptive execution splits its skewed partitions.
    """
    staged = stage(df, name)
    return F.broadcast(staged) if staged.count() <= max_rows else staged


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
