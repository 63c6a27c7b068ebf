"""Shared scratch space: the one folder that driver and executors both see.

The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests,
local runs) a folder of our own is made and set.  Tables written here cut lineage and
survive a lost executor.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder's path; sets one of our own only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isEmpty():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fernloom-"))
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    return chosen.get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark)}/fernloom/{label}-{uuid.uuid4().hex}"


#: Per thread: paths written inside each open ``temporary`` block, the innermost last.
_LOCAL = threading.local()


def _open_blocks() -> list[list[str]]:
    if not hasattr(_LOCAL, "blocks"):
        _LOCAL.blocks = []
    return _LOCAL.blocks


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside go when the block ends, save those made with ``keep``."""
    paths: list[str] = []
    blocks = _open_blocks()
    blocks.append(paths)
    try:
        yield
    finally:
        blocks[:] = [x for x in blocks if x is not paths]
        for path in paths:
            remove(spark, path)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Inside a ``temporary`` block the table goes with the block; ``keep`` leaves it to the caller.
    """
    path = scratch_path(df.sparkSession, label)
    blocks = _open_blocks()
    if blocks and not keep:
        blocks[-1].append(path)
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path this module handed out (a run that compaction replaced)."""
    if "/fernloom/" not in path:
        raise ValueError(f"not a scratch path: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
