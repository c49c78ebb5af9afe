"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written since the innermost mark of this thread and not yet deleted, in order; each thread has marks of its own, so queries in several threads of a session delete nothing of each other's.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode; on a cluster, where executors would not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir() or base


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, a lost executor costs no recomputation, and joins see true sizes."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if marks := _written.get():
        marks[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """From here on this thread's tables are remembered, to be dropped together; marks nest."""
    _written.set((*_written.get(), []))
    return len(_written.get())


def drop_tables(spark: SparkSession, since: int, spare: int = 0) -> None:
    """Delete the tables written after `since` (a mark of this thread), but for the last `spare` of them, which the mark before takes over. No
    DataFrame still in use may rest on them. Marks made after it are gone with it."""
    marks = _written.get()
    paths = [p for m in marks[since - 1 :] for p in m]
    _written.set(marks[: since - 1])
    if since > 1:
        marks[since - 2].extend(paths[len(paths) - spare :])
    for path in paths[: len(paths) - spare]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
