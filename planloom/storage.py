"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: The paths given out while settled() builds, for each of its calls that is under way.
_made: list[list[str]] = []
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names the folder in spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary
    folder of this process serves, and the session remembers it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="planloom-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/planloom/{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting for the queries that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, batch_bytes: int | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: the lineage is cut and a lost executor loses nothing.

    Its shuffle files are deleted when it is written: what was written replaces them. batch_bytes: what Python workers
    get at once at most; an executor's memory holds their batches beside the heap.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    with setting(spark, _CLEANUP, "true"), setting(spark, _BATCH, str(batch_bytes)) if batch_bytes else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """materialise(build()), without the other tables that were written for it."""
    paths: list[str] = []
    _made.append(paths)
    try:
        out, kept = materialise(build())
    finally:
        _made[:] = [x for x in _made if x is not paths]
    discard(spark, *(p for p in paths if p != kept))
    return out, kept


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
