"""Scratch tables: the one way in which lineage is cut.

A scratch table is Parquet under the folder that the session names in
``spark.checkpoint.dir``, which driver and executors share. Losing an executor
then costs a re-read, never a recomputation of the whole chain.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By session: how many tables are being written, and the setting before the first of them.
_writing: dict[str, tuple[int, str | None]] = {}
_lock = threading.Lock()


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only on a single-machine master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-skein-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """``SHUFFLE_CLEANUP`` on for the session until the last of those within, in any thread, has left."""
    own = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(own) or (0, spark.conf.get(SHUFFLE_CLEANUP, None))
        _writing[own] = n + 1, before
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(own)
            if n > 1:
                _writing[own] = n - 1, before
            elif before is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh scratch table and return the table.

    The shuffle files of the step go when it ends, not when the driver next collects garbage:
    nothing reads them again, and a long chain would fill the executors' disks with them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/skein-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with shuffle_cleanup(spark):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
