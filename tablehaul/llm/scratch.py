"""Scratch tables and shuffle files that are no longer needed."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write or checkpoint go when it ends, not when the driver's garbage is collected.

    For operators that write one step after the other, each of which is read from
    what it wrote. The session's own setting is put back.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete scratch folders that an operator wrote itself and nothing reads any more.

    Only called when all that was made of them is written, so a lost executor needs
    nothing of them again. A folder that is not there is passed over.
    """
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
