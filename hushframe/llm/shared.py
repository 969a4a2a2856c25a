"""Helpers the operators share: reading tables, stashing intermediates, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

__all__ = ["fresh_dir", "rekey", "release", "shared_dir", "stash", "table"]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see.

    It is what the session names in ``spark.checkpoint.dir``.  Only where that is unset (a local
    test session) a fresh temporary folder is taken, and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/hushframe/{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path below the shared folder, in this application's part of it."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this application has stashed; for when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most 16 MB for what runs inside: rows here hold whole texts, and each task keeps a batch on
    both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "16m")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the plan that
    follows exact sizes (for broadcast and skew decisions at run time).
    """
    path = fresh_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rekey(*cols: str) -> Column:
    """A 64-bit key over ``cols``.

    Joining an aggregate on a derived key (besides its own columns) makes Spark deal both sides
    by that key in exchanges of their own, so that adaptive execution may split a hot partition.
    """
    return F.xxhash64(*cols)
