"""The input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of few, wide rows, whose rows cost far more to work on than to move.
WIDE = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as a lazily read Parquet DataFrame.

    A wide table in fewer splits than half the cluster's cores (a single small file, say) is dealt evenly to all of
    them; any table large enough to matter has more splits and is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in WIDE and 2 * df.rdd.getNumPartitions() <= cores:
        df = df.repartition(cores)
    return df
