"""Connected components of an edge table by alternating large and small stars.

Each round sends, for every vertex, its larger neighbours and then all its neighbours to the smallest
one, until no edge changes; the rounds needed grow with the logarithm of the longest chain.  Every
round is a grouped minimum and one join (whose hot partitions adaptive execution may split), written
to the shared folder, so no edge is collected and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v, m): both directions of every edge, with the smallest vertex around u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.concat(F.col("u"), F.lit("")).alias("c"), F.least("m", "u").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).select("u", "v", "m")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (u, v: strings); the component is its smallest vertex."""
    now = stash(edges.filter("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), name)
    before = None
    while True:
        large = _stars(now).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _stars(large).filter("v <= u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stash(small.filter("u <> v").distinct(), name)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    ends = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
