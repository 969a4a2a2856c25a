"""Sharding by Karmarkar-Karp differencing: byte sizes of the shards nearly equal, equal texts together.

A group is all rows with one text (by SHA-256 of its bytes; null texts are one group of their own); groups
are indivisible.  A partial partition is a vector of ``shards`` sums.  Differencing takes the two partial
partitions with the largest spread and adds them in opposite order, until one is left.  That is the
same whether a partial partition came from one group or from many, so it is done in levels: groups are
dealt to buckets of about ``BUCKET`` by hash, each bucket is differenced in its own task to one partial
partition, then buckets of buckets, until at most ``TOP`` are left for the driver (a few numbers each).

Scale: sizes and counts per distinct text are the only thing shuffled by text, with partial
aggregation, so a hot text costs one row per task; no task holds more than a bucket.

Edge cases: null text has size 1 (no bytes, plus one).  Rows alike in doc_id and text get slots of
their own.  An empty table gives no rows.  Columns of the input are kept unless a result column has the
same name.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stash, table

SHARDS = 8
BUCKET, TOP = 8_000, 512
#: Rows of a shard are numbered in blocks dealt by hash, of about this many rows.
SLOT_BLOCK = 100_000


def difference(vectors: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over partial partitions of one length.

    Returns the sums of the final partition and, for each input vector, which final subset each of its own
    subsets went to."""
    k = len(vectors[0])
    order = count()
    heap = []
    for i, v in enumerate(vectors):
        place = sorted(range(k), key=lambda s: (v[s], s))
        sums = [v[s] for s in place]
        # tree: members of each subset, as (vector, its subset) leaves joined pairwise
        heapq.heappush(heap, (sums[0] - sums[-1], next(order), sums, [(i, s) for s in place]))
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        both = sorted(((x + y, j) for j, (x, y) in enumerate(zip(a, reversed(b), strict=True))))
        sums = [s for s, _ in both]
        heapq.heappush(heap, (sums[0] - sums[-1], next(order), sums, [[at[j], bt[k - 1 - j]] for _, j in both]))
    _, _, sums, trees = heap[0]
    went = [[0] * k for _ in vectors]
    for subset, tree in enumerate(trees):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                went[node[0]][node[1]] = subset
            else:
                stack += node
    return sums, went


def _single(size: int, k: int) -> list[int]:
    return [0] * (k - 1) + [int(size)]


def _level(rows: DataFrame, shards: int, buckets: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """Difference the rows (id, sums) in ``buckets``: (id, bucket, went) for the rows and (bucket, sums) for the buckets."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", F.lit(buckets)), F.lit(buckets)).cast("string"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        vectors = [_single(s[0], shards) for s in group["sums"]] if first else [[int(x) for x in s] for s in group["sums"]]
        sums, went = difference(vectors)
        if first:  # one subset of a group matters: the one that holds it
            went = [[w[-1]] for w in went]
        own = pd.DataFrame({"id": group["id"], "bucket": group["bucket"], "part": went, "total": False})
        return pd.concat([own, pd.DataFrame({"id": [""], "bucket": [group["bucket"][0]], "part": [sums], "total": [True]})])

    done = stash(dealt.groupBy("bucket").applyInPandas(work, "id string, bucket string, part array<long>, total boolean"), "differenced")
    return (
        done.filter("NOT total").select("id", "bucket", F.col("part").alias("went")),
        done.filter("total").select(F.col("bucket").alias("id"), F.col("part").alias("sums")),
    )


def assign(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET, top: int = TOP) -> DataFrame:
    """(id, shard) for groups (id: string, size: long) with byte sums as equal as differencing makes them."""
    spark = groups.sparkSession
    rows = stash(groups.select("id", F.array("size").alias("sums")), "groups")
    left, maps = rows.count(), []
    first = True
    while first or left > top:
        left = -(-left // bucket) if left > bucket else 1
        went, rows = _level(rows, shards, max(left, 1), first)
        maps.append(went)
        first, bucket = False, min(bucket, top)
    final = sorted((r["id"], [int(x) for x in r["sums"]]) for r in rows.toLocalIterator())
    _, went = difference([s for _, s in final]) if final else ([], [])
    table_ = spark.createDataFrame([(i, w) for (i, _), w in zip(final, went, strict=True)], "tid string, target array<int>")
    for inner in reversed(maps[1:]):
        step = inner.join(F.broadcast(table_) if len(final) <= top else table_, F.col("bucket") == F.col("tid"))
        table_ = step.select(F.col("id").alias("tid"), F.transform("went", lambda s: F.get(F.col("target"), s.cast("int"))).alias("target"))
    placed = maps[0].join(table_, F.col("bucket") == F.col("tid"))
    return placed.select("id", F.get("target", F.get("went", F.lit(0)).cast("int")).alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("digest"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).select(F.col("digest").alias("id"), "size")
    placed = stash(assign(groups, shards), "placed")
    out = rows.join(placed, F.col("digest") == F.col("id")).select("doc_id", "digest", "size", "text_crc32", "shard")
    out = stash(out, "sharded")
    blocks = max(1, -(-out.count() // SLOT_BLOCK))
    out = out.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)))
    counts = out.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("bs"), F.col("block").alias("bb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = out.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "digest")))
    joined = local.join(offsets, (F.col("shard") == F.col("bs")) & (F.col("block") == F.col("bb")))
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
