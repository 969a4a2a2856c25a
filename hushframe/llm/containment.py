"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

An item and a document are the sets of their distinct five-word shingles (A-Z lower-cased; a text of
one to four words has its whole sequence as its one shingle).  A document is contaminated by an item
when it holds at least 75 % of the item's shingles.

Search: items are partitioned by size (powers of two).  All items of a partition keep the same number
of smallest shingle hashes, a bottom-k MinHash sketch whose k is one more than the shingles that the
partition's largest item may miss, so every document above the threshold holds at least one sketch hash
of the item: the search has no misses, however long the document.  Documents' shingle hashes stream
past the sketch index.  Verification: the shingles of each document that met a sketch are joined, as words, with those of
the items, and counted by item.

Scale: the index holds a quarter of the items' shingles; it is broadcast only while its counted rows
are at most ``BROADCAST_ROWS``, else joined by hash.  Only documents with a candidate are verified.

An item is its id and its text: one id with two texts is two items, each found by itself, whose id is then listed twice.
Edge cases: null or empty items and documents have no match.  An item of one to four words is found only
as a document of exactly these words, never inside a longer one.  Repeated items and rows are each judged
alike; rows without a doc_id or item_id are judged as well, and an item without an id counts but is not listed.  Columns are never taken from the input
by a clashing name; ``clean`` returns its input's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let, windows_of, words_of
from .shared import table

SHINGLE = 5
PERCENT = 75
#: Index rows up to which the index (two longs a row) and the items' sets (four times as many short strings) are
#: broadcast: some 60 MB in all.
BROADCAST_ROWS = 200_000
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_words(text: Column) -> Column:
    return words_of(F.translate(F.coalesce(text, F.lit("")), _AZ, _az))


def shingle_strings(words: Column) -> Column:
    """Distinct shingles, as strings of words parted by one space."""
    some = F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(words, " ")))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(windows_of(words, SHINGLE))).otherwise(some)


def shingle_hashes(words: Column) -> Column:
    """Hash of each shingle in text order; a short text's own is seeded by its length."""
    whole = F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(F.xxhash64(F.size(words), F.array_join(words, " ")))
    )
    many = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, many).otherwise(whole)


def item_sets(items: DataFrame, item_id: str = "item_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(ikey, item_id, shingles, n_item, sketch) for every distinct item that has words."""
    out = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("_t")).distinct()
    out = out.select(F.xxhash64("item_id", "_t").alias("ikey"), "item_id", lower_words(F.col("_t")).alias("_w"))
    out = out.select(
        "ikey", "item_id", shingle_strings(F.col("_w")).alias("shingles"), F.array_sort(F.array_distinct(shingle_hashes(F.col("_w")))).alias("_h")
    )
    out = out.withColumn("n_item", F.size("shingles")).filter("n_item > 0")
    part = F.floor(F.log2("n_item")).cast("int")
    largest = F.pow(F.lit(2), part + 1).cast("int") - 1
    keep = largest - F.ceil(largest * percent / 100).cast("int") + 1
    return out.withColumn("sketch", F.slice("_h", 1, keep)).drop("_h")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(_id, _h, item_id, ikey, n_shared, n_item): every document (id and text hash) that holds ``percent`` of an item."""
    sets = item_sets(items, percent=percent)
    index = sets.select("ikey", F.explode("sketch").alias("hash"))
    small = index.count() <= BROADCAST_ROWS
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_h"))
    hashes = source.select("_id", "_h", F.explode(let(lower_words(F.col("_text")), shingle_hashes)).alias("hash"))
    met = hashes.join(F.broadcast(index) if small else index, "hash").select(F.col("_id").alias("_cid"), F.col("_h").alias("_ch")).distinct()
    texts = source.join(met, source["_id"].eqNullSafe(met["_cid"]) & (source["_h"] == met["_ch"]), "left_semi")
    texts = texts.select("_id", "_h", "_text").dropDuplicates(["_id", "_h"])
    # a row for each shingle of a document with a candidate, however many items it may hold
    rows = texts.select("_id", "_h", F.explode(let(lower_words(F.col("_text")), shingle_strings)).alias("shingle"))
    parts = sets.select("ikey", F.explode("shingles").alias("_s"))
    held = rows.join(F.broadcast(parts) if small else parts, F.col("shingle") == F.col("_s")).groupBy("_id", "_h", "ikey").agg(F.count(F.lit(1)).alias("n_shared"))
    full = sets.select(F.col("ikey").alias("_i"), "item_id", "n_item")
    held = held.join(F.broadcast(full) if small else full, F.col("ikey") == F.col("_i")).filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return held.select("_id", "_h", "item_id", "ikey", "n_shared", "n_item")


def mark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__hf_items``: the sorted ids of the items that each document holds (null: none)."""
    found = leaks(docs, items, doc_id, text).groupBy("_id", "_h").agg(F.array_sort(F.collect_list("item_id")).alias("__hf_items"), F.count(F.lit(1)).alias("__hf_n_items"))
    found = found.withColumnsRenamed({"_id": "__hf_fid", "_h": "__hf_fh"})
    keyed = docs.withColumn("__hf_key", F.xxhash64(F.col(text)))
    return keyed.join(found, keyed[doc_id].eqNullSafe(found["__hf_fid"]) & (keyed["__hf_key"] == found["__hf_fh"]), "left").drop("__hf_fid", "__hf_fh", "__hf_key")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item."""
    return mark(docs, items, doc_id, text).filter(F.col("__hf_n_items").isNull()).select(*docs.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        F.coalesce("__hf_n_items", F.lit(0)).cast("long").alias("n_items"),
        F.array_join(F.col("__hf_items").cast("array<string>"), ",").alias("item_ids"),
        F.col("__hf_n_items").isNull().alias("kept"),
    )


def _sets(name: str, key: str) -> str:
    return rf"""
{name}_w AS (
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[^\x20\x09-\x0D]+') AS w
  FROM {name}
), {name}_s AS (
  SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s, len(w) < 5 AS short
  FROM (SELECT {key}, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM {name}_w WHERE len(w) > 0)
)"""


_SQL = f"""
WITH items AS (SELECT row_number() OVER (ORDER BY item_id, text) AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
{_sets("documents", "doc_id")}, {_sets("items", "item")},
n AS (SELECT item, count(*) AS n FROM items_s GROUP BY item),
hit AS (
  SELECT d.doc_id, b.item FROM items_s b JOIN documents_s d ON b.s = d.s AND b.short = d.short JOIN n ON n.item = b.item
  GROUP BY d.doc_id, b.item, n.n HAVING count(*) * 100 >= {PERCENT} * n.n
), by_doc AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM hit JOIN items USING (item) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_items, ids AS item_ids, n IS NULL AS kept FROM documents d LEFT JOIN by_doc USING (doc_id)
"""

QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
SQL = {"op10_benchmark_decontamination": _SQL}
