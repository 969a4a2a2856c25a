"""Line dedup by overlapping three-line windows.

The lines that hold a word are numbered within their document; every three consecutive ones are a
window, hashed to 128 bits.  A window found more than once in the corpus keeps its first occurrence
(smallest doc_id, then position); the lines under every later occurrence are removed, overlapping
occurrences being merged by the set of covered positions.  Lines without a word are never removed
and do not part windows.

Scale: one window row of a few dozen bytes per line is shuffled, counted with map-side partial
aggregates; occurrences meet the repeated windows in a join whose hot partitions adaptive execution
may split; texts are dealt by document once, to meet the list of their own removed lines.

Edge cases: null or empty texts, and texts of fewer than three such lines, stay as they are.  Rows
without a doc_id come after all others.  Rows alike in doc_id and text are judged as one, so both
keep or lose the same lines.  ``clean`` replaces the text column and keeps all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let
from .shared import rekey, table

LINES = 3
_LAST = (1 << 63) - 1


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _windows(text: Column) -> Column:
    """array<struct<w1, w2, j, at>>: the windows of a text, j counting lines with words, at: line indexes."""

    def of(full: Column) -> Column:
        def window(j: Column) -> Column:
            three = [F.get(full, j + k) for k in range(LINES)]
            line = [x["x"] for x in three]
            return F.struct(
                F.xxhash64(*line).alias("w1"),
                F.xxhash64(F.lit(1), *reversed(line)).alias("w2"),
                j.alias("j"),
                F.array(*(x["i"] for x in three)).alias("at"),
            )

        return F.when(F.size(full) >= LINES, F.transform(F.sequence(F.lit(0), F.size(full) - LINES), window))

    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return let(F.filter(numbered, lambda s: has_word(s["x"])), of)


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _h, removed): indexes of removed lines for each document (id and text hash) that loses any."""
    source = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("_text"))
    found = source.select("_id", "_h", F.explode(_windows(F.col("_text"))).alias("w")).select("_id", "_h", "w.*")
    place = F.struct(F.coalesce("_id", F.lit(_LAST)).alias("id"), F.col("_h").alias("h"), F.col("j").alias("j"))
    repeated = (
        found.groupBy("w1", "w2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(rekey("w1", "w2").alias("rkey"), F.col("w1").alias("r1"), F.col("w2").alias("r2"), "first")
    )
    same = (F.col("key") == F.col("rkey")) & (F.col("w1") == F.col("r1")) & (F.col("w2") == F.col("r2"))
    later = found.withColumn("key", rekey("w1", "w2")).join(repeated, same)
    later = later.filter(place != F.col("first")).select("_id", "_h", "at")
    return later.groupBy("_id", "_h").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("removed"))


def mark(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__hf_removed``: the indexes of the lines that go, null for none."""
    gone = removed_lines(docs, doc_id, text).select(F.col("_id").alias("__hf_gid"), F.col("_h").alias("__hf_gh"), F.col("removed").alias("__hf_removed"))
    keyed = docs.withColumn("__hf_key", F.xxhash64(F.col(text)))
    return keyed.join(gone, F.col(doc_id).eqNullSafe(F.col("__hf_gid")) & (F.col("__hf_key") == F.col("__hf_gh")), "left").drop("__hf_gid", "__hf_gh", "__hf_key")


def kept_text(text: Column, removed: Column) -> Column:
    def rest(lines: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    return F.when(removed.isNull(), text).otherwise(let(F.split(text, "\n"), rest))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the later copies of repeated passages taken out of the text column."""
    names = docs.columns
    return mark(docs, doc_id, text).withColumn(text, kept_text(F.col(text), F.col("__hf_removed"))).select(*names)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), has_word)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__hf_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(kept_text(F.col("text"), F.col("__hf_removed")), F.lit("")), 256).alias("kept_sha256"),
    )


_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line FROM (
    SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, line
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT a.doc_id, a.j, a.line || chr(10) || b.line || chr(10) || c.line AS win
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.j = a.j + 1 JOIN f c ON a.doc_id = c.doc_id AND c.j = a.j + 2
), later AS (
  SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY win ORDER BY doc_id, j) AS n FROM w) WHERE n > 1
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM f JOIN (SELECT DISTINCT doc_id, unnest(range(j, j + 3)) AS j FROM later) g ON f.doc_id = g.doc_id AND f.j = g.j
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id
), nl AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id), ng AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(nl.n, 0) AS n_lines, coalesce(ng.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN nl USING (doc_id) LEFT JOIN ng USING (doc_id)
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {"op9_line_dedup": _SQL}
