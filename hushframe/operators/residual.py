"""Search for what should be gone: values in output texts, exactly, without white space, and with any dash or spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_dashes

FUZZY_CHARS = 4


def search_terms(hits: DataFrame) -> DataFrame:
    """(doc_id, tag, value): each value once per document and tag."""
    return hits.select("doc_id", "tag", "value").distinct()


def _times(text: Column, value: Column) -> Column:
    """How often a value stands in a text as a run of its own (no letter or digit touches it)."""
    quoted = F.concat(F.lit(r"(?U)(?<![\p{L}\p{Nd}])\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{Nd}])"))
    return F.when(F.length(value) >= 2, F.regexp_count(text, quoted)).otherwise(0)


def residuals(terms: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc_id, tag, value, exact, fuzzy): values that the output texts (doc_id, text) still hold.

    exact: as found, and without its white space.  fuzzy: beyond those, with dashes and white space levelled on both
    sides, for values of ``FUZZY_CHARS`` letters or more."""
    o = outputs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    joined = terms.join(o, F.col("doc_id") == F.col("_d"))
    short = F.regexp_replace("value", r"(?U)\s+", "")
    level, text = plain_dashes(F.col("value")), plain_dashes(F.col("_t"))
    exact = _times(F.col("_t"), F.col("value")) + F.when(short != F.col("value"), _times(F.col("_t"), short)).otherwise(0)
    n = (F.length(text) - F.length(F.replace(text, level, F.lit("")))) / F.length(level)
    fuzzy = F.when(F.length(level) >= FUZZY_CHARS, F.greatest(n - exact, F.lit(0.0))).otherwise(0.0)
    found = joined.select("doc_id", "tag", "value", exact.cast("long").alias("exact"), fuzzy.cast("long").alias("fuzzy"))
    return found.filter("exact > 0 OR fuzzy > 0")


def verified(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, verified, residual_hits, residual_fuzzy_hits) for every document."""
    per = found.groupBy("doc_id").agg(F.sum("exact").alias("residual_hits"), F.sum("fuzzy").alias("residual_fuzzy_hits"))
    out = documents.select("doc_id").distinct().join(per, "doc_id", "left").na.fill(0, ["residual_hits", "residual_fuzzy_hits"])
    return out.withColumn("verified", (F.col("residual_hits") == 0) & (F.col("residual_fuzzy_hits") == 0))


def quality_gate(verified_: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, passed, reason): every counted value masked, none left.  counts: doc_id, tag, found, masked."""
    per = counts.groupBy("doc_id").agg(F.every(F.col("found") == F.col("masked")).alias("_all"))
    out = verified_.join(per, "doc_id", "left")
    reason = F.when(~F.coalesce("_all", F.lit(True)), "targets_missed").when(~F.col("verified"), "residual_found")
    return out.select("doc_id", reason.isNull().alias("passed"), reason.alias("reason"))
