"""Page evidence: words from OCR and text layers, evidence joined to pages, canonical texts, redaction plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

TEXT_LAYER, RASTER = "pdf_points_top_left", "raster_pixels"


def polygon_box(points: Column) -> Column:
    """The box around an OCR polygon, array<array<double>>; null unless it has four finite points."""
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)).cast("double"))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)).cast("double"))
    fine = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    box = G.rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when((F.size(points) == 4) & fine(xs) & fine(ys), box)


def ocr_words(rows: DataFrame) -> DataFrame:
    """Words (doc_id, page_index, text, rect, confidence, coordinate_space, fault) from OCR rows with ``polygon`` and
    ``confidence``; a malformed row keeps its fault and has no rect."""
    rect = polygon_box(F.col("polygon"))
    bad = F.isnan("confidence") | (F.abs(F.col("confidence")) == float("inf"))
    fault = F.when(rect.isNull(), "OCR_GEOMETRY_INVALID").when(F.coalesce(bad, F.lit(False)), "OCR_CONFIDENCE_INVALID")
    return rows.select("doc_id", "page_index", "text", rect.alias("rect"), "confidence", F.lit(RASTER).alias("coordinate_space"), fault.alias("fault"))


def enriched(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index, text, source) with the evidence of an adapter (doc_id, page_index, text, words): the adapter
    wins, unless the page is OCR and both texts differ beyond white space."""
    e = evidence.select(F.col("doc_id").alias("_d"), F.col("page_index").alias("_p"), F.col("text").alias("_t"), F.col("words").alias("words"))
    joined = pages.join(e, (F.col("doc_id") == F.col("_d")) & (F.col("page_index") == F.col("_p")), "left")
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    clash = (F.col("source") == "ocr") & (bare(F.col("text")) != bare(F.col("_t")))
    status = F.when(F.col("_d").isNull(), "missing").when(clash, "gap").otherwise("aligned")
    taken = F.col("_d").isNotNull() & ~clash
    return joined.select(
        "doc_id", "page_index", F.when(taken, F.col("_t")).otherwise(F.col("text")).alias("text"), "source", F.when(taken, F.col("words")).alias("words"), status.alias("evidence_status")
    )


def canonical(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document texts (doc_id, text) of all pages joined by line ends, and where each page lies: (doc_id, page_index, start, end)."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    before = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    places = pages.select("doc_id", "page_index", before.alias("start"), (before + F.length("text")).alias("end"))
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text")), places


def misaligned_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_index) of pages of which a word's offsets run backwards or hold other text than the word."""
    p = pages.select(F.col("doc_id").alias("_d"), F.col("page_index").alias("_p"), F.col("text").alias("_t"))
    joined = words.join(p, (F.col("doc_id") == F.col("_d")) & (F.col("page_index") == F.col("_p")))
    w = Window.partitionBy("doc_id", "page_index").orderBy("word_index")
    back = F.coalesce(F.col("start") < F.lag("end").over(w), F.lit(False))
    other = F.substr(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")
    return joined.withColumn("_bad", back | F.coalesce(other, F.lit(True))).filter("_bad").select("doc_id", "page_index").distinct()


def word_hash(words: DataFrame) -> DataFrame:
    """(doc_id, page_index, hash): order-free identity of a page's words, by place and text."""
    ordered = F.array_sort(F.collect_list(F.struct("rect.x0", "rect.y0", "rect.x1", "rect.y1", "text")))
    return words.groupBy("doc_id", "page_index").agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n"), 256).alias("hash"))


def redaction_plan(occurrences: DataFrame, manual: DataFrame, excluded: DataFrame) -> DataFrame:
    """(doc_id, page, rect, tag, label, source): every rect to be blacked out by a writer of documents."""
    automatic = occurrences.filter("action = 'mask'").join(excluded, ["doc_id", "occurrence_id"], "left_anti")
    a = automatic.select("doc_id", "page", F.explode("rects").alias("rect"), "tag", F.concat(F.lit("["), F.col("tag"), F.lit("]")).alias("label"), F.lit("automatic").alias("source"))
    m = manual.filter("action = 'mask'").select("doc_id", "page", F.explode("rects").alias("rect"), F.lit("MANUAL").alias("tag"), F.lit("[MANUAL]").alias("label"), F.lit("manual").alias("source"))
    return a.unionByName(m).dropDuplicates(["doc_id", "page", "rect", "tag"])


def output_name(path: Column, suffix: str, stamp: str) -> Column:
    """The name of a result: the source's name without its ending, a suffix and a time stamp."""
    return F.concat(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit(f"_{suffix}_{stamp}"))
