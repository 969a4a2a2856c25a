"""Evaluation protocol: gold manifests that refer soundly, out-of-fold evidence, thresholds chosen and locked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .evaluation import best_threshold, ratio

COUNTERS = ("gold", "detected", "automatic", "name_negatives", "name_false", "name_false_automatic", "omissions")


def gold_violations(pages: DataFrame, segments: DataFrame, regions: DataFrame, occurrences: DataFrame, negatives: DataFrame) -> DataFrame:
    """(doc_id, id, violation): everything in gold manifests that does not fit together.

    pages: doc_id, page_index, width, height.  segments: doc_id, id, page_index, type, start, end.  regions: doc_id, id.
    occurrences: doc_id, id, page_index, segment_id, region_id, rects, start, end.  negatives: doc_id, id, kind, category."""
    repeated = [
        t.groupBy("doc_id", "id").count().filter("count > 1").select("doc_id", "id", F.lit(f"repeated_{name}_id").alias("violation"))
        for name, t in (("segment", segments), ("region", regions), ("occurrence", occurrences), ("negative", negatives))
    ]
    s = segments.select(F.col("doc_id").alias("_d"), F.col("id").alias("_s"), F.col("page_index").alias("_p"), "type", F.col("start").alias("_a"), F.col("end").alias("_b"))
    o = occurrences.join(s, (F.col("doc_id") == F.col("_d")) & (F.col("segment_id") == F.col("_s")), "left")
    r = regions.select(F.col("doc_id").alias("_rd"), F.col("id").alias("_r"))
    o = o.join(r, (F.col("doc_id") == F.col("_rd")) & (F.col("region_id") == F.col("_r")), "left")
    p = pages.select(F.col("doc_id").alias("_pd"), F.col("page_index").alias("_pi"), "width", "height")
    o = o.join(p, (F.col("doc_id") == F.col("_pd")) & (F.col("page_index") == F.col("_pi")), "left")
    outside = F.exists("rects", lambda x: ~G.valid(x) | (x["x1"] > F.col("width")) | (x["y1"] > F.col("height")))
    checks = [
        (F.col("_s").isNull(), "unknown_segment"),
        (F.col("_s").isNotNull() & (F.col("_p") != F.col("page_index")), "segment_on_other_page"),
        ((F.coalesce("type", F.lit("")) != "body") & F.col("_r").isNull(), "unknown_region"),
        ((F.col("start") < F.col("_a")) | (F.col("end") > F.col("_b")), "offsets_outside_segment"),
        (F.col("_pi").isNull() | outside, "rect_outside_page"),
    ]
    faults = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in checks)))
    bad = o.select("doc_id", "id", F.explode(faults).alias("violation"))
    names = negatives.filter("kind = 'name' AND category <> 'person_name'").select("doc_id", "id", F.lit("name_negative_category").alias("violation"))
    for t in (*repeated, names, _holes(segments)):
        bad = bad.unionByName(t)
    return bad


def _holes(segments: DataFrame) -> DataFrame:
    """Segments of a page that do not begin where the one before them ends."""
    w = Window.partitionBy("doc_id", "page_index").orderBy("start", "end")
    before = F.lag("end").over(w)
    return segments.withColumn("_e", before).filter(F.col("_e").isNotNull() & (F.col("_e") != F.col("start"))).select("doc_id", "id", F.lit("segments_not_contiguous").alias("violation"))


def prediction_violations(rows: DataFrame) -> DataFrame:
    """(doc_id, violation) of out-of-fold predictions (doc_id, status, counters): impossible counts, or a blocked
    document with counts."""
    c = F.col
    checks = [
        (F.array_min(F.array(*COUNTERS)) < 0, "negative_counter"),
        (c("detected") > c("gold"), "more_detected_than_gold"),
        (c("automatic") > c("detected"), "more_automatic_than_detected"),
        (c("name_false") > c("name_negatives"), "more_false_names_than_negatives"),
        (c("name_false_automatic") > c("name_false"), "more_automatic_than_false_names"),
        ((c("status") == "failed_closed") & (F.array_max(F.array(*COUNTERS)) > 0), "blocked_with_counts"),
    ]
    faults = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in checks)))
    return rows.select("doc_id", F.explode(faults).alias("violation"))


def coverage_violations(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, n): documents that are predicted other than once, and predictions of unknown documents (n null)."""
    n = predictions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = documents.select("doc_id").distinct().withColumn("_k", F.lit(True))
    return known.join(n, "doc_id", "full_outer").filter("_k IS NULL OR coalesce(n, 0) <> 1").select("doc_id", F.when(F.col("_k"), F.coalesce("n", F.lit(0))).alias("n"))


def roll_up(predictions: DataFrame) -> DataFrame:
    """One row: the sums of all counters over all folds, and the rates that follow."""
    total = predictions.agg(*(F.sum(c).alias(c) for c in COUNTERS), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "failed_closed").alias("blocked"))
    c = F.col
    return total.withColumns(
        {
            "recall": ratio(c("detected"), c("gold")),
            "automatic_rate": ratio(c("automatic"), c("gold")),
            "false_rate": ratio(c("name_false"), c("name_negatives")),
            "automatic_false_rate": ratio(c("name_false_automatic"), c("name_negatives")),
        }
    )


def threshold_evidence(synthetic: DataFrame, public: DataFrame) -> DataFrame:
    """Trials of both sources per threshold pair (auto, review, hits, gold, false, negatives), summed; ``complete`` tells
    whether both have the pair."""
    sums = [F.coalesce(F.col("s." + n), F.lit(0)) + F.coalesce(F.col("p." + n), F.lit(0)) for n in ("hits", "gold", "false", "negatives")]
    joined = synthetic.alias("s").join(public.alias("p"), (F.col("s.auto") == F.col("p.auto")) & (F.col("s.review") == F.col("p.review")), "full_outer")
    named = [s.alias(n) for s, n in zip(sums, ("hits", "gold", "false", "negatives"), strict=True)]
    both = F.col("s.auto").isNotNull() & F.col("p.auto").isNotNull()
    return joined.select(F.coalesce("s.auto", "p.auto").alias("auto"), F.coalesce("s.review", "p.review").alias("review"), *named, both.alias("complete"))


def choose(evidence: DataFrame) -> DataFrame:
    """The threshold pair to lock, from complete evidence only."""
    rates = evidence.filter("complete").select("auto", "review", F.coalesce(ratio(F.col("hits"), F.col("gold")), F.lit(0.0)).alias("detection"), F.coalesce(ratio(F.col("false"), F.col("negatives")), F.lit(0.0)).alias("false_rate"))
    return best_threshold(rates)


def held_out(documents: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Documents to train on and documents to predict, by their ``fold``."""
    return documents.filter(F.col("fold") != fold), documents.filter(F.col("fold") == fold)


def disjoint(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: whether two sets have no value in common."""
    return left.select(column).intersect(right.select(column)).agg((F.count(F.lit(1)) == 0).alias("disjoint"))


def lock(rows: DataFrame, *columns: str) -> DataFrame:
    """(rows, lock): how many rows there are, and an order-free hash over the columns, to be kept with a result and compared later.

    Row hashes are added as numbers, so that the lock is one aggregate."""
    h = F.conv(F.left(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("string"), 256).alias("lock"))
