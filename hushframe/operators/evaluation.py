"""Quality measurement: folds, compatibility, one-to-one matching, counts and ratios, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .grouped import Rows, per_group


def folds(documents: DataFrame, column: str, count: int = 5, seed: str = "public-document-pilot-v1") -> DataFrame:
    """``documents`` with ``fold``: the rank by seeded hash, modulo the number of folds.

    Ranks are global; they are made by counting per leading two bytes of the hash and ranking within those 65 536
    buckets, so that no task ranks all rows; only the counts are ranked in one."""
    keyed = documents.withColumn("_k", F.sha2(F.concat(F.lit(seed + ":"), F.col(column)), 256)).withColumn("_b", F.left("_k", F.lit(4)))
    per = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 65 536 rows at most
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_k", column)) - 1
    ranked = keyed.withColumn("_r", rank).join(F.broadcast(offsets), F.col("_b") == F.col("_ob"))
    return ranked.withColumn("fold", ((F.col("_offset") + F.col("_r")) % count).cast("int")).drop("_k", "_b", "_ob", "_offset", "_r")


def ratio(part: Column, whole: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(part.cast("double"), F.when(whole != 0, whole.cast("double")))


def status(whole: Column) -> Column:
    return F.when(whole != 0, "ok").otherwise("not_applicable")


def compatible(gold: DataFrame, candidates: DataFrame, threshold: float = 0.5, need_coverage: bool = False) -> DataFrame:
    """(doc_id, gold_id, cand_id, score): pairs of one page and category whose rects, or else offsets, agree.

    Both sides: doc_id, id, page_index, category, text_hash, rects (array), start, end."""
    names = ["doc_id", "id", "page_index", "category", "text_hash", "rects", "start", "end"]
    g = gold.select(*(F.col(n).alias("g_" + n) for n in names))
    c = candidates.select(*(F.col(n).alias("c_" + n) for n in names))
    on = (F.col("g_doc_id") == F.col("c_doc_id")) & F.col("g_page_index").eqNullSafe(F.col("c_page_index")) & F.col("g_category").eqNullSafe(F.col("c_category"))
    on = on & (F.coalesce(F.col("g_text_hash"), F.lit("")).isin("") | (F.col("g_text_hash") == F.col("c_text_hash")))
    has = lambda side: F.coalesce(F.size(F.col(side + "_rects")), F.lit(0)) > 0
    pairs = F.flatten(F.transform(F.col("g_rects"), lambda a: F.transform(F.col("c_rects"), lambda b: G.iou(a, b))))
    # positive scores need rects or offsets that overlap
    meets = F.exists("g_rects", lambda a: F.exists("c_rects", lambda b: G.overlaps(a, b)))
    apart = F.least("g_end", "c_end") > F.greatest("g_start", "c_start")
    joined = g.join(c, on & F.when(has("g") & has("c"), meets).otherwise(~has("g") & ~has("c") & apart))
    iou = F.array_max(pairs)
    cover = F.array_min(F.transform(F.col("g_rects"), lambda r: G.coverage(r, F.col("c_rects"), 0.0)))
    joined = joined.withColumns({"_iou": F.when(has("g") & has("c"), iou), "_cover": F.when(has("g") & has("c"), cover)})
    overlap = F.least("g_end", "c_end") - F.greatest("g_start", "c_start")
    if need_coverage:
        by_rect = F.when((F.col("_iou") >= threshold) & (F.col("_cover") >= 0.8), F.least("_iou", "_cover"))
    else:
        by_rect = F.when((F.col("_iou") >= threshold) | (F.col("_cover") >= 0.8), F.greatest("_iou", "_cover"))
    by_offset = F.when(~has("g") & ~has("c") & (overlap > 0), overlap.cast("double"))
    scored = joined.withColumn("score", F.when(has("g") & has("c"), by_rect).otherwise(by_offset)).filter("score IS NOT NULL")
    return scored.select(F.col("g_doc_id").alias("doc_id"), F.col("g_id").cast("string").alias("gold_id"), F.col("c_id").cast("string").alias("cand_id"), "score")


def _largest_matching(key: dict, edges: Rows) -> Rows:
    """Golds in order of id each take their best free candidate, moving earlier ones along a chain of alternatives."""
    options: dict[str, list[str]] = {}
    for e in sorted(edges, key=lambda e: (-e["score"], e["cand_id"])):
        options.setdefault(e["gold_id"], []).append(e["cand_id"])
    holder: dict[str, str] = {}
    for start in sorted(options):
        # depth first over alternating paths, kept on an explicit stack
        seen: set[str] = set()
        path: list[tuple[str, str]] = []
        stack = [(start, iter(options[start]))]
        while stack:
            gold, rest = stack[-1]
            cand = next((c for c in rest if c not in seen), None)
            if cand is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            seen.add(cand)
            path.append((gold, cand))
            if cand not in holder:
                for g, c in path:
                    holder[c] = g
                break
            stack.append((holder[cand], iter(options[holder[cand]])))
    return [{**key, "gold_id": g, "cand_id": c} for c, g in holder.items()]


def one_to_one(pairs: DataFrame) -> DataFrame:
    """(doc_id, gold_id, cand_id): a matching of the largest size per document.

    A document's pairs are one group; pages keep them few."""
    kind = pairs.schema["doc_id"].dataType.simpleString()
    columns = pairs.select("doc_id", "gold_id", "cand_id", "score")
    return per_group(columns, ["doc_id"], _largest_matching, f"doc_id {kind}, gold_id string, cand_id string")


def occurrence_counts(gold: DataFrame, candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """(doc_id, tp, fp, fn, recall, status) per document that has gold or candidates."""
    sides = [gold.select("doc_id", F.lit("g").alias("s")), candidates.select("doc_id", F.lit("c").alias("s")), matched.select("doc_id", F.lit("m").alias("s"))]
    n = lambda s: F.count_if(F.col("s") == s)
    out = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("doc_id").agg(n("g").alias("g"), n("c").alias("c"), n("m").alias("tp"))
    out = out.withColumns({"fp": F.col("c") - F.col("tp"), "fn": F.col("g") - F.col("tp"), "recall": ratio(F.col("tp"), F.col("g")), "status": status(F.col("g"))})
    return out.select("doc_id", "tp", "fp", "fn", "recall", "status")


def hit_negatives(negatives: DataFrame, candidates: DataFrame) -> DataFrame:
    """Negatives that a candidate of the same document, page and category covers with some area."""
    c = candidates.select(*(F.col(n).alias("c_" + n) for n in ("doc_id", "page_index", "category", "rects")))
    on = (F.col("doc_id") == F.col("c_doc_id")) & F.col("page_index").eqNullSafe(F.col("c_page_index")) & F.col("category").eqNullSafe(F.col("c_category"))
    on = on & F.exists("rects", lambda a: F.exists("c_rects", lambda b: G.intersection(a, b) > 0))
    return negatives.join(c, on, "left_semi")


def in_fixed_region(region_state: Column, region_source: Column, segment_state: Column, segment_source: Column) -> Column:
    """Whether an occurrence counts towards the zero-omission target."""
    return (
        F.when(region_source == "user", F.lit(True))
        .when(region_state.isin("review_required", "unconfirmed"), F.lit(False))
        .when((region_state == "confirmed") & (region_source == "automatic"), F.lit(True))
        .otherwise(F.coalesce((segment_source == "user") | ((segment_state == "confirmed") & (segment_source == "automatic")), F.lit(False)))
    )


def segment_pairs(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Segments (doc_id, id, type, pages) of one type whose page sets are alike (Jaccard 0.8), for ``one_to_one``."""
    g = gold.select("doc_id", F.col("id").alias("gold_id"), "type", F.col("pages").alias("_g"))
    c = candidates.select(F.col("doc_id").alias("_d"), F.col("id").alias("cand_id"), F.col("type").alias("_t"), F.col("pages").alias("_c"))
    both, either = F.size(F.array_intersect("_g", "_c")), F.size(F.array_union("_g", "_c"))
    pairs = g.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("type") == F.col("_t")))
    return pairs.filter((either > 0) & (both * 10 >= either * 8)).select("doc_id", "gold_id", "cand_id", F.lit(1.0).alias("score"))


def best_threshold(rows: DataFrame, least_detection: float = 0.99, most_false: float = 0.05) -> DataFrame:
    """The one row (auto, review, detection, false_rate) to take: passing first, then by detection, false rate, thresholds."""
    passing = (F.col("detection") >= least_detection) & (F.col("false_rate") <= most_false)
    order = F.struct((~passing).cast("int"), -F.col("detection"), F.col("false_rate"), F.col("auto"), F.col("review"))
    best = rows.agg(F.min_by(F.struct(*rows.columns, passing.alias("passed")), order).alias("b")).select("b.*")
    return best.withColumn("shortfall", F.greatest(F.lit(0.0), F.lit(least_detection) - F.col("detection")))


def targets(metrics: DataFrame) -> DataFrame:
    """(name, value, target, comparison, met) of the three accuracy targets, from one row of metrics."""
    goals = [("fixed_region_omissions", "omissions", 0.0, "="), ("body_recall", "recall", 0.99, ">="), ("false_positive_rate", "false_rate", 0.05, "<=")]
    rows = []
    for name, column, goal, how in goals:
        v = F.col(column).cast("double")
        met = {"=": v == goal, ">=": v >= goal, "<=": v <= goal}[how]
        rows.append(F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit(goal).alias("target"), F.lit(how).alias("comparison"), F.coalesce(met, F.lit(False)).alias("met")))
    return metrics.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def accuracy(gold: DataFrame, candidates: DataFrame, matched: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row: fixed-region recall and omissions, body recall and automatic rate, false positives, over all documents.

    gold: doc_id, id, required, fixed (counts towards the zero-omission target); candidates: doc_id, id, page_index, category, rects,
    action; matched: doc_id, gold_id, cand_id; negatives: doc_id, id, page_index, category, rects."""
    m = matched.select("doc_id", F.col("gold_id").alias("id"), "cand_id")
    c = candidates.select("doc_id", F.col("id").cast("string").alias("cand_id"), "action")
    g = gold.filter("required").withColumn("id", F.col("id").cast("string")).join(m, ["doc_id", "id"], "left").join(c, ["doc_id", "cand_id"], "left")
    seen, auto = F.col("cand_id").isNotNull(), F.coalesce(F.col("action") == "mask", F.lit(False))
    sums = g.agg(
        F.count_if("fixed").alias("fixed"), F.count_if(F.col("fixed") & seen).alias("fixed_found"), F.count_if(~F.col("fixed")).alias("body"),
        F.count_if(~F.col("fixed") & seen).alias("body_found"), F.count_if(~F.col("fixed") & auto).alias("body_automatic"),
    )
    false = hit_negatives(negatives, candidates).select("doc_id", "id").distinct().agg(F.count(F.lit(1)).alias("false"))
    parts = [sums, false, negatives.agg(F.count(F.lit(1)).alias("negatives"))]
    names = [n for part in parts for n in part.columns]
    rows = [part.select(*(F.col(n) if n in part.columns else F.lit(0).cast("long").alias(n) for n in names)) for part in parts]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*(F.sum(n).alias(n) for n in names))
    rates = {"omissions": F.col("fixed") - F.col("fixed_found"), "fixed_recall": ratio(F.col("fixed_found"), F.col("fixed")), "body_recall": ratio(F.col("body_found"), F.col("body"))}
    return out.withColumns(rates | {"automatic_rate": ratio(F.col("body_automatic"), F.col("body")), "false_rate": ratio(F.col("false"), F.col("negatives"))})
