"""Reviews, manual actions, coverage and reports: what is counted, carried over and allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import clean
from .native import found


def canonical_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews of one target and page range as one, with the distinct reasons in order."""
    keys = ["doc_id", "kind", "target", "page_start", "page_end", "common_only"]
    return reviews.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.count(F.lit(1)).alias("n"))


def coverage_state(states: Column) -> Column:
    """present over indeterminate over absent, as an aggregate."""
    rank = F.when(states == "present", 2).when(states == "indeterminate", 1).otherwise(0)
    return F.element_at(F.array(F.lit("absent"), F.lit("indeterminate"), F.lit("present")), F.max(rank) + 1)


def effective_boxes(actions: DataFrame) -> DataFrame:
    """The action in force per document, page and rect (to a thousandth): the last one; repeats are not counted."""
    keys = ["doc_id", "page", "_r"]
    rounded = F.concat_ws(",", *(F.round(F.col("rect")[c] * 1000).cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")))
    rows = actions.withColumn("_r", rounded)
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = rows.withColumn("_same", F.lag("action").over(w).eqNullSafe(F.col("action")))
    out = rows.groupBy(*keys).agg(F.max_by("action", "idx").alias("action"), F.max_by("rect", "idx").alias("rect"), F.count_if(~F.col("_same")).alias("changes"), F.count_if("_same").alias("repeats"))
    return out.drop("_r")


def excluded(occurrences: DataFrame, manual: DataFrame) -> DataFrame:
    """Ids of occurrences that a manual restore names, or whose page and rects it has."""
    m = manual.filter("action = 'restore'")
    by_id = occurrences.join(m.select(F.col("occurrence_id").alias("_o")), F.col("occurrence_id") == F.col("_o"), "left_semi")
    rects = m.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), G.fingerprint(F.col("rects")).alias("_f"))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (G.fingerprint(F.col("rects")) == F.col("_f"))
    by_place = occurrences.filter("source <> 'manual_keyword'").join(rects, on, "left_semi")
    return by_id.select("doc_id", "occurrence_id").unionByName(by_place.select("doc_id", "occurrence_id")).distinct()


def mask_counts(occurrences: DataFrame, manual: DataFrame) -> DataFrame:
    """(doc_id, automatic, manual, restored, effective) masks of each document."""
    out = excluded(occurrences, manual).withColumn("e", F.lit(1))
    auto = occurrences.filter("action = 'mask'").join(out, ["doc_id", "occurrence_id"], "left")
    a = auto.groupBy("doc_id").agg(F.count(F.lit(1)).alias("automatic"), F.count("e").alias("restored"))
    m = manual.filter("action = 'mask'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("manual"))
    both = a.join(m, "doc_id", "full_outer").na.fill(0, ["automatic", "restored", "manual"])
    return both.withColumn("effective", F.col("automatic") - F.col("restored") + F.col("manual"))


def carried_decisions(prior: DataFrame, after: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions (keys, page, decision, kind) that hold for the same item of the next revision: unique on both sides,
    outside the affected pages, and no acknowledgement of a boundary."""
    pages = affected.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"))
    untouched = lambda df: df.join(pages, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left_anti")
    once = lambda df: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")
    old = once(untouched(prior.filter("kind <> 'boundary'"))).select(*keys, "decision")
    return once(untouched(after)).join(old, keys)


def save_gate(reviews: DataFrame, coverage: DataFrame, sessions: DataFrame) -> DataFrame:
    """(doc_id, gate, reasons): blocked without a sound session, advisory with something open, else eligible."""
    open_ = reviews.filter("status = 'pending'").select("doc_id", F.concat(F.lit("review_"), F.col("kind")).alias("reason"))
    unclear = coverage.filter("state = 'indeterminate'").select("doc_id", F.concat(F.lit("coverage_"), F.col("kind")).alias("reason"))
    reasons = open_.unionByName(unclear).groupBy("doc_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    joined = sessions.join(reasons, "doc_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    gate = F.when(~F.col("sound"), "blocked").when(F.size("reasons") > 0, "advisory").otherwise("eligible")
    return joined.select("doc_id", gate.alias("gate"), "reasons")


def blocked(rows: DataFrame, faults: str = "faults") -> DataFrame:
    """Documents of which any row is at fault, with the distinct reasons: one bad row blocks all."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(faults)))).alias("reasons"), F.bool_or(F.size(faults) > 0).alias("blocked"))


# Labels whose values a second opinion is asked on, with the weight of each tag.
_ASKED = (
    ("LEGAL_PARTY", 90, r"\b(?:원고|피고|신청인|피신청인|청구인|피청구인|항고인|피항고인)\b\s+([가-힣]{2,6})(?=[^가-힣]|$)"),
    ("APPROVAL_LINE", 70, r"\b(?:기안자|검토자|협조자|결재자|담당자|주무관|팀장|과장|국장)\b\s+([가-힣]{2,6})(?=[^가-힣]|$)"),
    ("COMPANY", 50, r"\b(?:회사명|법인명|상호|기관명)\b\s*[:：]?\s*([^\n\[\]]{2,40})"),
)


def candidates_for_model(masked: DataFrame, most: int | None = None) -> DataFrame:
    """Values that masked texts (doc_id, masked) still show after a label: (doc_id, tag, value, n, first, score, rank), ranked in each
    document by the label's weight, the value's length and how often it stands there; all, or the ``most`` best."""
    parts = []
    masked = masked.filter(F.col("masked").rlike("[가-힣]"))  # every label has Hangul
    for tag, weight, pattern in _ASKED:
        java = "(?Ud)" + pattern
        values, at = F.regexp_extract_all("masked", F.lit(java), F.lit(1)), found(F.col("masked"), pattern, tag)
        rows = masked.select("doc_id", F.explode(F.arrays_zip(values.alias("v"), F.transform(at, lambda h: h["start"]).alias("s"))).alias("z"))
        parts.append(rows.select("doc_id", F.lit(tag).alias("tag"), F.lit(weight).alias("weight"), clean(F.col("z.v")).alias("value"), F.col("z.s").alias("start")))
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("value <> '' AND NOT startswith(value, '[') AND NOT endswith(value, ']')")
    grouped = all_.groupBy("doc_id", "tag", "value", "weight").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))
    size = F.length(F.regexp_replace("value", r"(?U)\s+", ""))
    name = F.when(size.between(2, 4), 28).when(size.between(5, 6), 18).otherwise(8)
    firm = F.when(size.between(3, 12), 24).when(size.between(13, 24), 14).otherwise(6)
    scored = grouped.withColumn("score", F.col("weight") + F.when(F.col("tag") == "COMPANY", firm).otherwise(name) + F.least(F.col("n"), F.lit(5)) * 12)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("n"), "first", "value", "tag"))
    ranked = scored.withColumn("rank", rank).drop("weight")
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def safe_report(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Counts only: (keys, tag, action, n, distinct_values); values themselves never leave."""
    tag = F.when(F.col("tag") == "WEAK_PLACE", "PLACE").otherwise(F.col("tag"))
    return hits.groupBy(*keys, tag.alias("tag"), "action").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("distinct_values"))


def precondition(manifest: DataFrame, reviews: DataFrame) -> DataFrame:
    """(doc_id, ready): state, revision and hash as expected, and every blocking item with a pending review."""
    r = reviews.filter("status = 'pending'").select(F.col("doc_id").alias("_d"), F.col("target").alias("_t"), F.lit(True).alias("seen")).distinct()
    items = manifest.join(r, (F.col("doc_id") == F.col("_d")) & (F.col("blocking_item") == F.col("_t")), "left")
    met = F.col("blocking_item").isNull() | F.coalesce("seen", F.lit(False))
    sound = (F.col("state") == "ready") & (F.col("revision") == F.col("expected_revision")) & (F.col("hash") == F.col("expected_hash"))
    return items.groupBy("doc_id").agg(F.every(met & sound).alias("ready"))


def page_masks(occurrences: DataFrame, manual: DataFrame) -> DataFrame:
    """(doc_id, page, automatic, manual): masks of each page that has any."""
    a = occurrences.filter("action = 'mask'").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("automatic"))
    m = manual.filter("action = 'mask'").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("manual"))
    return a.join(m, ["doc_id", "page"], "full_outer").na.fill(0, ["automatic", "manual"])


def first_mask(occurrences: DataFrame, manual: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, page): the first page with a mask, a manual action or a candidate."""
    pages = [t.select("doc_id", "page") for t in (occurrences.filter("action = 'mask'"), manual, candidates)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).groupBy("doc_id").agg(F.min("page").alias("page"))


def review_totals(reviews: DataFrame) -> DataFrame:
    """(doc_id, pending, resolved, total)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return reviews.groupBy("doc_id").agg(n("pending").alias("pending"), n("resolved").alias("resolved"), F.count(F.lit(1)).alias("total"))


def coverage_range(regions: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, kind, page_start, page_end): the pages of a kind's regions, or else of the kind's segments."""
    r = regions.groupBy("doc_id", "kind").agg(F.min("page").alias("ra"), F.max("page").alias("rb"))
    s = segments.groupBy("doc_id", "kind").agg(F.min("page_start").alias("sa"), F.max("page_end").alias("sb"))
    both = r.join(s, ["doc_id", "kind"], "full_outer")
    return both.select("doc_id", "kind", F.coalesce("ra", "sa").alias("page_start"), F.coalesce("rb", "sb").alias("page_end"))


def expected_masks(occurrences: DataFrame, manual: DataFrame, applied: DataFrame) -> DataFrame:
    """(doc_id, expected, applied, complete): masks that a final document must have, against those it has."""
    want = mask_counts(occurrences, manual).select("doc_id", F.col("effective").alias("expected"))
    has = applied.groupBy("doc_id").agg(F.count(F.lit(1)).alias("applied"))
    out = want.join(has, "doc_id", "full_outer").na.fill(0, ["expected", "applied"])
    return out.withColumn("complete", F.col("expected") == F.col("applied"))


def restores_on_masks(manual: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Restore actions (doc_id, page, action, rect) that overlap a confirmed mask of their page."""
    o = occurrences.filter("action = 'mask'").select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.explode("rects").alias("_r"))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & G.overlaps(F.col("rect"), F.col("_r"))
    return manual.filter("action = 'restore'").join(o, on, "left_semi")


def save_warnings(reviews: DataFrame, coverage: DataFrame) -> DataFrame:
    """(doc_id, kind, why): pending reviews, and kinds of unclear coverage that no pending review names."""
    pending = reviews.filter("status = 'pending'").select("doc_id", "kind", F.lit("review_pending").alias("why")).distinct()
    unclear = coverage.filter("state = 'indeterminate'").select("doc_id", "kind")
    return pending.unionByName(unclear.join(pending, ["doc_id", "kind"], "left_anti").withColumn("why", F.lit("coverage_indeterminate")))


def kept_exclusions(exclusions: DataFrame, masks: DataFrame) -> DataFrame:
    """Carried exclusions (doc_id, page, rect, reasons) with a conflict named where a keyword or manual mask overlaps: the
    row stays, the mask wins."""
    m = masks.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("rect").alias("_r"))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & G.overlaps(F.col("rect"), F.col("_r"))
    keys = [F.col(c) for c in exclusions.columns]
    out = exclusions.join(m, on, "left").groupBy(*keys).agg(F.count("_d").alias("_n")).withColumn("_hit", F.col("_n") > 0).drop("_n")
    reasons = F.when(F.col("_hit"), F.array_union("reasons", F.array(F.lit("mask_overlaps_exclusion")))).otherwise(F.col("reasons"))
    return out.withColumns({"reasons": reasons, "effective": ~F.col("_hit")}).drop("_hit")


def anonymised(rows: DataFrame, columns: list[str], salt: str) -> DataFrame:
    """Identifiers replaced by salted hashes, equal ones alike."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.lit("id_"), F.left(F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256), F.lit(16)))) for c in columns})


def same_queue(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, same): whether two review queues (doc_id, ordinal, columns) have equal rows in equal places."""
    both = left.select("doc_id", "ordinal", F.struct(*columns).alias("l")).join(right.select("doc_id", "ordinal", F.struct(*columns).alias("r")), ["doc_id", "ordinal"], "full_outer")
    return both.groupBy("doc_id").agg(F.every(F.col("l").eqNullSafe(F.col("r"))).alias("same"))


def page_ordinals(targets: DataFrame, order: list[str]) -> DataFrame:
    """Review targets (doc_id, page, ...) with their ``nth`` of the page, from 1 on."""
    return targets.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order)))


def target_rects(reviews: DataFrame, occurrences: DataFrame, regions: DataFrame, segments: DataFrame) -> DataFrame:
    """Reviews (doc_id, review_id, kind, target) with where their target lies: an occurrence's or region's page and rects, or a segment's first page."""
    places = occurrences.select("doc_id", F.lit("occurrence").alias("kind"), F.col("occurrence_id").alias("target"), "page", "rects")
    places = places.unionByName(regions.select("doc_id", F.lit("region").alias("kind"), F.col("region_id").alias("target"), "page", "rects"))
    none = F.lit(None).cast(places.schema["rects"].dataType)
    places = places.unionByName(segments.select("doc_id", F.lit("segment").alias("kind"), F.col("segment_id").alias("target"), F.col("page_start").alias("page"), none.alias("rects")))
    return reviews.join(places, ["doc_id", "kind", "target"], "left")
