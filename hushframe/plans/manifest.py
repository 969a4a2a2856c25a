"""Geometry analysis of files, end to end: words and drawings to segments, regions, occurrences, reviews and coverage.

Everything is a DataFrame keyed by document and page.  Pages are worked on one by one where order matters (lines,
candidates, approval boxes), files where pages follow one another (routing); the rest is joins and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scoring
from ..functions.text import page_number
from ..operators import approval, candidates, layout, review, routing, spans
from ..operators.tables import page_cells

# Words that open a document of a kind, where a header and a footer end, and what every kind must have.
START_WORDS = {"결재": "approval", "기안자": "approval", "수신": "recipient", "수신자": "recipient", "붙임": "attachment", "첨부": "attachment"}
REQUIRED = {"internal_review": ("approval", "approval_staff"), "official_dispatch": ("header_meta", "dispatch_metadata")}


@dataclass(frozen=True)
class Manifest:
    """What was found in a batch of files."""

    segments: DataFrame
    regions: DataFrame
    occurrences: DataFrame
    reviews: DataFrame
    coverage: DataFrame


def page_signals(words: DataFrame) -> DataFrame:
    """Routing evidence of every page: start words of the header, continuing page numbers, shared headers and footers.

    words: doc_id, page_index, page_height, start, end, text, rect."""
    keys = ["doc_id", "page_index"]
    lined = layout.lines(words.withColumn("word_index", F.col("start")), keys)
    boxes = layout.line_boxes(lined, keys).withColumnRenamed("rect", "_box")
    heights = words.groupBy(*keys).agg(F.max("page_height").alias("height"))
    texts = layout.reading_text(lined, keys).join(boxes, [*keys, "line"]).join(heights, keys)
    texts = texts.withColumn("band", layout.band(F.col("_box"), F.col("height")))
    first = F.substring_index("text", " ", 1)
    start = F.lit(None).cast("string")
    for word, signal in START_WORDS.items():
        start = F.when(F.regexp_replace(first, "[:：]$", "") == word, F.lit(signal)).otherwise(start)
    per = texts.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("band") == "header", start))).alias("start_signals"),
        F.max(F.when(F.col("band") == "footer", page_number(F.col("text")))).alias("page_number"),
        F.collect_set(F.when(F.col("band").isin("header", "footer") & (F.length("text") > 3), F.concat_ws(":", "band", "text"))).alias("signatures"),
    )
    going = spans.page_continuity(per)
    silent = F.size("start_signals") == 0
    continuity = F.when(silent, F.concat(F.array(F.lit("no_start_signal")), "signals")).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return going.select(
        *keys, "start_signals", continuity.alias("continuity_signals"), none.alias("routing_titles"), F.lit(None).cast("string").alias("routing_title_kind"),
        F.lit(1.0).alias("ocr_confidence"), F.lit(1.0).alias("boundary_confidence"),
    )


def _rects(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the rects of their words."""
    w = words.select(F.col("doc_id").alias("_d"), F.col("page_index").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("rect").alias("_r"))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page_index") == F.col("_p")) & (F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e"))
    keep = found.columns
    return found.join(w, on).groupBy(*keep).agg(F.array_sort(F.collect_list("_r")).alias("rects"))


#: Fixed value: the policy that identities name.
POLICY = "masking-policy-v1"


def occurrences(words: DataFrame, signers: DataFrame, auto: float = scoring.AUTO, revision: int = 1) -> DataFrame:
    """Values to mask or review: page candidates apart from approval values, and the approval values themselves."""
    keys = ["doc_id", "page_index"]
    found = _rects(candidates.candidates(words, auto), words).withColumn("rect", G.union(F.col("rects")))
    apart = layout.apart_from(found, signers, keys)
    evidence = scoring.body_name(F.lit(False), F.lit(True), F.lit(True), F.coalesce(F.col("distance"), F.lit(99.0)).cast("int"), F.col("in_box"), F.when(F.col("in_box"), "confirmed").otherwise("unconfirmed"), auto)
    named = signers.withColumn("s", evidence).select(
        *keys,
        F.when(F.col("kind") == "approval_staff", "APPROVAL_LINE").otherwise("DOC_META").alias("tag"),
        F.col("kind").alias("category"),
        F.lit("approval_layout").alias("source"),
        "value",
        F.when((F.col("kind") == "header_meta") | (F.col("s.action") == "auto_mask"), "mask").otherwise("review").alias("action"),
        F.col("s.score").alias("score"),
        F.array("rect").alias("rects"),
    )
    both = apart.select(*keys, "tag", "category", "source", "value", "action", "score", "rects").unionByName(named)
    # of equal finds the first source by name counts
    best = both.groupBy(*keys, "tag", "category", "value", "rects").agg(F.min(F.struct("source", "action", "score")).alias("b")).select(*keys, "tag", "category", "value", "rects", "b.*")
    document = F.when(F.col("doc_id").rlike(r"\A[0-9a-fA-F]{64}\z"), F.col("doc_id")).otherwise(F.sha2("doc_id", 256))
    identity = spans.occurrence_id(document, F.lit(revision), F.col("page_index"), F.col("rects"), F.col("tag"), F.col("category"), F.sha2("value", 256), F.col("source"), F.lit(POLICY), F.col("action"))
    return best.withColumns({"occurrence_id": identity, "value_hash": F.sha2("value", 256)}).drop("value")


def regions(signers: DataFrame, words: DataFrame) -> DataFrame:
    """Approval regions of a page: clusters of signers' rects, with their state."""
    keys = ["doc_id", "page_index"]
    heights = words.groupBy(*keys).agg(F.max("page_height").alias("height"))
    rows = signers.join(heights, keys)
    top = F.col("rect.y1") <= F.col("height") * layout.HEADER
    state = scoring.region_evidence(F.col("in_box"), F.lit(True), F.col("in_row") | F.col("in_box"), F.col("distance"), top | F.col("in_row"), F.lit(1.0))
    box = G.rect(F.min("rect.x0"), F.min("rect.y0"), F.max("rect.x1"), F.max("rect.y1"))
    return rows.withColumn("s", state).groupBy(*keys, "kind").agg(box.alias("rect"), F.max_by("s.state", "s.score").alias("state"), F.max("s.score").alias("score"), F.count(F.lit(1)).alias("n_values"))


def coverage(segments: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, kind, state) of every required kind of the documents' segments."""
    required = F.lit(None).cast("array<string>")
    for kind, names in REQUIRED.items():
        required = F.when(F.col("kind") == kind, F.array(*(F.lit(n) for n in names))).otherwise(required)
    wanted = segments.select("doc_id", F.explode(required).alias("need")).distinct()
    has = found.select(F.col("doc_id").alias("_d"), F.when(F.col("kind") == "header_meta", "dispatch_metadata").otherwise("approval").alias("_k"), F.col("state").alias("_s"))
    has = has.unionByName(found.select(F.col("doc_id").alias("_d"), F.col("kind").alias("_k"), F.col("state").alias("_s")))
    joined = wanted.join(has, (F.col("doc_id") == F.col("_d")) & (F.col("need") == F.col("_k")), "left")
    state: Column = F.when(F.col("_s") == "confirmed", "present").when(F.col("_s").isNotNull(), "indeterminate").otherwise("absent")
    return joined.groupBy("doc_id", F.col("need").alias("kind")).agg(review.coverage_state(state).alias("state"))


def analyse(words: DataFrame, drawings: DataFrame, auto: float = scoring.AUTO) -> Manifest:
    """The manifest of a batch of files.

    words: doc_id (string), page_index (int), page_text, page_height, start, end, text, rect.  drawings: doc_id, page_index, rect."""
    segments = routing.route(page_signals(words))
    signers = approval.approvals(words, drawings)
    found = occurrences(words, signers, auto)
    areas = regions(signers, words)
    covered = coverage(segments, areas)
    boundary = segments.filter("common_only").select("doc_id", F.lit("boundary").alias("kind"), F.col("segment_id").alias("target"), "page_start", "page_end", "common_only", "reasons")
    unsure = areas.filter("state <> 'confirmed'").select("doc_id", F.lit("region").alias("kind"), F.col("kind").alias("target"), F.col("page_index").alias("page_start"), F.col("page_index").alias("page_end"), F.lit(False).alias("common_only"), F.array(F.col("state")).alias("reasons"))
    values = found.filter("action = 'review'").select("doc_id", F.lit("occurrence").alias("kind"), F.col("occurrence_id").alias("target"), F.col("page_index").alias("page_start"), F.col("page_index").alias("page_end"), F.lit(False).alias("common_only"), F.array(F.col("category")).alias("reasons"))
    reviews = review.canonical_reviews(boundary.unionByName(unsure).unionByName(values))
    return Manifest(segments, areas, found, reviews, covered)


def table_cells(drawings: DataFrame) -> DataFrame:
    """The ruled cells of every page."""
    return page_cells(drawings)
