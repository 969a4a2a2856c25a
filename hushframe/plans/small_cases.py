"""More queries over literal rows: scalar functions, and operators on small tables, each with its expected result.

A scalar case names the inventory row it shows; its result is given as text (arrays and structs as JSON)."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scoring
from ..functions import text as X
from ..operators import chunks, evaluation, extensions, layout, processor, protocol, regions, residual, review, routing, spans
from ..sources import archives, files
from .cases import _RECTS, expected, registry

QUERIES, SQL, _table = registry()
_RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def _scalars(name: str, doc: str, cases: list[tuple[str, str | None]], columns: Callable[[], list[Column]]) -> None:
    """Register a query of scalar cases (case, expected text) and their columns, which need a session to be made."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [F.struct(F.lit(case).alias("case_id"), c.cast("string").alias("result")) for (case, _), c in zip(cases, columns(), strict=True)]
        return spark.range(1).select(F.inline(F.array(*rows)))

    query.__name__, query.__doc__ = name, doc
    QUERIES[name] = query
    SQL[name] = f"SELECT case_id, result::VARCHAR AS result FROM ({expected(('case_id', 'result'), cases)})"


def _box(*v: float) -> Column:
    return G.rect(*(F.lit(float(x)) for x in v))


def _texts(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


# --- strings ---------------------------------------------------------------------------------------------------------------------

_STRINGS = [
    ("X1 clean", "a b"), ("X2 compact", "가나12"), ("X7 dashes", "1-2-34"), ("X8 inside token", "true"), ("X8 word of its own", "false"),
    ("X13 hmac", X.hmac_reference("값", b"k")), ("X22 page number", "3"), ("X22 of ten", "3"), ("X22 none", None),
    ("X29 yes", "true"), ("X29 answer line", "false"), ("X29 none", None), ("X28 codes", '["a","c"]'), ("U2 value hidden", "x value: [REDACTED]"),
    ("X6 aligned", '{"text":"a b c","offsets":[1,2,5,6,7]}'), ("X6 blank", '{"text":"","offsets":[]}'), ("X26 in bounds", "50"), ("X26 under", "1200"), ("X27 metadata", '{"a":[1,{"c":null}],"b":1.5}'), ("X27 no json", None),
    ("F-5 quoted", "true"), ("F-5 closed before", "false"), ("F-9 evidence", "pattern"),
]


def _string_cases() -> list[Column]:
    lit = F.lit
    columns = [
        X.clean(lit("  a   b ;:")), X.compact(lit("가 나-1·2")), X.plain_dashes(lit("1–2 － 3​4")), X.inside_token(lit("ab12"), lit(1), lit(3)), X.inside_token(lit("a b c"), lit(2), lit(3)),
        X.hmac_sha256(lit("값"), b"k"), X.page_number(lit("- 3 -")), X.page_number(lit("3/10")), X.page_number(lit("page 3")),
        X.yes_or_no(lit("Yes.")), X.yes_or_no(lit("I think\nAnswer: no, not yes")), X.yes_or_no(lit("maybe")), F.to_json(X.safe_codes(_texts("a", "b", "c", "a"), ["c", "a"])), X.without_values(lit("x value: secret 1")),
        F.to_json(X.aligned(lit(" a \n\tb c  "))), F.to_json(X.aligned(lit("  "))), X.bounded(lit(50), 1200, 40), X.bounded(lit(39), 1200, 40), X.canonical_metadata(lit('{"b": 1.5, "a": [1, {"c": NaN}]}')), X.canonical_metadata(lit("{")),
        X.quoted(lit("“abc”"), lit(1), lit(4)), X.quoted(lit("“x” abc"), lit(4), lit(7)), X.evidence(lit("regex_x"), {"regex": "pattern", "re": "other"}),
    ]
    return columns


# --- geometry ---------------------------------------------------------------------------------------------------------------------

_GEOMETRY = [
    ("X14 valid", "true"), ("X14 empty", "false"), ("X14 not a number", "false"), ("X16 iou", "0.25"), ("X18 faults", '["incomplete_coverage","protected_neighbor_intrusion"]'),
    ("X18 none applied", '["missing_geometry"]'), ("X19 distance", "5.0"), ("X20 gap", "3.0"), ("X20 gap of touching", "0.0"), ("X21 same row", "true"),
    ("X21 other row", "false"), ("F-7 part of a word", '{"x0":4.0,"y0":0.0,"x1":8.0,"y1":10.0}'), ("A7 union", '{"x0":0.0,"y0":0.0,"x1":15.0,"y1":15.0}'), ("J4 contains", "true"),
    ("J5 overlap", "true"), ("J5 touching is none", "false"), ("X15 micro", "1500001"),
]


def _geometry_cases() -> list[Column]:
    a, b = _box(0, 0, 10, 10), _box(5, 5, 15, 15)
    columns = [
        G.valid(a), G.valid(_box(0, 0, 0, 1)), G.valid(_box(float("nan"), 0, 1, 1)), G.iou(a, _box(6, 0, 16, 10)),
        F.to_json(G.faults(F.array(a), F.array(b), F.array(_box(12, 12, 20, 20)))), F.to_json(G.faults(F.array(a), F.array().cast(_RECTS), F.array(a))), G.distance(a, _box(13, 14, 20, 20)),
        G.gap(a, _box(13, 14, 20, 20)), G.gap(a, _box(10, 0, 20, 5)), G.same_row(a, _box(20, 3, 30, 13)), G.same_row(a, _box(20, 30, 30, 40)), F.to_json(G.part_of(a, F.lit(2), F.lit(4), F.lit(5))),
        F.to_json(G.union(F.array(a, b))), G.contains(a, _box(1, 1, 9, 9)), G.overlaps(a, b), G.overlaps(a, _box(10, 0, 20, 10)), G.micro(F.lit(1.5000007)),
    ]
    return columns


# --- scores -------------------------------------------------------------------------------------------------------------------------

_SCORES = [
    ("F1 role and surroundings", "0.95 auto_mask approval_role,label_boundary,label_distance,page_position,confirmed_region"), ("F1 little", "0.1 preserve label_boundary"),
    ("F2 region", "0.95 auto_mask region_dictionary,region_label,hierarchical_region,exact_boundary"), ("F2 quoted region", "0.95 review region_dictionary,region_label,hierarchical_region,exact_boundary,quoted_context"),
    ("F2 dictionary alone", "0.4 review region_dictionary"), ("F3 institution", "0.95 auto_mask institution_pattern,institution_label,exact_boundary,independent_context"),
    ("F4 address is for review", "0.95 review address_pattern,address_label,footer_contact_context,exact_boundary"), ("F6 all evidence", "10 confirmed "), ("F6 little evidence", "3 unconfirmed ocr_confidence_missing,box_structure_missing,layout_structure_missing,label_value_distance_missing,page_position_evidence_missing"),
]


def _score_cases() -> list[Column]:
    t, f = F.lit(True), F.lit(False)
    shown = lambda s: F.concat_ws(" ", s["score"].cast("string"), s["action"], F.array_join(s["reasons"], ","))
    stated = lambda s: F.concat_ws(" ", s["score"].cast("string"), s["state"], F.array_join(s["missing"], ","))
    columns = [
        shown(scoring.body_name(f, t, t, F.lit(3), t, F.lit("confirmed"))), shown(scoring.body_name(f, f, t, F.lit(None).cast("int"), f, F.lit("unconfirmed"))),
        shown(scoring.region_value(t, t, t, f)), shown(scoring.region_value(t, t, t, t)), shown(scoring.region_value(f, f, f, f)), shown(scoring.institution_value(t, t, t, t, f)),
        shown(scoring.institution_address(t, t, t, t)), stated(scoring.region_evidence(t, t, t, F.lit(50.0), t, F.lit(0.9))), stated(scoring.region_evidence(f, t, f, F.lit(None).cast("double"), f, F.lit(None).cast("double"))),
    ]
    return columns


_scalars("string_function_cases", "String and hash functions on single values.", _STRINGS, _string_cases)
_scalars("geometry_cases", "Functions of rects.", _GEOMETRY, _geometry_cases)
_scalars("score_cases", "Scores, actions and reasons from evidence.", _SCORES, _score_cases)


# --- spans --------------------------------------------------------------------------------------------------------------------------

@_table("united_hit_cases", ("start_at", "action", "sources"), [(0, "mask", "rule,other"), (5, "review", "other"), (9, "review", "rule")])
def united_hit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, F-2, F-3: hits of the rules and of another detector as one."""
    schema = "doc_id int, start int, end int, tag string, value string, action string, source string"
    a = spark.createDataFrame([(1, 0, 3, "NAME", "x", "review", "rule"), (1, 9, 12, "NAME", "z", "review", "rule")], schema)
    b = spark.createDataFrame([(1, 0, 3, "NAME", "x", "mask", "other"), (1, 5, 6, "NAME", "y", "review", "other")], schema)
    return spans.unite(a, b, "doc_id").select(F.col("start").alias("start_at"), "action", F.array_join("sources", ",").alias("sources"))


@_table("word_span_cases", ("span_id", "n_words", "first_word", "last_word"), [(7, 2, 1, 2), (9, 1, 0, 0)])
def word_span_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that begin and end with words."""
    words = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 8), (1, 2, 9, 12)], "doc_id int, word_index int, start int, end int")
    found = spark.createDataFrame([(1, 7, 4, 12), (1, 8, 4, 10), (1, 9, 0, 3)], "doc_id int, span_id int, start int, end int")
    return spans.on_words(found, words, ["doc_id"]).select("span_id", "n_words", "first_word", "last_word")


@_table("carried_occurrence_cases", ("prior_id", "after_id"), [("a", "p")])
def carried_occurrence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two revisions that match each other only."""
    schema = f"id string, page int, tag string, rect {_RECT}"
    prior = spark.createDataFrame([("a", 1, "X", (0.0, 0.0, 10.0, 10.0)), ("b", 1, "X", (50.0, 0.0, 60.0, 10.0)), ("c", 2, "X", (0.0, 0.0, 10.0, 10.0))], schema)
    after = spark.createDataFrame([("p", 1, "X", (0.4, 0.0, 10.0, 10.0)), ("q", 1, "X", (50.1, 0.0, 60.0, 10.0)), ("r", 1, "X", (50.2, 0.0, 60.0, 10.0)), ("s", 2, "Y", (0.0, 0.0, 10.0, 10.0))], schema)
    return spans.carried(prior, after, ["page", "tag"])


@_table("token_value_cases", ("tag", "nth", "value"), [("NAME", 1, "가나"), ("PHONE", 1, "010"), ("NAME", 2, "다라"), ("NAME", 3, None)])
def token_value_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value behind each token of a masked text."""
    masked = spark.createDataFrame([(1, "[NAME] [PHONE] [NAME] [NAME]")], "doc_id int, masked string")
    hits = spark.createDataFrame([(1, "NAME", 9, "다라"), (1, "NAME", 0, "가나"), (1, "PHONE", 4, "010")], "doc_id int, tag string, start int, value string")
    return spans.token_values(masked, hits, "doc_id").select("tag", "nth", "value")


@_table("page_continuity_cases", ("page_index", "signals"), [(0, ""), (1, "page_number_sequence,repeated_header_footer"), (2, ""), (3, "repeated_header_footer")])
def page_continuity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that follow the one before by number or by a shared line."""
    pages = spark.createDataFrame([("d", 0, 4, ["h"]), ("d", 1, 5, ["h", "f"]), ("d", 2, 9, ["x"]), ("d", 3, None, ["x"])], "doc_id string, page_index int, page_number int, signatures array<string>")
    return spans.page_continuity(pages).select("page_index", F.array_join("signals", ",").alias("signals"))


# --- chunks and context --------------------------------------------------------------------------------------------------------------

_PAGED = "=== PAGE 1 ===\nFirst one. Second sentence here. Third sentence of them.\n=== PAGE 2 ===\nLast words."


@_table("located_value_cases", ("ordinal", "value", "start_at", "end_at"), [(0, "홍길동", 0, 3), (1, "홍길동", 9, 12), (2, "없음", -1, -1), (3, "가 나", 5, 8), (4, "홍길동", -1, -1)])
def located_value_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without offsets, found one after another; white space between words may differ."""
    docs = spark.createDataFrame([(1, "홍길동, 가\n나 홍길동")], "doc_id int, text string")
    values = spark.createDataFrame([(1, 0, "홍길동"), (1, 1, "홍길동"), (1, 2, "없음"), (1, 3, "가 나"), (1, 4, "홍길동")], "doc_id int, ordinal int, value string")
    return chunks.located(docs, values).select("ordinal", "value", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@_table("matching_context_cases", ("value", "chunk_index", "score", "how"), [("Last words", 2, 100, "exact"), ("LAST  WORDS", 2, 90, "normalized"), ("second of here", 1, 60, "keyword"), ("First one", 0, 100, "exact")])
def matching_context_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that answers a value best."""
    found = spark.createDataFrame([(1, 0, "First one."), (1, 1, "Second sentence here. Words at last."), (1, 2, "Last words.")], "doc_id int, chunk_index int, text string")
    values = spark.createDataFrame([(1, "Last words"), (1, "LAST  WORDS"), (1, "second of here"), (1, "zzz"), (1, "First one")], "doc_id int, value string")
    return chunks.matching_context(values, found).select("value", "chunk_index", "score", "how")


@_table("scan_range_cases", ("page_start", "page_end", "is_scan"), [(0, 1, False), (2, 3, True), (4, 5, False)])
def scan_range_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment cut where scanned pages begin and end."""
    found = spark.createDataFrame([("d", "s", "k", 0, 5)], "doc_id string, segment_id string, kind string, page_start int, page_end int")
    return routing.split_at_scans(found, spark.createDataFrame([("d", 2), ("d", 3)], "doc_id string, page int")).select("page_start", "page_end", "is_scan")


@_table("corrected_segment_cases", ("page_start", "page_end", "kind", "state"), [(0, 3, "a", "confirmed"), (4, 7, "c", "confirmed"), (8, 9, "b", "review_required")])
def corrected_segment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments after a user's correction."""
    found = spark.createDataFrame([("d", "a", "confirmed", 0, 5), ("d", "b", "review_required", 6, 9)], "doc_id string, kind string, state string, page_start int, page_end int")
    fixed = routing.corrected(found, spark.createDataFrame([("d", 4, 7, "c")], "doc_id string, page_start int, page_end int, kind string"))
    return fixed.select("page_start", "page_end", "kind", "state")


# --- reviews ---------------------------------------------------------------------------------------------------------------------------

_OCC = f"doc_id int, occurrence_id string, page int, rects {_RECTS}, action string, source string"


def _occurrences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, f"o{k}", k // 2, [(float(k), 0.0, k + 1.0, 1.0)], "mask", "rule") for k in range(4)], _OCC)


def _manual(spark: SparkSession) -> DataFrame:
    rows = [(1, "o1", 0, [(9.0, 0.0, 10.0, 1.0)], "restore"), (1, None, 1, [(2.0, 0.0, 3.0, 1.0)], "restore"), (1, None, 0, [(5.0, 5.0, 6.0, 6.0)], "mask"), (2, None, 3, [(5.0, 5.0, 6.0, 6.0)], "mask")]
    return spark.createDataFrame(rows, f"doc_id int, occurrence_id string, page int, rects {_RECTS}, action string")


@_table("mask_count_cases", ("doc_id", "automatic", "restored", "manual", "effective"), [(1, 4, 2, 1, 3), (2, 0, 0, 1, 1)])
def mask_count_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a document after manual restores and masks."""
    return review.mask_counts(_occurrences(spark), _manual(spark)).select("doc_id", "automatic", "restored", "manual", "effective")


@_table("page_mask_cases", ("doc_id", "page", "automatic", "manual"), [(1, 0, 2, 1), (1, 1, 2, 0), (2, 3, 0, 1)])
def page_mask_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of each page."""
    return review.page_masks(_occurrences(spark), _manual(spark))


@_table("save_gate_cases", ("doc_id", "gate", "reasons"), [(1, "advisory", "coverage_approval,review_boundary"), (2, "eligible", ""), (3, "blocked", "")])
def save_gate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be saved."""
    reviews = spark.createDataFrame([(1, "boundary", "pending"), (2, "x", "resolved")], "doc_id int, kind string, status string")
    coverage = spark.createDataFrame([(1, "approval", "indeterminate"), (2, "approval", "present")], "doc_id int, kind string, state string")
    sessions = spark.createDataFrame([(1, True), (2, True), (3, False)], "doc_id int, sound boolean")
    return review.save_gate(reviews, coverage, sessions).select("doc_id", "gate", F.array_join("reasons", ",").alias("reasons"))


@_table("canonical_review_cases", ("target", "reasons", "n"), [("t", "a,b,c", 2), ("u", "a", 1)])
def canonical_review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: reviews of one target as one."""
    rows = spark.createDataFrame([(1, "k", "t", 0, 1, False, ["b", "a"]), (1, "k", "t", 0, 1, False, ["c", "a"]), (1, "k", "u", 0, 1, False, ["a"])], "doc_id int, kind string, target string, page_start int, page_end int, common_only boolean, reasons array<string>")
    return review.canonical_reviews(rows).select("target", F.array_join("reasons", ",").alias("reasons"), "n")


@_table("carried_decision_cases", ("doc_id", "target", "decision"), [(1, "a", "keep")])
def carried_decision_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that hold for the next revision."""
    prior = spark.createDataFrame([(1, "a", 0, "keep", "value"), (1, "b", 1, "drop", "value"), (1, "c", 0, "keep", "boundary"), (1, "d", 0, "keep", "value"), (1, "d", 0, "drop", "value")], "doc_id int, target string, page int, decision string, kind string")
    after = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 0), (1, "d", 0)], "doc_id int, target string, page int")
    affected = spark.createDataFrame([(1, 1)], "doc_id int, page int")
    return review.carried_decisions(prior, after, affected, ["doc_id", "target"]).select("doc_id", "target", "decision")


@_table("save_warning_cases", ("doc_id", "kind", "why"), [(1, "boundary", "review_pending"), (1, "approval", "coverage_indeterminate")])
def save_warning_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still open when a document is saved."""
    reviews = spark.createDataFrame([(1, "boundary", "pending"), (1, "value", "resolved")], "doc_id int, kind string, status string")
    coverage = spark.createDataFrame([(1, "approval", "indeterminate"), (1, "boundary", "indeterminate"), (1, "header", "present")], "doc_id int, kind string, state string")
    return review.save_warnings(reviews, coverage)


@_table("review_total_cases", ("doc_id", "pending", "resolved", "total"), [(1, 2, 1, 3), (2, 0, 1, 1)])
def review_total_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and closed reviews."""
    rows = [(1, "pending"), (1, "pending"), (1, "resolved"), (2, "resolved")]
    return review.review_totals(spark.createDataFrame(rows, "doc_id int, status string"))


@_table("coverage_range_cases", ("doc_id", "kind", "page_start", "page_end"), [(1, "a", 2, 4), (1, "b", 0, 9)])
def coverage_range_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a kind."""
    regions_ = spark.createDataFrame([(1, "a", 4), (1, "a", 2)], "doc_id int, kind string, page int")
    segments = spark.createDataFrame([(1, "a", 0, 9), (1, "b", 0, 9)], "doc_id int, kind string, page_start int, page_end int")
    return review.coverage_range(regions_, segments)


@_table("blocked_cases", ("doc_id", "reasons", "blocked"), [(1, "x,y", True), (2, "", False)])
def blocked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One faulty row blocks its document."""
    rows = spark.createDataFrame([(1, ["y", "x"]), (1, []), (2, [])], "doc_id int, faults array<string>")
    return review.blocked(rows).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "blocked")


# --- evaluation and protocol -----------------------------------------------------------------------------------------------------------

@_table("fixed_region_cases", ("case_id", "counts"), [(0, True), (1, False), (2, True), (3, False), (4, True), (5, False)])
def fixed_region_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an occurrence counts towards the zero-omission target."""
    rows = [(0, None, "user", None, None), (1, "review_required", "automatic", "confirmed", "automatic"), (2, "confirmed", "automatic", None, None), (3, None, None, None, None), (4, None, None, "confirmed", "automatic"), (5, None, None, "confirmed", None)]
    df = spark.createDataFrame(rows, "case_id int, rs string, rsrc string, ss string, ssrc string")
    return df.select("case_id", evaluation.in_fixed_region(*(F.col(c) for c in ("rs", "rsrc", "ss", "ssrc"))).alias("counts"))


@_table("occurrence_match_cases", ("gold_id", "cand_id"), [("g0", "c0"), ("g1", "c1"), ("g2", "c2")])
def occurrence_match_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rects, then offsets; the second gold's only candidate is the first's favourite."""
    schema = f"doc_id string, id string, page_index int, category string, text_hash string, rects {_RECTS}, start int, end int"
    gold = [("d", "g0", 0, "n", None, [(0.0, 0.0, 10.0, 10.0)], None, None), ("d", "g1", 0, "n", None, [(4.0, 0.0, 14.0, 10.0)], None, None), ("d", "g2", None, "n", None, [], 5, 9), ("d", "g3", 0, "n", "h", [(0.0, 0.0, 10.0, 10.0)], None, None)]
    found = [("d", "c0", 0, "n", None, [(-1.0, 0.0, 7.0, 10.0)], None, None), ("d", "c1", 0, "n", None, [(2.0, 0.0, 12.0, 10.0)], None, None), ("d", "c2", None, "n", None, [], 8, 12), ("d", "c3", 1, "n", None, [(0.0, 0.0, 10.0, 10.0)], None, None)]
    return evaluation.one_to_one(evaluation.compatible(spark.createDataFrame(gold, schema), spark.createDataFrame(found, schema))).select("gold_id", "cand_id")


@_table("segment_match_cases", ("gold_id", "cand_id"), [("g", "c")])
def segment_match_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of one type whose pages are nearly the same."""
    schema = "doc_id string, id string, type string, pages array<int>"
    gold = spark.createDataFrame([("d", "g", "a", [0, 1, 2, 3, 4]), ("d", "h", "a", [5, 6])], schema)
    found = spark.createDataFrame([("d", "c", "a", [0, 1, 2, 3]), ("d", "e", "b", [5, 6]), ("d", "f", "a", [6, 7])], schema)
    return evaluation.segment_pairs(gold, found).select("gold_id", "cand_id")


@_table("target_cases", ("name", "target", "comparison", "met"), [("fixed_region_omissions", 0.0, "=", True), ("body_recall", 0.99, ">=", False), ("false_positive_rate", 0.05, "<=", True)])
def target_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three accuracy targets."""
    return evaluation.targets(spark.createDataFrame([(0, 0.98, 0.05)], "omissions int, recall double, false_rate double")).select("name", "target", "comparison", "met")


@_table(
    "gold_violation_cases",
    ("id", "violation"),
    [("b", "unknown_region"), ("b", "offsets_outside_segment"), ("c", "unknown_segment"), ("c", "rect_outside_page"), ("c", "repeated_occurrence_id"), ("n", "name_negative_category"), ("s2", "segments_not_contiguous")],
)
def gold_violation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not fit together in a gold manifest."""
    pages = spark.createDataFrame([("d", 0, 100.0, 100.0)], "doc_id string, page_index int, width double, height double")
    segments = spark.createDataFrame([("d", "s1", 0, "body", 0, 10), ("d", "s2", 0, "table", 12, 20)], "doc_id string, id string, page_index int, type string, start int, end int")
    known = spark.createDataFrame([("d", "r1")], "doc_id string, id string")
    ok = [(0.0, 0.0, 5.0, 5.0)]
    rows = [("d", "a", 0, "s1", None, ok, 0, 3), ("d", "b", 0, "s2", None, ok, 12, 25), ("d", "c", 1, "s9", "r1", [(0.0, 0.0, 500.0, 5.0)], 0, 1), ("d", "c", 0, "s2", "r1", ok, 13, 14)]
    occurrences = spark.createDataFrame(rows, f"doc_id string, id string, page_index int, segment_id string, region_id string, rects {_RECTS}, start int, end int")
    negatives = spark.createDataFrame([("d", "n", "name", "place")], "doc_id string, id string, kind string, category string")
    return protocol.gold_violations(pages, segments, known, occurrences, negatives).select("id", "violation")


_COUNTERS = "doc_id string, status string, " + ", ".join(f"{c} int" for c in protocol.COUNTERS)
_PREDICTED = [("a", "ok", 10, 9, 5, 4, 1, 0, 0), ("b", "ok", 10, 10, 10, 0, 0, 0, 0), ("c", "failed_closed", 1, 0, 0, 0, 0, 0, 0), ("d", "ok", 1, 2, 3, 0, 1, 2, 0)]


@_table("prediction_violation_cases", ("doc_id", "n"), [("c", 1), ("d", 4)])
def prediction_violation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible counts in out-of-fold predictions."""
    return protocol.prediction_violations(spark.createDataFrame(_PREDICTED, _COUNTERS)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_table("prediction_coverage_cases", ("doc_id", "n"), [("c", None), ("d", None), ("z", 0)])
def prediction_coverage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not predicted exactly once."""
    return protocol.coverage_violations(spark.createDataFrame(_PREDICTED, _COUNTERS), spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string"))


@_table("roll_up_cases", ("gold", "detected", "recall", "automatic_rate", "false_rate"), [(20, 19, 0.95, 0.75, 0.25)])
def roll_up_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of all folds and their rates."""
    return protocol.roll_up(spark.createDataFrame(_PREDICTED[:2], _COUNTERS)).select("gold", "detected", "recall", "automatic_rate", "false_rate")


@_table("chosen_trial_cases", ("auto", "review", "detection", "passed"), [(0.8, 0.5, 0.995, True)])
def chosen_trial_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold pair chosen from trials that both sources have."""
    trial = "auto double, review double, hits int, gold int, false int, negatives int"
    one = spark.createDataFrame([(0.8, 0.5, 99, 100, 1, 50), (0.9, 0.5, 100, 100, 9, 50), (0.7, 0.5, 1, 1, 0, 1)], trial)
    two = spark.createDataFrame([(0.8, 0.5, 100, 100, 1, 50), (0.9, 0.5, 100, 100, 9, 50)], trial)
    return protocol.choose(protocol.threshold_evidence(one, two)).select("auto", "review", "detection", "passed")


# --- residual search and regions ----------------------------------------------------------------------------------------------------------

@_table("residual_cases", ("doc_id", "value", "exact", "fuzzy"), [(1, "홍 길동", 1, 0), (1, "010-1234-5678", 0, 1), (1, "900101", 0, 2), (2, "a.b(c", 1, 1)])
def residual_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that output texts still hold."""
    hits = spark.createDataFrame([(1, "NAME", "홍 길동"), (1, "PHONE", "010-1234-5678"), (1, "RRN", "900101"), (2, "NAME", "a.b(c")], "doc_id int, tag string, value string")
    texts = spark.createDataFrame([(1, "홍길동 왔다 010 – 1234 – 5678 x900101 9001012"), (2, "see a.b(c here and xa.b(c"), (3, "")], "doc_id int, text string")
    return residual.residuals(residual.search_terms(hits), texts).select("doc_id", "value", "exact", "fuzzy")


@_table(
    "region_dictionary_cases",
    ("kind", "term"),
    [("sido", "서울특별시"), ("sido", "세종특별자치시"), ("sido", "경기도"), ("sigungu", "중구"), ("sigungu", "용인시 처인구"), ("sigungu", "처인구"), ("eupmyeondong", "태평동"), ("eupmyeondong", "반곡동"), ("single_tier_sido", "세종특별자치시"), ("ri", "봉명리"), ("weak_place_names", "태평동"), ("weak_place_names", "반곡동"), ("weak_place_names", "봉명리")],
)
def region_dictionary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, A7, F-12: the region dictionary from its rows."""
    names = [("1100000000", "서울특별시"), ("1114000000", "서울특별시 중구"), ("1114010300", "서울특별시 중구 태평동"), ("3600000000", "세종특별자치시"), ("3611010100", "세종특별자치시 반곡동"), ("4100000000", "경기도"), ("4146000000", "경기도 용인시 처인구"), ("4146025021", "경기도 용인시 처인구 남사읍 봉명리")]
    rows = [(c, n, "존재") for c, n in names] + [("4146025022", "경기도 용인시 처인구 남사읍 폐지리", "폐지")]
    return regions.dictionary(spark.createDataFrame(rows, "code string, name string, status string")).select("kind", "term")


@_table("reading_text_cases", ("line", "text"), [(0, "0 1 2"), (1, "3 4"), (2, "5")])
def reading_text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page as lines of text."""
    places = [(0, 0), (10, 3), (20, 1), (0, 20), (8, 22), (0, 60)]
    words = spark.createDataFrame([(1, i, (float(x), float(y), x + 5.0, y + 10.0)) for i, (x, y) in enumerate(places)], f"doc_id int, word_index int, rect {_RECT}")
    return layout.reading_text(layout.lines(words.withColumn("text", F.col("word_index").cast("string")), ["doc_id"]), ["doc_id"]).select("line", "text")


# --- what plugs in -------------------------------------------------------------------------------------------------------------------

def _upper(text: str) -> list[tuple[int, int, str, float | None]]:
    """A detector of words in capitals; it fails on texts with an exclamation mark."""
    if "!" in text:
        raise ValueError
    return [(i, i + len(w), "UPPER", 0.5) for i, w in _words(text) if w.isupper()]


def _words(text: str) -> list[tuple[int, str]]:
    at, out = 0, []
    for w in text.split():
        at = text.index(w, at)
        out.append((at, w))
        at += len(w)
    return out


@_table("detector_hook_cases", ("doc_id", "found", "failed"), [(1, "2-4 UPPER,7-8 UPPER", False), (2, "", True), (3, "", False)])
def detector_hook_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.16: a detector of the caller's own; one that fails on a text has found none of its values."""
    docs = spark.createDataFrame([(1, "a BC d E"), (2, "STOP !"), (3, None)], "doc_id int, text string")
    shown = F.transform("found", lambda h: F.concat(h["start"], F.lit("-"), h["end"], F.lit(" "), h["tag"]))
    return extensions.detect_with(docs, _upper).select("doc_id", F.array_join(shown, ",").alias("found"), F.col("detector_failed").alias("failed"))


def _shout(chunk: str, options: object) -> tuple[str, dict[str, int]]:
    if "never" in chunk:
        raise ValueError
    return chunk.upper(), {"UP": 1}


@_table("chunk_processor_cases", ("doc_id", "masked", "failed_chunks", "fallback_chunks"), [(1, "FIRST LINE\nnever [PHONE]", 1, 1), (2, "A", 0, 0)])
def chunk_processor_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15, 2.16: a chunk processor of the caller's own, and the rules where it fails every time."""
    docs = spark.createDataFrame([(1, "first line\nnever 010-1234-5678"), (2, "a")], "doc_id int, text string")
    return processor.mask_with(docs, _shout, size=19).select("doc_id", "masked", "failed_chunks", "fallback_chunks")


@_table("model_answer_cases", ("value", "confirmed"), [("a", True), ("b", False), ("c", None), ("d", None)])
def model_answer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.16: a model's answers; a failure, and what is past the limit of calls, has none."""
    answers = {"a": "YES", "b": "Answer: no"}
    rows = spark.createDataFrame([("T", "a", 1), ("T", "b", 2), ("T", "c", 3), ("T", "d", 4)], "tag string, value string, rank int")
    return extensions.asked(rows, lambda tag, value: answers[value], most=3).select("value", "confirmed")


@_table("table_function_cases", ("doc_id", "tag", "value", "start_at"), [(1, "EMAIL", "a@b.kr", 4), (1, "PHONE", "010-1234-5678", 11)])
def table_function_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.16: the rules as a table function in SQL."""
    extensions.register(spark, "pii_hits")
    spark.createDataFrame([(1, "to: a@b.kr 010-1234-5678"), (2, None), (3, "none")], "doc_id int, text string").createOrReplaceTempView("table_function_texts")
    return spark.sql("SELECT doc_id, tag, value, start_at FROM table_function_texts, LATERAL pii_hits(text)")


@_table("out_of_fold_cases", ("fold", "trained", "held"), [(0, 3, 2), (1, 4, 1), (2, 3, 2)])
def out_of_fold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.16, E6: an evaluator that sees each fold once."""
    documents = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 2)], "doc_id int, fold int")
    count = lambda t, h: t.agg(F.count(F.lit(1)).alias("trained")).withColumn("k", F.lit(1)).join(h.agg(F.count(F.lit(1)).alias("held")).withColumn("k", F.lit(1)), "k").drop("k")
    return extensions.out_of_fold(documents, count, 3)


@_table("clipped_review_cases", ("target_id", "page_start", "page_end", "kind", "whole"), [("s1", 0, 2, "acknowledge", False), ("s2", 3, 3, "acknowledge", False), ("s2", 4, 5, "boundary", True)])
def clipped_review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing reviews clipped to the segments that they reach."""
    reviews = spark.createDataFrame([("d", "r1", "boundary", 0, 3, True), ("d", "r2", "boundary", 4, 5, False)], "doc_id string, review_id string, kind string, page_start int, page_end int, common_only boolean")
    found = spark.createDataFrame([("d", "s1", 0, 2), ("d", "s2", 3, 9)], "doc_id string, segment_id string, page_start int, page_end int")
    out = routing.clipped_reviews(reviews, found)
    return out.select("target_id", "page_start", "page_end", "kind", F.col("review_id").isin("r1", "r2").alias("whole"))


@_table("review_queue_cases", ("doc_id", "same"), [(1, True), (2, False), (3, False)])
def review_queue_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review queues that are equal place by place."""
    schema = "doc_id int, ordinal int, target string"
    left = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, "a")], schema)
    right = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a"), (3, 0, "a"), (3, 1, "c")], schema)
    return review.same_queue(left, right, ["target"])


@_table("review_target_cases", ("review_id", "page", "nth", "has_rects"), [("r1", 2, 1, True), ("r2", 2, 2, True), ("r3", 5, 1, False), ("r4", None, 1, False)])
def review_target_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the targets of reviews lie, and their number on the page."""
    box = [(0.0, 0.0, 1.0, 1.0)]
    reviews = spark.createDataFrame([(1, "r1", "occurrence", "o"), (1, "r2", "region", "g"), (1, "r3", "segment", "s"), (1, "r4", "region", "gone")], "doc_id int, review_id string, kind string, target string")
    occurrences = spark.createDataFrame([(1, "o", 2, box)], f"doc_id int, occurrence_id string, page int, rects {_RECTS}")
    known = spark.createDataFrame([(1, "g", 2, box)], f"doc_id int, region_id string, page int, rects {_RECTS}")
    segments = spark.createDataFrame([(1, "s", 5)], "doc_id int, segment_id string, page_start int")
    out = review.page_ordinals(review.target_rects(reviews, occurrences, known, segments), ["review_id"])
    return out.select("review_id", "page", F.col("nth").cast("long").alias("nth"), F.col("rects").isNotNull().alias("has_rects"))


@_table("accuracy_cases", ("fixed", "omissions", "body_recall", "automatic_rate", "false_rate"), [(2, 1, 0.5, 0.5, 0.5)])
def accuracy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed regions, body and negatives over all documents."""
    gold = spark.createDataFrame([("d", "1", True, True), ("d", "2", True, True), ("d", "3", True, False), ("d", "4", True, False), ("d", "5", False, False)], "doc_id string, id string, required boolean, fixed boolean")
    schema = f"doc_id string, id string, page_index int, category string, rects {_RECTS}"
    found = spark.createDataFrame([("d", "a", 0, "n", [(0.0, 0.0, 5.0, 5.0)], "mask"), ("d", "b", 0, "n", [(50.0, 0.0, 55.0, 5.0)], "mask")], schema + ", action string")
    matched = spark.createDataFrame([("d", "1", "a"), ("d", "3", "b")], "doc_id string, gold_id string, cand_id string")
    negatives = spark.createDataFrame([("d", "n1", 0, "n", [(4.0, 4.0, 9.0, 9.0)]), ("d", "n2", 0, "n", [(80.0, 4.0, 90.0, 9.0)])], schema)
    return evaluation.accuracy(gold, found, matched, negatives).select("fixed", "omissions", "body_recall", "automatic_rate", "false_rate")


# --- files ---------------------------------------------------------------------------------------------------------------------------

def _pdf(content: bytes, deflate: bool) -> bytes:
    body = zlib.compress(content) if deflate else content
    head = b"<< /Length %d%s >>" % (len(body), b" /Filter /FlateDecode" if deflate else b"")
    return b"%PDF-1.4\n1 0 obj\n" + head + b"\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


_SHOWS = b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(Wor) -20 (ld) -250 (again)] TJ ET"


@_table(
    "pdf_engine_cases",
    ("path", "text", "engine", "failures"),
    [("deflated", "Hello (you)\nWorld again", "plain", "strict:ValueError"), ("plain", "Hello (you)\nWorld again", "plain", "strict:ValueError"), ("no text", None, None, "strict:ValueError,plain:NoText,EXTRACTION_FAILED")],
)
def pdf_engine_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines in order; the first that reads a file wins, and failures are kept as codes."""

    def strict(content: bytes) -> str:
        raise ValueError

    files_ = spark.createDataFrame([("deflated", "x", _pdf(_SHOWS, True)), ("plain", "x", _pdf(_SHOWS, False)), ("no text", "x", _pdf(b"0 0 m", False))], "path string, sha256 string, content binary")
    out = files.with_engines(files_, {"strict": strict, "plain": archives.plain_pdf_text})
    return out.select("path", "text", "engine", F.array_join("failures", ",").alias("failures"))


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return out.getvalue()


@_table(
    "archive_cases",
    ("archive", "path", "length", "fault"),
    [("good", "good!/a.pdf", 3, None), ("good", "good!/d/b.PDF", 2, None), ("climbs", None, None, "ARCHIVE_MEMBER_UNSAFE"), ("bomb", None, None, "ARCHIVE_LIMIT_EXCEEDED"), ("broken", None, None, "ARCHIVE_INVALID")],
)
def archive_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives, and what forbids to open one."""
    rows = [("good", _zip({"a.pdf": b"one", "d/b.PDF": b"tw", "c.txt": b"x"})), ("climbs", _zip({"../a.pdf": b"x"})), ("bomb", _zip({"a.pdf": b"0" * 1_000_000})), ("broken", b"PK")]
    out = archives.members(spark.createDataFrame(rows, "path string, content binary"))
    return out.select("archive", "path", F.octet_length("content").alias("length"), "fault")
