"""Queries over literal pages and files: the geometry analysis end to end, its parts, page sources and sinks' plans.

Each query is written with its expected rows, which are its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as X
from ..operators import approval, candidates, evaluation, fold, layout, protocol, review, tables
from ..sources import files
from ..sources import pages as P
from ..streaming import batches
from . import manifest
from .cases import _RECTS, registry

QUERIES, SQL, _table = registry()
_RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
WORD_SCHEMA = f"doc_id string, page_index int, page_text string, page_height double, start int, end int, text string, rect {_RECT}"
_BOX = (0.0, 0.0, 1.0, 1.0)


def page_words(pages: list[tuple[str, int, list[tuple[float, float, str]]]], wide: float, high: float, height: float) -> list[tuple]:
    """Words of pages given as lines (y, x, text), letters ``wide`` and lines ``high``."""
    out = []
    for doc, index, lines in pages:
        text, own = "", []
        for y, x, line in lines:
            for word in line.split():
                text += " " if text else ""
                own.append((len(text), len(text) + len(word), word, (float(x), float(y), x + wide * len(word), y + high)))
                text += word
                x += wide * len(word) + 4
        out += [(doc, index, text, height, *w) for w in own]
    return out


# --- the analysis --------------------------------------------------------------------------------------------------------------------

GRID = [(20.0, y, 120.0, y + 0.5) for y in (5.0, 30.0, 60.0)] + [(x, 5.0, x + 0.5, 60.5) for x in (20.0, 62.0, 119.5)]
FILES = [
    ("a", 0, [(10, 0, "결재 과장 팀장"), (40, 28, "김철수"), (40, 66, "박영희"), (300, 0, "기관명 한빛진흥원 에서 알림"), (780, 300, "1")]),
    ("a", 1, [(300, 0, "본문 a.b@c.kr 끝"), (780, 300, "2")]),
    ("a", 2, [(10, 0, "수신 가나 귀중"), (760, 0, "시행 총무과-77"), (780, 300, "9")]),
    ("b", 0, [(300, 0, "그냥 글")]),
]


def _analysed(spark: SparkSession) -> manifest.Manifest:
    words = spark.createDataFrame(page_words(FILES, 6.0, 8.0, 800.0), WORD_SCHEMA)
    return manifest.analyse(words, spark.createDataFrame([("a", 0, g) for g in GRID], f"doc_id string, page_index int, rect {_RECT}"))


@_table("analysed_segment_cases", ("doc_id", "kind", "page_start", "page_end", "state"), [("a", "internal_review", 0, 1, "confirmed"), ("a", "official_dispatch", 2, 2, "confirmed"), ("b", "unknown", 0, 0, "review_required")])
def analysed_segment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in a batch of files."""
    return _analysed(spark).segments.select("doc_id", "kind", "page_start", "page_end", "state")


@_table(
    "analysed_occurrence_cases",
    ("page_index", "tag", "category", "action"),
    [(0, "APPROVAL_LINE", "approval_staff", "mask"), (0, "INSTITUTION_VALUE", "institution_value", "mask"), (1, "EMAIL", "email", "mask"), (2, "DOC_META", "dispatch_metadata", "mask")],
)
def analysed_occurrence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be masked in them; the second name stands below no role."""
    return _analysed(spark).occurrences.select("page_index", "tag", "category", "action")


@_table("analysed_coverage_cases", ("doc_id", "kind", "state"), [("a", "approval", "present"), ("a", "approval_staff", "present"), ("a", "header_meta", "absent"), ("a", "dispatch_metadata", "absent")])
def analysed_coverage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required regions are there."""
    return _analysed(spark).coverage


@_table(
    "page_candidate_cases",
    ("category", "value", "source", "action", "score"),
    [
        ("dispatch_metadata", "총무과-1234", "public_footer_dispatch_metadata", "mask", None),
        ("institution_address", "서울특별시 중구 목동 한빛로 7", "public_footer_institution_address", "review", 0.7),
        ("institution_address", "중구 목동 한빛로 7", "public_footer_institution_address", "review", 0.7),
        ("institution_value", "한빛 진흥원", "public_institution_label", "mask", 0.95),
        ("institution_value", "주식회사 푸른들", "public_institution_suffix", "review", 0.55),
        ("region_name", "경기도", "public_region_context", "review", 0.75),
        ("region_name", "수원시", "public_region_dictionary", "review", 0.5),
        ("email", "a.b@c.kr", "public_email_regex", "mask", None),
    ],
)
def page_candidate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every kind on a page."""
    lines = [(5, 0, "소재지 경기도 일원"), (20, 0, "기관명 : 한빛 진흥원"), (30, 0, "주식회사 푸른들 은 수원시 에서"), (40, 0, "a.b@c.kr 문의"), (90, 0, "시행 총무과-1234 (2024. 1. 2.)"), (95, 0, "우 04524 서울특별시 중구 목동 한빛로 7 전화 02-1")]
    words = spark.createDataFrame(page_words([("d", 0, lines)], 8.0, 4.0, 100.0), WORD_SCHEMA)
    return candidates.candidates(words).select("category", "value", "source", "action", "score")


@_table("page_keyword_cases", ("term", "start_at", "end_at"), [("도로공사", 3, 8), ("한빛도로", 0, 5), ("한빛도로", 9, 13)])
def page_keyword_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: terms that reach over words."""
    words = spark.createDataFrame(page_words([("d", 0, [(5, 0, "한빛 도로 공사"), (15, 0, "한빛도로 공사장")])], 8.0, 4.0, 100.0), WORD_SCHEMA)
    return candidates.keywords(words, ["한빛도로", "도로공사"]).select("term", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


_TABLE = [(0.0, y, 100.0, y + 0.5) for y in (0.0, 20.0, 40.0)] + [(x, 0.0, x + 0.5, 40.5) for x in (0.0, 50.0, 99.5)]


@_table("signer_cases", ("kind", "value", "in_box"), [("header_meta", "총무과-12", False), ("approval_staff", "김철수", True), ("approval_staff", "박영희", True)])
def signer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signers in an approval box, and a document number."""
    words = [("과장", (5.0, 5.0, 25.0, 12.0)), ("김철수", (5.0, 25.0, 30.0, 32.0)), ("팀장", (55.0, 5.0, 75.0, 12.0)), ("박영희", (55.0, 25.0, 80.0, 32.0)), ("시행:총무과-12", (200.0, 500.0, 270.0, 507.0)), ("검토결과", (5.0, 700.0, 30.0, 707.0))]
    w = spark.createDataFrame([("d", 0, t, b, 800.0) for t, b in words], f"doc_id string, page_index int, text string, rect {_RECT}, page_height double")
    return approval.approvals(w, spark.createDataFrame([("d", 0, b) for b in _TABLE], f"doc_id string, page_index int, rect {_RECT}")).select("kind", "value", "in_box")


@_table("table_cell_cases", ("cell", "x0", "y0", "x1", "y1"), [(0, 0.25, 0.25, 50.25, 20.25), (1, 50.25, 0.25, 99.75, 20.25), (2, 0.25, 20.25, 50.25, 40.25), (3, 50.25, 20.25, 99.75, 40.25)])
def table_cell_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a ruled table."""
    return tables.page_cells(spark.createDataFrame([("d", 0, b) for b in _TABLE], f"doc_id string, page_index int, rect {_RECT}")).select("cell", "rect.*")


@_table("merged_evidence_cases", ("id", "x0", "x1"), [(2, 0.0, 9.0), (3, 20.0, 25.0), (4, 20.0, 25.0)])
def merged_evidence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that overlaps, as one."""
    rows = [(1, 1, (0.0, 0.0, 5.0, 5.0), 3), (1, 2, (4.0, 4.0, 9.0, 9.0), 7), (1, 3, (20.0, 20.0, 25.0, 25.0), 1), (1, 4, (20.0, 20.0, 25.0, 25.0), 2)]
    merged = layout.merged_evidence(spark.createDataFrame(rows, f"page int, id int, rect {_RECT}, score int"), ["page"])
    return merged.select("id", "rect.x0", "rect.x1")


@_table("collinear_cases", ("axis", "start_at", "end_at", "n"), [(10.0, 0.0, 20.0, 2), (10.5, 30.0, 40.0, 1), (50.0, 0.0, 5.0, 1)])
def collinear_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on one axis that touch."""
    rows = spark.createDataFrame([(1, 10.0, 0.0, 11.0), (1, 11.0, 10.0, 20.0), (1, 10.5, 30.0, 40.0), (1, 50.0, 0.0, 5.0)], "page int, axis double, start double, end double")
    return layout.collinear(rows, ["page"], "axis", "start", "end").select("axis", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "n")


@_table("protected_cases", ("id",), [(1,)])
def protected_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks that cover some of a protected neighbour."""
    masks = spark.createDataFrame([(1, 0, (0.0, 0.0, 5.0, 5.0)), (2, 0, (10.0, 0.0, 15.0, 5.0)), (3, 1, (0.0, 0.0, 5.0, 5.0))], f"id int, page int, rect {_RECT}")
    return layout.protected(masks, spark.createDataFrame([(0, (4.0, 4.0, 10.0, 10.0))], f"page int, rect {_RECT}"), ["page"]).select("id")


# --- page sources ------------------------------------------------------------------------------------------------------------------------

@_table("ocr_word_cases", ("text", "x1", "fault"), [("a", 4.0, None), ("b", None, "OCR_GEOMETRY_INVALID"), ("c", None, "OCR_GEOMETRY_INVALID"), ("d", 1.0, "OCR_CONFIDENCE_INVALID")])
def ocr_word_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words from polygons; a malformed one keeps its fault."""
    rows = [(1, 0, "a", [[0.0, 1.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]], 0.9), (1, 0, "b", [[0.0, 1.0]], 0.9), (1, 0, "c", [[0.0, 1.0]] * 3 + [[float("nan"), 1.0]], 0.5), (1, 0, "d", [[0.0, 0.0], [1.0, 1.0]] * 2, float("inf"))]
    return P.ocr_words(spark.createDataFrame(rows, "doc_id int, page_index int, text string, polygon array<array<double>>, confidence double")).select("text", "rect.x1", "fault")


_PAGES = [(1, 0, "a b", "ocr"), (1, 1, "x", "ocr"), (1, 2, "t", "text"), (2, 0, "", "text")]
_PAGE_SCHEMA = "doc_id int, page_index int, text string, source string"


@_table("enriched_page_cases", ("doc_id", "page_index", "text", "evidence_status"), [(1, 0, "ab", "aligned"), (1, 1, "x", "gap"), (1, 2, "u", "aligned"), (2, 0, "", "missing")])
def enriched_page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, F-11: pages with an adapter's evidence."""
    evidence = spark.createDataFrame([(1, 0, "ab", ["ab"]), (1, 1, "y", ["y"]), (1, 2, "u", ["u"])], "doc_id int, page_index int, text string, words array<string>")
    return P.enriched(spark.createDataFrame(_PAGES, _PAGE_SCHEMA), evidence).select("doc_id", "page_index", "text", "evidence_status")


@_table("canonical_page_cases", ("doc_id", "page_index", "start_at", "end_at"), [(1, 0, 0, 3), (1, 1, 4, 5), (1, 2, 6, 7), (2, 0, 0, 0)])
def canonical_page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page lies in its document's text."""
    return P.canonical(spark.createDataFrame(_PAGES, _PAGE_SCHEMA))[1].select("doc_id", "page_index", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@_table("misaligned_page_cases", ("doc_id", "page_index"), [(1, 1)])
def misaligned_page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-11: pages whose words are not where their offsets say."""
    words = spark.createDataFrame([(1, 0, 0, "a", 0, 1), (1, 0, 1, "b", 2, 3), (1, 1, 0, "z", 0, 1)], "doc_id int, page_index int, word_index int, text string, start int, end int")
    return P.misaligned_pages(words, spark.createDataFrame(_PAGES, _PAGE_SCHEMA))


@_table("redaction_plan_cases", ("page", "tag", "label", "source"), [(1, "CARD", "[CARD]", "automatic"), (2, "MANUAL", "[MANUAL]", "manual")])
def redaction_plan_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be blacked out."""
    rows = [(1, "a", 0, [_BOX], "mask", "NAME"), (1, "b", 0, [_BOX], "review", "NAME"), (1, "c", 1, [_BOX, _BOX], "mask", "CARD")]
    found = spark.createDataFrame(rows, f"doc_id int, occurrence_id string, page int, rects {_RECTS}, action string, tag string")
    manual = spark.createDataFrame([(1, 2, [_BOX], "mask")], f"doc_id int, page int, rects {_RECTS}, action string")
    return P.redaction_plan(found, manual, spark.createDataFrame([(1, "a")], "doc_id int, occurrence_id string")).select("page", "tag", "label", "source")


# --- files ---------------------------------------------------------------------------------------------------------------------------------

_FILES = [("x/a.txt", "한글".encode("cp949")), ("x/b.md", "plain é".encode()), ("x/c.pdf", b"%PDF"), ("x/d.bin", b"\xff"), ("x/e.TXT", b"\xff\xff")]


def _file_rows(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_FILES, "path string, content binary")
    return rows.select("path", F.sha2("content", 256).alias("sha256"), files.kind(F.col("path")).alias("kind"), "content")


@_table(
    "text_file_cases",
    ("path", "text", "engine", "failures"),
    [("x/a.txt", "한글", "text:cp949", ""), ("x/b.md", "plain é", "text:utf-8", ""), ("x/c.pdf", None, None, "PDF_CONNECTOR_MISSING"), ("x/d.bin", None, None, "UNSUPPORTED_SUFFIX"), ("x/e.TXT", None, None, "ENCODING_UNSUPPORTED")],
)
def text_file_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as documents, by suffix and encoding."""
    return files.text_documents(_file_rows(spark)).select("path", "text", "engine", F.array_join("failures", ",").alias("failures"))


@_table("corpus_cases", ("name", "path", "n_files"), [("one", "x/c.pdf", 1), ("gone", None, 0), ("twice", "x/d.bin", 2)])
def corpus_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows and the files that have their content."""
    again = spark.createDataFrame([("x/f.bin", b"\xff")], "path string, content binary").select("path", F.sha2("content", 256).alias("sha256"))
    found = _file_rows(spark).select("path", "sha256").unionByName(again)
    named = spark.createDataFrame([("one", b"%PDF"), ("gone", b"?"), ("twice", b"\xff")], "name string, content binary").select("name", F.sha2("content", 256).alias("sha256"))
    return files.corpus(found, named).select("name", "path", "n_files")


@_table("unchanged_file_cases", ("path", "same"), [("a", True), ("b", False), ("c", False)])
def unchanged_file_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that still have the content they had."""
    schema = "path string, sha256 string"
    return files.unchanged(spark.createDataFrame([("a", "1"), ("b", "1")], schema), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], schema))


@_table("output_name_cases", ("path", "name"), [("x/y.z.pdf", "y.z_masked_1"), ("plain", "plain_masked_1")])
def output_name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of a result."""
    rows = spark.createDataFrame([("x/y.z.pdf",), ("plain",)], "path string")
    return rows.select("path", P.output_name(F.col("path"), "masked", "1").alias("name"))


# --- approval lines, on request -------------------------------------------------------------------------------------------------------------

SIGNED = [
    ("r34_label", "기안자 김철수", "김철수"), ("r34_not_a_name", "기안자 지침 안내", ""), ("r36_grade", "  행정 7급 홍길동  ", "홍길동"), ("r37_department", "급수운영팀 주무관 이한수", "이한수"),
    ("r38_combined", "급수관리팀장 이한수 연락처", "이한수"), ("r40_below", "과장\n김철수\n", "김철수"), ("r41_row", "주무관 박영희 / 과장 최민수", "박영희,최민수"), ("r42_brackets", "팀장(안승현)", "안승현"),
    ("r43_role_and_day", "공공주택과장 04/30 하대근", "하대근"), ("r44_day", "04/30 홍길동", "홍길동"), ("r35_not_a_person", "팀장 안전 점검", ""), ("r45_flow", "결재방식: 전결", "전결"), ("r46_flow_alone", "대결", "대결"),
]


@_table("approval_line_cases", ("case_id", "found", "shown"), [(c, f, True) for c, _, f in SIGNED])
def approval_line_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval lines, which only ``Options.approvals`` looks for; they are for review and stay visible."""
    rows = spark.createDataFrame([(c, t) for c, t, _ in SIGNED], "case_id string, text string").withColumn("given", F.col("text"))
    out = fold.mask(rows, fold.Options(approvals=True))
    names = F.transform(F.filter("hits", lambda h: h["tag"].isin("APPROVAL_LINE", "APPROVAL_FLOW")), lambda h: h["value"])
    return out.select("case_id", F.array_join(names, ",").alias("found"), ((F.col("masked") == F.col("given")) | F.col("case_id").startswith("r45") | F.col("case_id").startswith("r46")).alias("shown"))


# --- reviews, sessions, protocol --------------------------------------------------------------------------------------------------------------

def _masks(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    occ = spark.createDataFrame([(1, "a", 0, [_BOX], "mask", "r"), (1, "b", 2, [_BOX], "mask", "r"), (1, "c", 1, [_BOX], "review", "r")], f"doc_id int, occurrence_id string, page int, rects {_RECTS}, action string, source string")
    man = spark.createDataFrame([(1, None, 0, [_BOX], "mask", _BOX), (1, "b", 2, [_BOX], "restore", _BOX), (1, None, 5, [_BOX], "restore", _BOX)], f"doc_id int, occurrence_id string, page int, rects {_RECTS}, action string, rect {_RECT}")
    return occ, man


@_table("expected_mask_cases", ("doc_id", "expected", "applied", "complete"), [(1, 2, 2, True)])
def expected_mask_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks that a final document must have."""
    occ, man = _masks(spark)
    return review.expected_masks(occ, man, occ.filter("action = 'mask'")).select("doc_id", "expected", "applied", "complete")


@_table("first_mask_cases", ("doc_id", "page"), [(1, 0)])
def first_mask_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page to open first."""
    occ, man = _masks(spark)
    return review.first_mask(occ, man, occ)


@_table("restore_on_mask_cases", ("page",), [(2,)])
def restore_on_mask_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restores that lie on a confirmed mask."""
    occ, man = _masks(spark)
    return review.restores_on_masks(man, occ).select("page")


@_table("kept_exclusion_cases", ("page", "reasons", "effective"), [(0, "r,mask_overlaps_exclusion", False), (9, "", True)])
def kept_exclusion_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried exclusions beside newer masks."""
    rows = spark.createDataFrame([(1, 0, _BOX, ["r"]), (1, 9, _BOX, [])], f"doc_id int, page int, rect {_RECT}, reasons array<string>")
    return review.kept_exclusions(rows, _masks(spark)[1].select("doc_id", "page", "rect")).select("page", F.array_join("reasons", ",").alias("reasons"), "effective")


@_table("precondition_cases", ("doc_id", "ready"), [(1, True), (2, False), (3, False)])
def precondition_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold before a document is made final."""
    schema = "doc_id int, state string, revision int, expected_revision int, hash string, expected_hash string, blocking_item string"
    rows = [(1, "ready", 2, 2, "h", "h", "x"), (1, "ready", 2, 2, "h", "h", None), (2, "ready", 2, 3, "h", "h", None), (3, "ready", 2, 2, "h", "h", "y")]
    return review.precondition(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "x", "pending"), (3, "y", "resolved")], "doc_id int, target string, status string"))


@_table("session_cases", ("run_id", "seq", "state", "accepted", "reason"), [
    ("r", 1, "ready", True, ""), ("r", 2, "ready", True, ""), ("r", 3, "ready", False, "stale_revision"), ("r", 4, "ready", False, "stale_revision"), ("r", 5, "finalizing", True, ""),
    ("r", 6, "completed", True, ""), ("r", 7, "completed", False, "replayed"), ("s", 1, "new", False, "illegal_transition"),
])
def session_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15: revisions only rise by one, and a finished run is not run again."""
    rows = [("r", 1, "create", None), ("r", 2, "revise", 2), ("r", 3, "revise", 2), ("r", 4, "finalize", 1), ("r", 5, "finalize", 2), ("r", 6, "complete", None), ("r", 7, "create", None), ("s", 1, "finalize", None)]
    return batches.session_states(spark.createDataFrame(rows, "run_id string, seq long, event string, revision long")).select("run_id", "seq", "state", "accepted", "reason")


@_table("status_summary_cases", ("total", "pending", "done", "failed"), [(4, 1, 2, 1)])
def status_summary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a batch stands."""
    return batches.summary(spark.createDataFrame([("a", "done"), ("b", "done"), ("c", "failed"), ("d", "pending")], "path string, status string"))


@_table("pseudonym_cases", ("case_id", "distinct_names", "same_for_one_value", "own_name"), [("names", 20, True, False)])
def pseudonym_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10: pseudonyms of one run: one for each value, none for two, none its own."""
    given, names = policy.Pseudonyms(), [f"사람{i}" for i in range(20)]
    rows = [(n, given.of("NAME", n)) for n in names] + [(names[3], given.of("LEGAL_PARTY", names[3]))]
    df = spark.createDataFrame(rows, "value string, pseudonym string")
    per = df.groupBy("value").agg(F.count_distinct("pseudonym").alias("n"))
    return df.agg(F.count_distinct("pseudonym").alias("distinct_names"), F.bool_or(F.col("value") == F.col("pseudonym")).alias("own_name")).withColumn("k", F.lit(1)).join(
        per.agg((F.max("n") == 1).alias("same_for_one_value")).withColumn("k", F.lit(1)), "k"
    ).select(F.lit("names").alias("case_id"), "distinct_names", "same_for_one_value", "own_name")


@_table("lock_cases", ("case_id", "same"), [("rows in another order", True), ("other rows", False)])
def lock_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's lock does not depend on the order of its rows."""
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    other = spark.createDataFrame([(1, "a"), (2, "b"), (3, "d")], "k int, v string")
    locked = lambda df, name: protocol.lock(df, "k", "v").select(F.lit(name).alias("name"), "lock")
    both = locked(one, "one").unionByName(locked(one.orderBy(F.desc("k")), "rows in another order")).unionByName(locked(other, "other rows"))
    first = F.max(F.when(F.col("name") == "one", F.col("lock")))
    return both.withColumn("k", F.lit(1)).join(both.agg(first.alias("first")).withColumn("k", F.lit(1)), "k").filter("name <> 'one'").select(F.col("name").alias("case_id"), (F.col("lock") == F.col("first")).alias("same"))


@_table("fold_cases", ("fold", "n"), [(0, 20), (1, 20), (2, 20), (3, 20), (4, 20)])
def fold_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of equal size."""
    ids = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    return evaluation.folds(ids, "h").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@_table("folded_text_cases", ("case_id", "folded"), [(0, "abssk"), (1, "가나"), (2, None)])
def folded_text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms and case folding."""
    return spark.createDataFrame([(0, "ＡbßK"), (1, "가나"), (2, None)], "case_id int, t string").select("case_id", X.nfkc_fold(F.col("t")).alias("folded"))
