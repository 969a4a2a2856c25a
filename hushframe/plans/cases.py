"""Queries over literal rows: what the rules and small functions must give for Korean texts and single values.

The driver's tables hold no Korean, so the rules that need it are shown on fixed cases.  Each row is written with its expected
result; the query runs the engine on the inputs, the SQL is the table of expected results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import policy, validators
from ..operators import fold, routing, spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, bool | int):
        return str(value).lower()
    quoted = str(value).replace("'", "''")
    # line breaks are told apart from spaces in the SQL's text
    return "'" + quoted.replace("\n", "' || chr(10) || '") + "'"


def expected(columns: Sequence[str], rows: Sequence[tuple]) -> str:
    """SQL for literal rows."""
    values = ",\n  ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES\n  {values}\n) AS t({', '.join(columns)})"


def plain_types(query: Query) -> Query:
    """The query with whole numbers as int, as literals have them in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.select(*(F.col(c).cast("int").alias(c) if kind == "bigint" else F.col(c) for c, kind in out.dtypes))

    return wraps(query)(run)


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str, tuple[str, ...], list[tuple]], Callable[[Query], Query]]]:
    """Queries and SQL, both empty, and a decorator that adds a query to them with its expected rows."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def table(name: str, columns: tuple[str, ...], rows: list[tuple]) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            queries[name], sql[name] = plain_types(query), expected(columns, rows)
            return query

        return add

    return queries, sql, table


# --- the cascade: case, profile, text, masked text, hits (tag:value) ------------------------------------------------------

CASCADE = [
    ("r01_card", "mixed", "카드 1234 5678—9012.3456 끝", "카드 [CARD] 끝", "CARD:1234 5678—9012.3456"),
    ("r02_rrn", "mixed", "900101–1234567", "[RRN]", "RRN:900101–1234567"),
    ("r02_rrn_spaced", "mixed", "9 0 0 1 0 1 - 1 2 3 4 5 6 7", "[RRN]", "RRN:9 0 0 1 0 1 - 1 2 3 4 5 6 7"),
    ("r02_rrn_em_dash", "mixed", "900101—1234567", "[RRN]", "RRN:900101—1234567"),
    ("r02_rrn_dot", "mixed", "900101.1234567", "[RRN]", "RRN:900101.1234567"),
    ("r03_foreign", "mixed", "900101–5234567", "[FOREIGN_REG]", "FOREIGN_REG:900101–5234567"),
    ("r04_business", "mixed", "사업자 123-45-67890 확인", "사업자 [BUSINESS_REG_NO] 확인", "BUSINESS_REG_NO:123-45-67890"),
    ("r05_phone_list", "mixed", "연락처: 02-123-4567, 010-9876-5432 / 1577-1234 끝", "연락처: [PHONE][PHONE][PHONE] 끝", "PHONE:02-123-4567;PHONE:010-9876-5432;PHONE:1577-1234"),
    ("r05_phone_label", "mixed", "전화: 010 1234 5678", "전화: [PHONE]", "PHONE:010 1234 5678"),
    ("r06_mobile_dots", "mixed", "010.1234.5678", "[PHONE]", "PHONE:010.1234.5678"),
    ("r06_mobile_run", "mixed", "0101234 5678", "[PHONE]", "PHONE:0101234 5678"),
    ("r06_mobile_country", "mixed", "문의 +82 10 1234 5678", "문의 [PHONE]", "PHONE:+82 10 1234 5678"),
    ("r07_landline", "mixed", "(02)123-4567", "[PHONE]", "PHONE:(02)123-4567"),
    ("r07_landline_dashes", "mixed", "02-123-4567", "[PHONE]", "PHONE:02-123-4567"),
    ("r08_representative", "mixed", "대표 1588-0000", "대표 [PHONE]", "PHONE:1588-0000"),
    ("r09_passport", "mixed", "여권 M12345678 확인", "여권 [PASSPORT] 확인", "PASSPORT:M12345678"),
    ("r10_account", "mixed", "계좌번호: 110-234-567890", "계좌번호: [ACCOUNT]", "ACCOUNT:110-234-567890"),
    ("r11_email", "mixed", "메일 hong gil @ ex . or . kr", "메일 [EMAIL]", "EMAIL:hong gil @ ex . or . kr"),
    ("r12_name", "legal", "성명: 태영호", "성명: [NAME]", "NAME:태영호"),
    ("r12_name_shown", "mixed", "성명: 태영호", "성명: 태영호", "NAME:태영호"),
    ("r12_workflow_word", "mixed", "신청인 정보", "신청인 정보", ""),
    ("r13_postal", "legal", "우 04524", "우 [ADDRESS]", "ADDRESS:04524"),
    ("r14_labelled_postal", "legal", "우편번호: 04524", "우편번호: [ADDRESS]", "ADDRESS:04524"),
    ("r15_address_line", "legal", "주소: 역삼동 123-45", "주소: [ADDRESS]", "ADDRESS:역삼동 123-45"),
    ("r15_address_shown", "mixed", "주소: 서초동 1498-3", "주소: 서초동 1498-3", "ADDRESS:서초동 1498-3"),
    ("r15_not_address", "legal", "주소: 관리", "주소: 관리", ""),
    ("r16_place_of_business", "legal", "소재지: 반포동 20", "소재지: [ADDRESS]", "ADDRESS:반포동 20"),
    ("r17_national", "legal", "경기도 수원시 광교동 한빛로 7", "[ADDRESS]", "ADDRESS:경기도 수원시 광교동 한빛로 7"),
    ("r17_district", "legal", "해운대구 우동", "[ADDRESS]", "ADDRESS:해운대구 우동"),
    ("r18_seoul_district", "legal", "서울시 마포구 일대", "[PLACE] 일대", "PLACE:서울시 마포구"),
    ("r18_district_alone", "legal", "서초구 일대", "[PLACE] 일대", "PLACE:서초구"),
    ("r20_gate_closed", "legal", "한빛로 12", "한빛로 12", ""),
    ("r20_r21_gate_open", "legal", "주소지 확인 120-3번지", "주소지 확인 [LOT_NO]", "LOT_NO:120-3번지"),
    ("r21_gate_closed", "legal", "확인 120-3번지", "확인 120-3번지", ""),
    ("r22_party", "legal", "원고: 홍길동", "원고: [LEGAL_PARTY]", "LEGAL_PARTY:홍길동"),
    ("r23_party_inline", "legal", "피고 김 철 수", "피고 [LEGAL_PARTY]", "LEGAL_PARTY:김 철 수"),
    ("r24_representative", "legal", "원고 소송대리인 박영희", "원고 소송대리인 [LEGAL_PARTY]", "LEGAL_PARTY:박영희"),
    ("r26_spread_two_letters", "legal", "원고 이가 피고 김철수\n이가방을 들었다", "원고 [LEGAL_PARTY] 피고 [LEGAL_PARTY]\n이가방을 들었다", "LEGAL_PARTY:이가;LEGAL_PARTY:김철수"),
    ("r26_spread_particle", "legal", "원고 이가 피고 김철수\n이가는 출석했다\n이가 대표가 말했다", "원고 [LEGAL_PARTY] 피고 [LEGAL_PARTY]\n[LEGAL_PARTY]는 출석했다\n[LEGAL_PARTY] 대표가 말했다", "LEGAL_PARTY:이가;LEGAL_PARTY:김철수;LEGAL_PARTY:이가;LEGAL_PARTY:이가"),
    ("r26_spread_three_letters", "legal", "원고 홍길동 피고 김철수\n홍길동이 말했다", "원고 [LEGAL_PARTY] 피고 [LEGAL_PARTY]\n[LEGAL_PARTY]이 말했다", "LEGAL_PARTY:홍길동;LEGAL_PARTY:김철수;LEGAL_PARTY:홍길동"),
    ("r27_company_label", "mixed", "회사명: 가나 Tech", "회사명: [COMPANY]", "COMPANY:가나 Tech"),
    ("r28_company_prefix", "mixed", "주식회사 푸른들 귀중", "[COMPANY] 귀중", "COMPANY:주식회사 푸른들"),
    ("r29_court", "legal", "서울중앙지방법원", "[COURT]", "COURT:서울중앙지방법원"),
    ("r29_citation_stays", "legal", "대법원 2020. 1. 2. 선고 2019다12345 판결", "대법원 2020. 1. 2. 선고 2019다12345 판결", ""),
    ("r29_support_is_no_court", "legal", "자립지원 안내", "자립지원 안내", ""),
    ("r30_case_title", "legal", "사건명: 손해배상", "사건명: [CASE_TITLE]", "CASE_TITLE:손해배상"),
    ("r31_case_number", "legal", "사건번호: 2023가단12345", "사건번호: [CASE_NUMBER]", "CASE_NUMBER:2023가단12345"),
    ("r32_law_firm", "legal", "법무법인: 한빛", "법무법인: [LAW_FIRM]", "LAW_FIRM:한빛"),
    ("r33_attorney", "legal", "변호사: 오나래", "변호사: [ATTORNEY]", "ATTORNEY:오나래"),
    ("r34_approval_off", "legal", "기안자 김철수\n시행 건축과-1234", "기안자 김철수\n시행 건축과-1234", ""),
    ("r47_region", "mixed", "관할: 경기도 일원", "관할: [REGION]", "REGION:경기도 일원"),
    ("r48_dispatch", "mixed", "시행 건축과-1234", "시행 건축과-1234", "DOC_META:건축과-1234"),
    ("r49_labelled_meta", "mixed", "공개 여부: 비공개(6)", "공개 여부: 비공개(6)", "DOC_META:비공개(6)"),
    ("r51_inline_reference", "mixed", "급수과 제15호", "급수과 제15호", "DOC_META:급수과 제15호"),
    ("r53_disclosure", "mixed", "이 문서는 부분공개(5) 이다", "이 문서는 부분공개(5) 이다", "DOC_META:부분공개(5)"),
    ("golden_legal", "legal", "사건번호: 2023가단12345\n사건명: 손해배상\n원고: 홍길동\n피고: 김철수\n대법원 2020. 1. 2. 선고 2019다12345 판결\n서울중앙지방법원", "사건번호: [CASE_NUMBER]\n사건명: [CASE_TITLE]\n원고: [LEGAL_PARTY]\n피고: [LEGAL_PARTY]\n대법원 2020. 1. 2. 선고 2019다12345 판결\n[COURT]", "CASE_NUMBER:2023가단12345;CASE_TITLE:손해배상;LEGAL_PARTY:홍길동;LEGAL_PARTY:김철수;COURT:서울중앙지방법원"),
    ("clean_date", "mixed", "2023-12-25", "2023-12-25", ""),
    ("clean_amount", "mixed", "금액 1,234,567원", "금액 1,234,567원", ""),
    ("clean_case_year", "mixed", "사건 2023-1234", "사건 2023-1234", ""),
    ("clean_dotted_date", "mixed", "2024. 1. 2.", "2024. 1. 2.", ""),
    ("clean_budget", "mixed", "예산 12345678", "예산 12345678", ""),
    ("clean_road", "mixed", "도로 123-45", "도로 123-45", ""),
    ("clean_notice", "mixed", "제2023-45호", "제2023-45호", ""),
]
#: Cases with user terms: keywords and regions.
TERMS = [
    ("p12_longest_first", "alpha,alphabet", "", "alpha alphabet 010-1234-5678", "[KEYWORD] [KEYWORD] [PHONE]"),
    ("p12_token_protected", "PHONE,a b", "", "a  b 010-1234-5678 a b", "a  b [PHONE] [KEYWORD]"),
    ("r55_regions", "", "한빛골;푸른들", "한빛골 사람과 푸른들", "[REGION] 사람과 [REGION]"),
    ("p14_parsing", "ab; AB,c\n[no]", "", "ab AB c [no]", "[KEYWORD] AB c [no]"),
]


def _masked(spark: SparkSession, rows: list[tuple[str, str]], options: fold.Options) -> DataFrame:
    return fold.mask(spark.createDataFrame(rows, "case_id string, text string"), options)


def cascade_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked text and hits, in order of place, of one case for each rule."""
    parts = [_masked(spark, [(c, t) for c, p, t, *_ in CASCADE if p == profile], fold.Options(profile=profile)) for profile in ("mixed", "legal")]
    hits = F.array_join(F.transform("hits", lambda h: F.concat(h["tag"], F.lit(":"), h["value"])), ";")
    return parts[0].unionByName(parts[1]).select("case_id", "masked", hits.alias("found"))


def user_term_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User keywords and regions beside the tokens of the rules."""
    out = None
    for case, keywords, regions, given, _ in TERMS:
        one = _masked(spark, [(case, given)], fold.Options(keywords=keywords, regions=regions)).select("case_id", "masked")
        out = one if out is None else out.unionByName(one)
    return out


# --- validators: check, value, text around it (the value stands at its first place), verdict --------------------------------

CHECKED = [
    ("common_word", "관리", None, True), ("common_word", "홍길동", None, False),
    ("surname", "남궁민", None, True), ("surname", "뷁철수", None, False), ("surname", "김", None, False),
    ("name", "홍길동", None, True), ("name", "접수", None, False), ("name", "뷁철수", None, False), ("name", "홍 길동", None, True),
    ("labelled_name", "뷁철수", None, True), ("labelled_name", "접수", None, False), ("labelled_name", "홍길동아버지", None, False),
    ("approval_name", "김철수", None, True), ("approval_name", "검토결과", None, False), ("approval_name", "공사", None, False), ("approval_name", "김철수민", None, False), ("approval_name", "남궁민수", None, True),
    ("name_in_text", "뷁철수", "성명: 뷁철수 드림", True), ("name_in_text", "안전", "과장 안전 팀장", False), ("name_in_text", "뷁철수", "팀장 뷁철수 과장", True),
    ("name_in_text", "김철수", "오늘 김철수 왔다", True), ("name_in_text", "김안전", "김안전센터 방문", False),
    ("token", "[NAME] 외", None, True), ("token", "이름", None, False),
    ("address", "역삼동 123-45", None, True), ("address", "서초동 1498-3", None, True), ("address", "반포동 20", None, True), ("address", "품질관리팀 101호", None, False),
    ("address", "시스템 개선 요청", None, False), ("address", "추가 3건", None, False), ("address", "한빛로 12", None, True), ("address", "경기도 일원", None, True), ("address", "수원시 영통구", None, True),
    ("company", "주식회사 가나", None, True), ("company", "가나 Tech", None, True), ("company", "가나다", None, False), ("company", "정보", None, False),
    ("law_firm", "한빛", None, True), ("law_firm", "한 빛", None, False), ("law_firm", "검토결과", None, False), ("law_firm", "K&C", None, True), ("law_firm", "[LAW_FIRM]", None, False),
    ("meta", "건축과-1234", None, True), ("meta", "접수", None, False), ("meta", "가나다", None, False), ("meta", "a@b.kr", None, True), ("meta", "[DOC_META] 1", None, False),
    ("court", "서울중앙지방법원", "서울중앙지방법원", True), ("court", "자립지원", "자립지원 안내", False), ("court", "안양지원", "안양지원 앞", True), ("court", "하늘지원", "하늘지원 앞", False), ("court", "하늘지원", "가정법원 하늘지원 앞", True),
]


def validator_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every check, by its compiled expression."""
    rows = spark.createDataFrame([(i, c, v, t or v) for i, (c, v, t, _) in enumerate(CHECKED)], "case_id int, check_name string, value string, around string")
    start = F.instr("around", F.col("value")) - 1
    verdict: Column = F.lit(None).cast("boolean")
    for name in validators.CHECKS:
        verdict = F.when(F.col("check_name") == name, validators.column(name, F.col("value"), F.col("around"), start, start + F.length("value"))).otherwise(verdict)
    return rows.select("case_id", "check_name", "value", verdict.alias("verdict"))


# --- partial values and pseudonyms: tag, value, partial ---------------------------------------------------------------------

PARTIAL = [
    ("PHONE", "010-1234-5678", "010-****-5678"), ("PHONE", "1588-0000", "[PHONE]"), ("EMAIL", "ab@c.kr", "a***@c.kr"), ("EMAIL", "@c.kr", "[EMAIL]"),
    ("NAME", "홍 길동", "홍OO"), ("LEGAL_PARTY", "김철수", "김OO"), ("ATTORNEY", "오나래", "오OO"), ("APPROVAL_LINE", "박영희", "박OO"),
    ("ADDRESS", "서울 중구 어디 1", "서울 중구 [ADDRESS_DETAIL]"), ("ADDRESS", "어디", "[ADDRESS]"), ("REGION", "경기도 일원", "경기도 [REGION_DETAIL]"),
    ("BUSINESS_REG_NO", "123-45-67890", "***-**-67890"), ("CARD", "1234 5678 9012 3456", "****-****-****-3456"), ("COMPANY", "푸른 들", "푸**"), ("LAW_FIRM", "한빛", "한**"),
    ("COURT", "서울중앙지방법원", "서**"), ("RRN", "900101-1234567", "[RRN]"), ("PASSPORT", "M12345678", "[PASSPORT]"),
]


def partial_value_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partial form of a value of each tag."""
    rows = spark.createDataFrame([(t, v) for t, v, _ in PARTIAL], "tag string, value string")
    return rows.select("tag", "value", policy.partial(F.col("tag"), F.col("value")).alias("partial"))


# --- identity ------------------------------------------------------------------------------------------------------------------

_BOX = (10.0, 20.0, 30.0, 40.0)
IDENTITY = [
    ("vector", "a" * 64, 1, 0, [_BOX], "profile_value", "approval_staff", "b" * 64, "profile_layout", "masking-policy-v1", "mask", "occ_92eb1115c8edaed5d78e8c0d"),
    ("upper_case_hash", "A" * 64, 1, 0, [_BOX], "profile_value", "approval_staff", "B" * 64, "profile_layout", "masking-policy-v1", "mask", "occ_92eb1115c8edaed5d78e8c0d"),
    ("no_rect", "a" * 64, 1, 0, [], "profile_value", "approval_staff", "b" * 64, "profile_layout", "masking-policy-v1", "mask", None),
    ("empty_rect", "a" * 64, 1, 0, [(10.0, 20.0, 10.0, 40.0)], "profile_value", "approval_staff", "b" * 64, "profile_layout", "masking-policy-v1", "mask", None),
    ("revision_zero", "a" * 64, 0, 0, [_BOX], "profile_value", "approval_staff", "b" * 64, "profile_layout", "masking-policy-v1", "mask", None),
    ("unknown_action", "a" * 64, 1, 0, [_BOX], "profile_value", "approval_staff", "b" * 64, "profile_layout", "masking-policy-v1", "hide", None),
    ("short_hash", "a" * 63, 1, 0, [_BOX], "profile_value", "approval_staff", "b" * 64, "profile_layout", "masking-policy-v1", "mask", None),
]
_RECTS = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def identity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published identity of an occurrence, and parts that have none."""
    names = ("document_hash", "revision", "page", "rects", "tag", "category", "value_hash", "source", "policy", "action")
    schema = f"case_id string, document_hash string, revision int, page int, rects {_RECTS}, tag string, category string, value_hash string, source string, policy string, action string"
    rows = spark.createDataFrame([r[:-1] for r in IDENTITY], schema)
    return rows.select("case_id", spans.occurrence_id(*map(F.col, names)).alias("identity"))


# --- geometry: a rect, what lies on it, the share that is covered ---------------------------------------------------------------

COVERED = [
    ("none", [], 0.0),
    ("all", [(0.0, 0.0, 10.0, 10.0)], 1.0),
    ("two_halves", [(0.0, 0.0, 5.0, 10.0), (5.0, 0.0, 10.0, 10.0)], 1.0),
    ("overlapping", [(0.0, 0.0, 6.0, 10.0), (4.0, 0.0, 8.0, 10.0)], 0.8),
    ("corners", [(0.0, 0.0, 5.0, 5.0), (5.0, 5.0, 10.0, 10.0)], 0.5),
    ("ring", [(0.0, 0.0, 10.0, 2.0), (0.0, 8.0, 10.0, 10.0), (0.0, 0.0, 2.0, 10.0), (8.0, 0.0, 10.0, 10.0)], 0.64),
    ("beyond", [(-5.0, -5.0, 5.0, 20.0), (20.0, 0.0, 30.0, 10.0)], 0.5),
]


def union_coverage_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a rect the union of several covers."""
    rows = spark.createDataFrame([(c, r) for c, r, _ in COVERED], f"case_id string, rects {_RECTS}")
    whole = G.rect(*(F.lit(x) for x in (0.0, 0.0, 10.0, 10.0)))
    return rows.select("case_id", F.round(G.coverage(whole, F.col("rects"), 0.0), 9).alias("covered"))


# --- running titles: titles of two pages, whether they are the same --------------------------------------------------------------

TITLES = [
    ("equal", ["도로 점용 허가"], ["도로 점용 허가"], True),
    ("spacing", ["도로점용 허가"], ["도로 점용-허가"], True),
    ("nearly", ["도로 점용 허가 계획"], ["도로 점용 허가 계획안"], True),
    ("too_short_a_part", ["도로 점용"], ["도로 점용 허가 변경 계획 보고"], False),
    ("generic", ["검토보고서"], ["검토보고서"], False),
    ("few_letters", ["허가"], ["허가"], False),
    ("second_title", ["다른 제목입니다", "도로 점용 허가"], ["도로 점용 허가"], True),
    ("none", [], ["도로 점용 허가"], False),
]


def running_title_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two pages have the same running title."""
    rows = spark.createDataFrame([(c, a, b) for c, a, b, _ in TITLES], "case_id string, a array<string>, b array<string>")
    return rows.select("case_id", routing.same_title_column(F.col("a"), F.col("b")).alias("same"))


# --- routing: pages (start signals, continuity, titles) of a file, segments kind:state:first-last ----------------------------------

_SEQ, _FRAME = ["no_start_signal", "page_number_sequence"], ["no_start_signal", "repeated_header_footer"]
ROUTED = [
    ("one_kind", [(["approval"], [], []), ([], _SEQ, []), ([], _SEQ, [])], "internal_review:confirmed:0-2"),
    ("two_kinds", [(["approval"], [], []), ([], _SEQ, []), (["recipient"], [], [])], "internal_review:confirmed:0-1;official_dispatch:confirmed:2-2"),
    ("frame_goes_on", [(["recipient"], [], []), ([], _FRAME, [])], "official_dispatch:confirmed:0-1"),
    ("gap_is_bridged", [(["approval"], [], []), ([], [], []), ([], _SEQ, [])], "internal_review:confirmed:0-2"),
    ("gap_is_not_bridged", [(["approval"], [], []), ([], [], []), (["recipient"], [], [])], "internal_review:confirmed:0-0;unknown:review_required:1-1;official_dispatch:confirmed:2-2"),
    ("no_signal", [([], [], []), ([], _SEQ, [])], "unknown:review_required:0-1"),
    ("conflict", [(["approval", "recipient"], [], [])], "unknown:review_required:0-0"),
    ("same_title", [(["approval"], [], ["도로 점용 허가"]), ([], [], ["도로 점용 허가"])], "internal_review:confirmed:0-1"),
]


def routing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of small files."""
    pages = [(c, i, s, k, t, None, 0.9, 0.9) for c, file, _ in ROUTED for i, (s, k, t) in enumerate(file)]
    schema = "doc_id string, page_index int, start_signals array<string>, continuity_signals array<string>, routing_titles array<string>, routing_title_kind string, ocr_confidence double, boundary_confidence double"
    found = routing.route(spark.createDataFrame(pages, schema))
    one = F.concat_ws(":", "kind", "state", F.concat_ws("-", "page_start", "page_end"))
    rows = found.groupBy(F.col("doc_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("page_start", one.alias("s")))).alias("s"))
    return rows.select("case_id", F.array_join(F.col("s.s"), ";").alias("segments"))


def _add(query: Query, columns: Sequence[str], rows: Sequence[tuple]) -> None:
    QUERIES[query.__name__] = plain_types(query)
    SQL[query.__name__] = expected(columns, rows)


_add(cascade_cases, ("case_id", "masked", "found"), [(c, m, f) for c, _, _, m, f in CASCADE])
_add(user_term_cases, ("case_id", "masked"), [(c, m) for c, *_, m in TERMS])
_add(validator_cases, ("case_id", "check_name", "value", "verdict"), [(i, c, v, says) for i, (c, v, _, says) in enumerate(CHECKED)])
_add(partial_value_cases, ("tag", "value", "partial"), PARTIAL)
_add(identity_cases, ("case_id", "identity"), [(r[0], r[-1]) for r in IDENTITY])
_add(union_coverage_cases, ("case_id", "covered"), [(c, x) for c, _, x in COVERED])
_add(running_title_cases, ("case_id", "same"), [(c, x) for c, _, _, x in TITLES])
_add(routing_cases, ("case_id", "segments"), [(c, x) for c, _, x in ROUTED])
