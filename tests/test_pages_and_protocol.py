"""Candidates on pages, residual search, protocol checks and text functions."""

import pytest
from pyspark.sql import functions as F

from hushframe.functions import text as X
from hushframe.operators import candidates, protocol, residual

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def page(rows, height=100.0):
    """Words of lines ((y, text), ...) with offsets into the joined text."""
    out, text = [], ""
    for y, line in rows:
        x = 0.0
        for word in line.split():
            text += " " if text else ""
            out.append((len(text), len(text) + len(word), word, (x, float(y), x + 8.0 * len(word), y + 4.0)))
            text += word
            x += 8.0 * len(word) + 4
    return [("d", 0, text, height, *w) for w in out]


def found(spark, rows):
    schema = f"doc_id string, page_index int, page_text string, page_height double, start int, end int, text string, rect {RECT}"
    return {(r.category, r.value): r for r in candidates.candidates(spark.createDataFrame(page(rows), schema)).collect()}


def test_candidates(spark):
    got = found(spark, [(5, "소재지 경기도 일원"), (20, "기관명 : 한빛 진흥원"), (30, "주식회사 푸른들 은 수원시 에서"), (40, "a.b@c.kr 문의"), (90, "시행 총무과-1234 (2024. 1. 2.)"), (95, "우 04524 서울특별시 중구 목동 한빛로 7 전화 02-1")])
    assert got["dispatch_metadata", "총무과-1234"].action == "mask"
    address = got["institution_address", "서울특별시 중구 목동 한빛로 7"]
    assert address.action == "review" and address.score == 0.7
    labelled = got["institution_value", "한빛 진흥원"]
    assert (labelled.score, labelled.action, labelled.source) == (0.95, "mask", "public_institution_label")
    assert got["institution_value", "주식회사 푸른들"].score == 0.55
    assert got["region_name", "경기도"].source == "public_region_context" and got["region_name", "경기도"].score == 0.75
    assert got["region_name", "수원시"].score == 0.5 and got["email", "a.b@c.kr"].action == "mask"
    assert ("region_name", "중구") not in got


def test_candidates_in_quotes_and_profile_rows(spark):
    got = found(spark, [(5, "그는 “ 한빛진흥원 ” 이라 했다"), (20, "수신 수원시 귀중")])
    assert [(k, r.action, "quoted_context" in r.reasons) for k, r in got.items()] == [(("institution_value", "한빛진흥원"), "review", True)]


def test_keywords_across_words(spark):
    schema = f"doc_id string, page_index int, page_text string, page_height double, start int, end int, text string, rect {RECT}"
    words = spark.createDataFrame(page([(5, "한빛 도로 공사"), (15, "한빛도로 공사장")]), schema)
    got = candidates.keywords(words, ["한빛도로", "도로공사"]).collect()
    assert sorted((r.term, r.start, r.end) for r in got) == [("도로공사", 3, 8), ("한빛도로", 0, 5), ("한빛도로", 9, 13)]


def test_residuals(spark):
    hits = spark.createDataFrame([(1, "NAME", "홍 길동"), (1, "PHONE", "010-1234-5678"), (1, "RRN", "900101"), (2, "NAME", "a.b(c")], "doc_id int, tag string, value string")
    texts = spark.createDataFrame([(1, "홍길동 왔다 010 – 1234 – 5678 x900101 9001012"), (2, "see a.b(c here and xa.b(c"), (3, "")], "doc_id int, text string")
    got = residual.residuals(residual.search_terms(hits), texts)
    assert {(r.doc_id, r.value): (r.exact, r.fuzzy) for r in got.collect()} == {(1, "홍 길동"): (1, 0), (1, "010-1234-5678"): (0, 1), (1, "900101"): (0, 2), (2, "a.b(c"): (1, 1)}
    state = residual.verified(texts, got)
    assert {r.doc_id: r.verified for r in state.collect()} == {1: False, 2: False, 3: True}
    gate = residual.quality_gate(state, spark.createDataFrame([(3, "X", 2, 1), (1, "X", 1, 1)], "doc_id int, tag string, found int, masked int"))
    assert {r.doc_id: r.reason for r in gate.collect()} == {1: "residual_found", 2: "residual_found", 3: "targets_missed"}


def test_gold_violations(spark):
    pages = spark.createDataFrame([("d", 0, 100.0, 100.0)], "doc_id string, page_index int, width double, height double")
    segments = spark.createDataFrame([("d", "s1", 0, "body", 0, 10), ("d", "s2", 0, "table", 12, 20)], "doc_id string, id string, page_index int, type string, start int, end int")
    regions = spark.createDataFrame([("d", "r1")], "doc_id string, id string")
    schema = f"doc_id string, id string, page_index int, segment_id string, region_id string, rects array<{RECT}>, start int, end int"
    ok = [(0.0, 0.0, 5.0, 5.0)]
    rows = [("d", "a", 0, "s1", None, ok, 0, 3), ("d", "b", 0, "s2", None, ok, 12, 25), ("d", "c", 1, "s9", "r1", [(0.0, 0.0, 500.0, 5.0)], 0, 1), ("d", "c", 0, "s2", "r1", ok, 13, 14)]
    negatives = spark.createDataFrame([("d", "n", "name", "place")], "doc_id string, id string, kind string, category string")
    got = protocol.gold_violations(pages, segments, regions, spark.createDataFrame(rows, schema), negatives)
    assert {(r.id, r.violation) for r in got.collect()} == {
        ("b", "unknown_region"),
        ("b", "offsets_outside_segment"),
        ("c", "unknown_segment"),
        ("c", "rect_outside_page"),
        ("c", "repeated_occurrence_id"),
        ("n", "name_negative_category"),
        ("s2", "segments_not_contiguous"),
    }


def test_out_of_fold(spark):
    schema = "doc_id string, status string, " + ", ".join(f"{c} int" for c in protocol.COUNTERS)
    good = [("a", "ok", 10, 9, 5, 4, 1, 0, 0), ("b", "ok", 10, 10, 10, 0, 0, 0, 0)]
    bad = [("c", "failed_closed", 1, 0, 0, 0, 0, 0, 0), ("d", "ok", 1, 2, 3, 0, 1, 2, 0)]
    rows = spark.createDataFrame(good + bad, schema)
    assert {r.doc_id: r.n for r in protocol.prediction_violations(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {"c": 1, "d": 4}
    total = protocol.roll_up(rows.filter("doc_id < 'c'")).first()
    assert (total.recall, total.automatic_rate, total.false_rate, total.documents) == (0.95, 0.75, 0.25, 2)
    documents = spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string")
    assert {r.doc_id: r.n for r in protocol.coverage_violations(rows, documents).collect()} == {"c": None, "d": None, "z": 0}
    trial = "auto double, review double, hits int, gold int, false int, negatives int"
    one = spark.createDataFrame([(0.8, 0.5, 99, 100, 1, 50), (0.9, 0.5, 100, 100, 9, 50), (0.7, 0.5, 1, 1, 0, 1)], trial)
    two = spark.createDataFrame([(0.8, 0.5, 100, 100, 1, 50), (0.9, 0.5, 100, 100, 9, 50)], trial)
    evidence = protocol.threshold_evidence(one, two)
    assert evidence.filter("NOT complete").count() == 1
    best = protocol.choose(evidence).first()
    assert (best.auto, best.passed, best.shortfall) == (0.8, True, 0.0)
    assert protocol.lock(one, "auto", "hits") .first().lock == protocol.lock(one.repartition(3), "auto", "hits").first().lock != protocol.lock(two, "auto", "hits").first().lock
    assert protocol.disjoint(one, two, "auto").first().disjoint is False


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(X.clean(F.lit("  a   b ;:"))) == "a b"
    assert one(X.plain_dashes(F.lit("1–2 － 3​4"))) == "1-2-34"
    assert one(X.nfkc_fold(F.lit("ＡbßK"))) == "abssk"
    for key in (b"k", b"x" * 100):
        assert one(X.hmac_sha256(F.lit("값"), key)) == X.hmac_reference("값", key)
    assert [one(X.page_number(F.lit(t))) for t in ("- 3 -", "12", "3/10", "4쪽", "page 3", "")] == [3, 12, 3, 4, None, None]
    assert [one(X.yes_or_no(F.lit(t))) for t in ("Yes.", "no", "I think\\nAnswer: no, not yes", "well yes, no", "maybe", None)] == [True, False, False, True, None, None]
    assert one(X.inside_token(F.lit("ab12"), F.lit(1), F.lit(3))) and not one(X.inside_token(F.lit("a b c"), F.lit(2), F.lit(3)))
    assert one(X.without_values(F.lit("x value: secret 1"))) == "x value: [REDACTED]"
    assert one(X.safe_codes(F.array(*(F.lit(c) for c in "abca")), ["c", "a"])) == ["a", "c"]
    assert one(X.evidence(F.lit("regex_x"), {"regex": "pattern", "re": "other"})) == "pattern"


@pytest.mark.parametrize(("text", "start", "end", "expected"), [("“abc”", 1, 4, True), ("“x” abc", 4, 7, False), ('say "abc" now', 5, 8, True), ("plain abc", 6, 9, False)])
def test_quoted(spark, text, start, end, expected):
    got = spark.range(1).select(X.quoted(F.lit(text), F.lit(start), F.lit(end)).alias("v")).first().v
    assert got is expected
