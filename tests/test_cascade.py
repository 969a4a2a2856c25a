"""The recogniser cascade on literal texts: every rule group, order, offsets, profiles, options."""

import re
import time

import pytest

from hushframe.functions import policy
from hushframe.functions import validators as ok
from hushframe.operators import chunks, processor, rules
from hushframe.operators.fold import OPTION_NAMES, Hit, Options, Tape, _restore, cascade, counts_by_tag, mask, mask_text, matches, parse_terms
from hushframe.sources import files

HEADER = "사건번호: 2021가합54321\n사건명: 대여금\n원고: 박영희\n피고: 최민수\n대법원 2019. 3. 4. 선고 2018다777 판결\n부산지방법원"


def test_legal_text():
    tape = mask_text(HEADER, Options(profile="legal"))
    assert tape.text == "사건번호: [CASE_NUMBER]\n사건명: [CASE_TITLE]\n원고: [LEGAL_PARTY]\n피고: [LEGAL_PARTY]\n대법원 2019. 3. 4. 선고 2018다777 판결\n[COURT]"
    assert tape.counts == {"LEGAL_PARTY": 2, "COURT": 1, "CASE_TITLE": 1, "CASE_NUMBER": 1}
    assert [(h.tag, HEADER[h.start : h.end]) for h in tape.hits] == [
        ("LEGAL_PARTY", "박영희"),
        ("LEGAL_PARTY", "최민수"),
        ("COURT", "부산지방법원"),
        ("CASE_TITLE", "대여금"),
        ("CASE_NUMBER", "2021가합54321"),
    ]


@pytest.mark.parametrize("profile", ["internal_review", "official_dispatch", "mixed"])
def test_public_profiles_leave_legal_rules_off(profile):
    text = HEADER + "\n시행 총무과-4321"
    tape = cascade(text, Options(profile=profile))
    assert tape.counts == {"DOC_META": 1} and tape.text == HEADER + "\n시행 [DOC_META]"
    assert mask_text(text, Options(profile=profile)).text == text  # a review hit is shown, and still counted
    assert cascade("시행 총무과-4321", Options(profile="legal")).counts == {}


@pytest.mark.parametrize(
    ("text", "tag", "value"),
    [
        ("번호 900101-1234567 끝", "RRN", "900101-1234567"),
        ("번호 9 0 0 1 0 1－1 2 3 4 5 6 7 끝", "RRN", "9 0 0 1 0 1－1 2 3 4 5 6 7"),
        ("등록 900101.6234567", "FOREIGN_REG", "900101.6234567"),
        ("사업자 123-45-67890", "BUSINESS_REG_NO", "123-45-67890"),
        ("카드 1234 5678—9012.3456", "CARD", "1234 5678—9012.3456"),
        ("문의 010‑1234‑5678", "PHONE", "010‑1234‑5678"),
        ("문의 +82 10 1234 5678", "PHONE", "+82 10 1234 5678"),
        ("대표 1588-0000", "PHONE", "1588-0000"),
        ("사무실 (02) 123-4567", "PHONE", "(02) 123-4567"),
        ("여권 M12345678", "PASSPORT", "M12345678"),
        ("계좌번호: 110-234-567890", "ACCOUNT", "110-234-567890"),
        ("메일 hong gil @ ex . or . kr", "EMAIL", "hong gil @ ex . or . kr"),
        ("성명: 태영호", "NAME", "태영호"),
        ("주소: 어딘가 한길로 12", "ADDRESS", "어딘가 한길로 12"),
        ("경기도 수원시 광교동 한빛로 7", "ADDRESS", "경기도 수원시 광교동 한빛로 7"),
        ("우 04524", "ADDRESS", "04524"),
        ("서울시 마포구 일대", "PLACE", "서울시 마포구"),
        ("주소지 확인 120-3번지", "LOT_NO", "120-3번지"),
        ("주식회사 푸른들 귀중", "COMPANY", "주식회사 푸른들"),
        ("회사명: 가나 Tech", "COMPANY", "가나 Tech"),
        ("공개 여부: 비공개(6)", "DOC_META", "비공개(6)"),
        ("급수과 제15호", "DOC_META", "급수과 제15호"),
        ("관할: 경기도 일원", "REGION", "경기도 일원"),
    ],
)
def test_rules(text, tag, value):
    hits = cascade(text).hits
    assert (tag, value) in [(h.tag, h.value) for h in hits]
    assert all(ok.clean(text[h.start : h.end]) == h.value for h in hits)


@pytest.mark.parametrize("text", ["2024년 계획 12345", "담당자 접수 안내", "주소: 관리", "합계 1234567890123456789", "신청인 정보", "예산 900101-9234567", "사무소지원 안내"])
def test_clean_texts(text):
    assert cascade(text).hits == [] or all(h.tag == "BUSINESS_REG_NO" for h in cascade(text).hits)


def test_labelled_phone_lists():
    text = "연락처: 02-123-4567, 010-9876-5432 / 1577-1234 끝"
    tape = cascade(text)
    assert tape.text == "연락처: [PHONE][PHONE][PHONE] 끝" and tape.counts["PHONE"] == 3
    assert [text[h.start : h.end] for h in tape.hits] == ["02-123-4567", "010-9876-5432", "1577-1234"]


def test_party_names_spread():
    text = "원고: 이가\n이가는 이가방을 샀고 이가 대표가 왔다. 피고 김하늘바다\n원고 정은지\n정은지의"
    tape = cascade(text, Options(profile="legal"))
    assert "[LEGAL_PARTY]는 이가방을 샀고 [LEGAL_PARTY] 대표가" in tape.text and tape.text.endswith("[LEGAL_PARTY]의")


def test_order_and_offsets_through_tokens():
    text = "담당 1234-5678-9012-3456 성명: 오나래 a@b.kr 카드 1111222233334444"
    tape = cascade(text)
    assert [(h.tag, text[h.start : h.end]) for h in sorted(tape.hits, key=lambda h: h.start)] == [("CARD", "1234-5678-9012-3456"), ("NAME", "오나래"), ("EMAIL", "a@b.kr"), ("CARD", "1111222233334444")]
    assert len(tape.at) == len(tape.text) + 1


def test_keywords_and_tokens():
    tape = mask_text("alpha beta alphabet 010-1234-5678", Options(keywords="alpha, alphabet;x\n[no]", regions=("beta",)))
    assert tape.text == "[KEYWORD] [REGION] [KEYWORD] [PHONE]" and tape.counts["KEYWORD"] == 2
    assert mask_text("a@b.kr", Options(korean_tokens=True)).text == "[이메일]"
    assert parse_terms("ab; AB, abc\n a  b ,c,[ab]") == ["abc", "a b", "ab"]
    with pytest.raises(ValueError):
        Options(profile="other")
    with pytest.raises(ValueError):
        Options(off=frozenset({"unknown"}))
    assert cascade("a@b.kr", Options(off=frozenset({"email"}))).hits == []


def test_spark_mask_equals_python(spark):
    texts = [HEADER, None, "", "성명: 오나래 010-1234-5678", "x" * 50_000 + " 1234-5678-9012-3456"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, masked string")
    out = mask(docs)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        tape = mask_text(t) if t else Tape("")
        assert got[i].masked == tape.text and dict(got[i].counts) == tape.counts and len(got[i].hits) == len(tape.hits)
    assert matches(out, "doc_id").count() == sum(len(r.hits) for r in got.values())
    assert {(r.tag, r.n) for r in counts_by_tag(out).collect()} == {("NAME", 1), ("PHONE", 1), ("CARD", 1)}


def test_chunks_cover_the_text():
    text = "".join(f"line {i} " + "y" * (i % 70) + "\n" for i in range(200)) + "z" * 500
    for size in (10_000, 128, 32):
        cut = chunks.by_lines(text, size)
        assert "".join(t for t, _ in cut) == text and all(text[s : s + len(t)] == t for t, s in cut)
        assert all(len(t) <= max(size, 0) or size <= 0 for t, _ in cut) or size == 10_000
    assert chunks.by_lines("abc", 0) == [("abc", 0)]
    back = chunks.by_lines(text, 128, 16)
    assert all(text[s : s + len(t)] == t for t, s in back) and back[1][1] == len(chunks.by_lines(text, 128)[0][0]) - 16


def test_context_chunks():
    text = "=== PAGE 1 ===\nFirst one. " + "Second sentence here. " * 20 + "\n=== PAGE 2 ===\nLast words."
    got = chunks.context(text, size=100, overlap=20)
    assert all(text[c["start"] : c["end"]].endswith(c["text"][-5:]) and len(c["text"]) <= 140 for c in got)
    assert got[0]["page"] == 1 and got[-1]["page"] == 2 and [c["chunk_index"] for c in got] == list(range(len(got)))
    assert chunks.search_score("Last words", got[-1]["text"]) == (100, "exact") and chunks.search_score("LAST  WORDS", got[-1]["text"]) == (90, "normalized")
    assert chunks.search_score("zz", "abc") is None


@pytest.mark.parametrize(
    ("tag", "value", "shown"),
    [
        ("PHONE", "010-1234-5678", "010-****-5678"),
        ("PHONE", "1588-0000", "[PHONE]"),
        ("EMAIL", "ab@c.kr", "a***@c.kr"),
        ("EMAIL", "@c.kr", "[EMAIL]"),
        ("NAME", "홍 길동", "홍OO"),
        ("ADDRESS", "서울 중구 어디 1", "서울 중구 [ADDRESS_DETAIL]"),
        ("ADDRESS", "어디", "[ADDRESS]"),
        ("BUSINESS_REG_NO", "123-45-67890", "***-**-67890"),
        ("CARD", "1234 5678 9012 3456", "****-****-****-3456"),
        ("COMPANY", "푸른 들", "푸**"),
        ("RRN", "900101-1234567", "[RRN]"),
    ],
)
def test_partial_values(spark, tag, value, shown):
    from pyspark.sql import functions as F

    assert policy.partial_value(tag, value) == shown
    assert spark.range(1).select(policy.partial(F.lit(tag), F.lit(value)).alias("p")).first().p == shown


def test_pseudonyms(spark):
    from pyspark.sql import functions as F

    names = policy.Pseudonyms()
    given = [names.of("NAME", f"사람{i}") for i in range(20)]
    assert len(set(given)) == 20 and names.of("NAME", "사람3") == given[3] and names.of("LEGAL_PARTY", "사람3") == given[3]
    for tag, value in (("PHONE", "010"), ("EMAIL", "a@b"), ("ADDRESS", "x"), ("COMPANY", "c"), ("CARD", "1")):
        first = policy.Pseudonyms().of(tag, value)
        assert spark.range(1).select(policy.stateless_pseudonym(F.lit(tag), F.lit(value)).alias("p")).first().p == first
    assert policy.apply_policy("[NAME] [PHONE] [NAME] [X]", [("NAME", "가나"), ("NAME", "다라"), ("PHONE", "010-1234-5678")], "partial") == "가OO 010-****-5678 다OO [X]"
    assert policy.apply_policy("[NAME]", [("NAME", "가나")], "unknown") == "[NAME]"


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("기안자 김철수", ["김철수"]),
        ("기안자 지침 안내", []),
        ("주무관 박영희 / 과장 최민수", ["박영희", "최민수"]),
        ("  행정 7급 홍길동  ", ["홍길동"]),
        ("급수운영팀 주무관 이한수", ["이한수"]),
        ("급수관리팀장 이한수 연락처", ["이한수"]),
        ("代 박영희 시행", ["박영희"]),
        ("과장\n김철수\n", ["김철수"]),
        ("공공주택과장 04/30 하대근", ["하대근"]),
        ("팀장(안승현)", ["안승현"]),
        ("04/30 홍길동", ["홍길동"]),
        ("팀장 안전 점검", []),
    ],
)
def test_approval_lines_on_request(text, names):
    assert not cascade(text).hits or all(h.tag != "APPROVAL_LINE" for h in cascade(text).hits)
    tape = mask_text(text, Options(approvals=True))
    assert [text[h.start : h.end] for h in sorted(tape.hits, key=lambda h: h.start) if h.tag == "APPROVAL_LINE"] == names
    assert tape.text == text  # for review only, so shown


def test_approval_flow_on_request():
    tape = cascade("결재방식: 전결\n代決\n", Options(approvals=True))
    assert tape.counts["APPROVAL_FLOW"] == 2 and tape.text == "결재방식: [APPROVAL_FLOW]\n[APPROVAL_FLOW]"
    assert cascade("기안자 김철수", Options(profile="legal", approvals=True)).hits == []


def test_restoring_is_linear_and_joins_overlaps():
    text = "성명: 오나래 010-1234-5678 " * 3000
    began = time.process_time()
    tape = mask_text(text)
    assert time.process_time() - began < 20
    assert tape.text == "성명: 오나래 [PHONE] " * 3000 and len(tape.at) == len(tape.text) + 1
    tape = Tape("abcdefghij")
    tape.edit([(2, 8, "[X]")])
    _restore(tape, [Hit("X", "cdef", 2, 8, "review", ""), Hit("X", "cdef", 2, 8, "review", "")])
    assert tape.text == "abcdefghij" and tape.at == list(range(11))


def test_a_processor_is_tried_again_and_replaced(spark):
    def flaky(chunk, options):
        tries[chunk] = tries.get(chunk, 0) + 1
        if "never" in chunk or ("second" in chunk and tries[chunk] < 2):
            raise OSError(chunk)
        return chunk.upper(), {"UP": 1}

    text = "first line\nsecond try\nnever 010-1234-5678\n"
    tries = {}
    out = processor.process(text, flaky, size=20, retries=2)
    assert out.masked == "FIRST LINE\nSECOND TRY\nnever [PHONE]\n"
    assert (out.retried, out.failed, out.fallback, dict(out.counts)) == (1, 1, 1, {"UP": 2, "PHONE": 1})
    with pytest.raises(RuntimeError, match="CHUNK_PROCESSOR_FAILED"):
        processor.process("never", flaky, required=True)

    def always(chunk, options):
        raise ValueError

    docs = spark.createDataFrame([(1, "call 010-1234-5678", "old"), (2, None, "x")], "doc_id int, text string, masked string")
    got = {r.doc_id: r for r in processor.mask_with(docs, always).collect()}
    assert got[1].masked == "call [PHONE]" and (got[1].failed_chunks, got[1].fallback_chunks, got[1].counts) == (1, 1, {"PHONE": 1}) and got[2].masked == ""


def test_masked_texts_as_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "가나\n다"), (2, None), (3, "끝\n")], "doc_id int, masked string")
    files.write_texts(rows, f"{tmp_path}/out")
    body = {p.parent.name: p.read_bytes().decode() for p in (tmp_path / "out").glob("doc_id=*/*.txt")}
    assert body == {"doc_id=1": "가나\n다\n", "doc_id=2": "\n", "doc_id=3": "끝\n"}
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_texts(rows, f"{tmp_path}/out")


CITED = [
    "대법원 2020. 1. 2. 선고 2019다12345 판결 및 서울중앙지방법원",
    "서울고등법원 2018. 3. 4.자 2017라55 결정과 사건번호: 2017라55 그리고 부산지방법원",
    "사건번호: 2023가단12345\n대법원 2019. 3. 4. 선고 2018다777 판결",
    "대 법 원 2020.1.2. 선고 2019다1 판결, 안양지원",
    "서울행정법원 2021구합100 판결과 서울행정법원",
]


@pytest.mark.parametrize("text", CITED)
def test_citations_left_out_are_citations_swapped_and_restored(text):
    """Courts in citations replaced by marks before the court rules run, and put back after, give the same text."""
    courts = [r for r in rules.rules() if r.kind == "court"]
    held = []

    def swap(m):
        held.append(m["kept"])
        return m[0].replace(m["kept"], f"\ue000{len(held) - 1}\ue001", 1)

    swapped = rules.CITED_COURT.sub(swap, text)
    for rule in courts:
        swapped = rule.pattern.sub(lambda m: "[COURT]" if ok.verdict("court", m["value"], m.string, *m.span("value")) else m[0], swapped)
    restored = re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])], swapped)
    only_courts = Options(profile="legal", off=frozenset(OPTION_NAMES) - {"court"})
    assert cascade(text, only_courts).text == restored
