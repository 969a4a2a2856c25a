"""The recogniser table: one row per rule, in the order in which rules rewrite the text.

A rule's ``kind`` says what happens to a match:

  whole    the match (or its value group) is a hit, the whole match becomes the tag's token
  labelled the label stays, the rest of the match becomes the token
  phones   the label stays, every number in the value is a hit with a token of its own
  titled   the number before a title stays
  noted    the value is a hit, the text stays
  court    as whole, if the value is a court by its surroundings; citations stay in legal texts
  docket   as labelled; numbers in citations stay in legal texts
  header   as labelled, in the first 1200 characters
  parties  every party name found so far becomes a token wherever it stands
  signer   the value becomes the token, if it is a person's name by its surroundings
  below    as signer, the name standing on the line below its label
  signers  every name in a row of roles and names that is one by its surroundings
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cache

from ..functions import fixed as V
from ..functions import validators as ok


@dataclass(frozen=True)
class Rule:
    tag: str
    kind: str
    pattern: re.Pattern[str] | None = None
    option: str = ""
    profiles: tuple[str, ...] = V.PROFILES
    guard: Callable[[str], bool] | None = None
    near: re.Pattern[str] | None = None
    #: A character that every match has; texts without one are passed over.
    needs: re.Pattern[str] | None = None


_HANGUL, _DIGIT, _AT = re.compile("[가-힣]"), re.compile(r"\d"), re.compile("@")
#: Tags whose values need no Hangul.
_PLAIN = {"CARD": _DIGIT, "RRN": _DIGIT, "FOREIGN_REG": _DIGIT, "BUSINESS_REG_NO": _DIGIT, "PHONE": _DIGIT, "PASSPORT": _DIGIT, "EMAIL": _AT}
PUBLIC = V.PROFILES[:3]
LEGAL = V.PROFILES[3:]


def one_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def literal(words: Iterable[str]) -> str:
    return one_of(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def spaced(word: str) -> str:
    """A word whose letters may be set apart."""
    return r"\s*".join(word)


def digits(n: int) -> str:
    return r"\d" + r"(?:\s*\d)" * (n - 1)


def _labelled(labels: str, gap: str, value: str, end: str = "") -> str:
    return rf"(?P<label>{labels}{gap})(?P<value>{value}){end}"


COLON = r"\s*[:：]\s*"
COLON_OR_SPACE = r"(?:\s*[:：]\s*|\s+)"
_BETWEEN_SLASHES = rf"(?![\d{V.DASHES}])"
_NOT_IN_NUMBER = rf"(?<![\d{V.DASHES}])"
_LINE = rf"{V.PHONE_GAP}\d{{3,4}}{V.PHONE_GAP}\d{{4}}"
_NATION = rf"(?:\+?82{V.PHONE_GAP})?"
_MOBILE, _LANDLINE, _SHORT = rf"{_NATION}0?1[016789]{_LINE}", rf"\(?(?:{V.AREA})\)?{_LINE}", rf"1[5-8]\d{{2}}{V.PHONE_GAP}\d{{4}}"
_ANY_PHONE = rf"{_NATION}(?:0?1[016789]|\(?{V.AREA}\)?){_LINE}|{_SHORT}"
PHONE = re.compile(_ANY_PHONE)
_YEAR = r"(?:19|20)\d{2}"
_SHORT_DATE = rf"\s*\(\s*(?:{_YEAR}|['’](?:\d{{2}}))\.\s*\d{{1,2}}\.\s*\d{{1,2}}\.?\s*\)"
_LOOSE_DATE = rf"\s*\(\s*(?:{_YEAR}|['’]?\d{{2}})\.\s*\d{{1,2}}\.\s*\d{{1,2}}\.?\s*\)"
_SPACED_NAME = r"(?:[가-힣]{2,4}|[가-힣](?:\s*[가-힣]){1,3})"
_LOOSE_TOP = one_of(spaced(c) for c in V.TOP_COURTS)
_LOOSE_KIND = one_of(spaced(c) for c in V.COURT_KINDS)
LOOSE_COURT = rf"(?:{_LOOSE_TOP}|(?:[가-힣]\s*){{2,12}}{_LOOSE_KIND})"
_TIGHT_TOP = one_of(c for c in V.TOP_COURTS if c != "헌법재판소")
_RULING = r"(?:판\s*결|결\s*정)"
_LOOSE_DOCKET = rf"{_YEAR}\s*(?:[가-힣]\s*){{1,4}}\s*\d{{1,10}}"
_SPACED_DAY = rf"{_YEAR}\s*\.\s*\d{{1,2}}\s*\.\s*\d{{1,2}}"
#: A name after a role in a row of them.
IN_ROW = re.compile(r"(?:^|[\s|/,])[가-힣A-Za-z0-9]{1,30}?[관장급긍금]\s*(?P<value>[가-힣]{2,4}?)(?=\s*(?:[|/,]|$)|\s+[가-힣A-Za-z0-9]{1,30}?[관장급긍금])")
#: A court cited with a ruling, and a docket number cited so.
CITED_COURT = re.compile(
    rf"(?P<kept>{LOOSE_COURT})(?=\s*(?:{_SPACED_DAY}\s*\.\s*선\s*고\s*{_LOOSE_DOCKET}\s*{_RULING}|{_SPACED_DAY}\s*\.?\s*자\s*{_LOOSE_DOCKET}\s*결\s*정|{_LOOSE_DOCKET}\s*{_RULING}))"
)
CITED_DOCKET = re.compile(
    rf"(?:대법원|헌법재판소|[가-힣]{{2,12}}{one_of(V.COURT_KINDS)})\s*{_YEAR}\.\s*\d{{1,2}}\.\s*\d{{1,2}}\.\s*선고\s*(?P<kept>{_YEAR}\s*[가-힣]{{1,4}}\s*\d{{1,10}})\s*(?:판결|결정)"
)
_HEADS = one_of(spaced(p) for p in V.HEADER_PARTIES)
_ROAD_OR_LOT = r"(?:\s+[가-힣0-9·\-]+(?:로|길)\s*\d{1,4}(?:-\d{1,4})?|\s+\d{1,4}(?:-\d{1,4})?\s*번지?)?"


def _addresses() -> list[Rule]:
    """Addresses from the region dictionary: province and district, or district and neighbourhood."""
    province, district, area = literal(V.SIDO), literal(V.SIGUNGU), literal(V.EUPMYEONDONG)
    bodies = [rf"{province}\s+{district}(?:\s+{area})?", rf"{district}\s+{area}"]
    return [_rule("ADDRESS", "whole", rf"(?P<value>{b}{_ROAD_OR_LOT})", "address") for b in bodies]


def _rule(tag: str, kind: str, pattern: str, option: str = "", profiles: tuple[str, ...] = V.PROFILES, guard=None, near=None, flags: int = 0) -> Rule:
    needs = _PLAIN.get(tag, None if "FAX" in pattern else _HANGUL)
    return Rule(tag, kind, re.compile(pattern, flags), option, profiles, guard, near, needs)


@cache
def rules() -> tuple[Rule, ...]:
    """Every rule that a profile can switch on, in order."""
    gu, seoul = literal(V.SEOUL_GU), "(?:서울특별시|서울시|서울)"
    parties, represented = one_of(V.PARTIES), one_of(V.REPRESENTED)
    place_seen = re.compile(r"\[PLACE\]|주소")
    table = [
        _rule("CARD", "whole", rf"(?<!\d)(?:\d{{4}}{V.ID_GAP}){{3}}\d{{4}}(?!\d)"),
        _rule("RRN", "whole", rf"(?<!\d){digits(6)}{V.ID_GAP}[1-4](?:\s*\d){{6}}(?!\d)", "rrn"),
        _rule("FOREIGN_REG", "whole", rf"(?<!\d){digits(6)}{V.ID_GAP}[5-8](?:\s*\d){{6}}(?!\d)", "rrn"),
        _rule("BUSINESS_REG_NO", "whole", rf"(?<!\d)\d{{3}}{V.ID_GAP}\d{{2}}{V.ID_GAP}\d{{5}}(?!\d)", "business_reg"),
        _rule("PHONE", "phones", _labelled(one_of(V.PHONE_LABELS), r"\s*[:：]?\s*", rf"(?:{_ANY_PHONE})(?:\s*[,;/·]?\s*(?:{_ANY_PHONE}))*"), "phone", flags=re.IGNORECASE),
        _rule("PHONE", "whole", _NOT_IN_NUMBER + _MOBILE + _BETWEEN_SLASHES, "phone"),
        _rule("PHONE", "whole", _NOT_IN_NUMBER + _LANDLINE + _BETWEEN_SLASHES, "phone"),
        _rule("PHONE", "whole", _NOT_IN_NUMBER + _SHORT + _BETWEEN_SLASHES, "phone"),
        _rule("PASSPORT", "whole", r"(?<![A-Za-z0-9])(?:[MSRODmsrod]\d{8}|[A-Za-z]{2}\d{7})(?![A-Za-z0-9])"),
        _rule("ACCOUNT", "labelled", _labelled(rf"\b{one_of(V.ACCOUNT_LABELS)}\b", r"\s*[:：]?\s*", rf"(?:\d{{2,6}}{V.ID_GAP}){{2,5}}\d{{2,6}}", r"(?!\d)")),
        _rule(
            "EMAIL",
            "whole",
            r"(?P<value>(?<![A-Za-z0-9])(?!(?:[Ee]-?mail|[Cc]ontact)\s)[A-Za-z0-9._%+-]+(?:\s+[A-Za-z0-9._%+-]+)?\s*@\s*[A-Za-z0-9-]+(?:\s*\.\s*[A-Za-z0-9-]+)+)",
            "email",
        ),
        _rule(
            "NAME",
            "labelled",
            _labelled(rf"\b{one_of(['이름', '성명', '민원인', '신청인', '담당자', '보호자', '대표자', '제출인'])}\b", COLON_OR_SPACE, rf"(?!{one_of(V.AFTER_LABEL_NOT_NAMES)}(?=\s|[:：]|$))[가-힣]{{2,4}}"),
            "name",
            guard=ok.guard("labelled_name"),
        ),
        _rule("ADDRESS", "labelled", _labelled(r"\b우\s?", "", r"\d{5}", r"(?!\d)"), "address"),
        _rule("ADDRESS", "labelled", _labelled(r"\b(?:우편\s*번호|주소|소재지)\b", COLON, r"\d{5}", r"(?!\d)"), "address"),
        _rule("ADDRESS", "labelled", _labelled(r"\b주소\b", COLON, r"[^\n,;]+"), "address", guard=ok.guard("address")),
        _rule("ADDRESS", "labelled", _labelled(r"\b(?:주소|소재지|거소|사업장\s*주소|송달장소|주민등록상\s*주소|본점\s*소재지)\b", COLON, r"[^\n,;]+"), "address", guard=ok.guard("address")),
        *_addresses(),
        _rule("PLACE", "whole", rf"{seoul}\s*{gu}", "place"),
        _rule("PLACE", "whole", rf"(?<![가-힣]){gu}(?![가-힣])", "place"),
        _rule("PLACE", "whole", rf"{seoul}\s*양천구", "place"),
        _rule("PLACE", "whole", "양천구", "place"),
        _rule("PLACE", "whole", r"목\s*(?:[1-5]\s*)?동", "place"),
        _rule("PLACE", "whole", r"신정\s*(?:[123467]\s*)?동", "place"),
        _rule("PLACE", "whole", r"신월\s*(?:[1-7]\s*)?동", "place"),
    ]
    if weak := [w for w in V.WEAK_PLACES if len(w) > 2]:
        table.append(_rule("WEAK_PLACE", "noted", rf"(?<![가-힣])(?P<value>{literal(weak)})(?![가-힣])", "place"))
    table += _after_places(place_seen, parties, represented)
    return tuple(table)


def _after_places(place_seen: re.Pattern[str], parties: str, represented: str) -> list[Rule]:
    return [
        _rule("ADDR_DETAIL", "whole", r"[가-힣0-9·\-\s]{1,20}(?:로|길)\s*\d{1,4}(?:-\d{1,4})?", "address", near=place_seen),
        _rule("LOT_NO", "whole", r"(?<!\d)\d{1,4}(?:-\d{1,4})?\s*번지(?!\d)", "address", near=place_seen),
        _rule("LEGAL_PARTY", "labelled", _labelled(rf"\b{parties}\b", COLON, r"[^\n,;()]{2,40}"), "legal_party", LEGAL, ok.guard("labelled_name")),
        _rule("LEGAL_PARTY", "labelled", _labelled(rf"\b{parties}\b", r"\s+", rf"(?!(?:측|측은|측이|대리인|소송대리인|법무법인|법률사무소)(?=\s|$)){_SPACED_NAME}", r"(?=[^가-힣]|$)"), "legal_party", LEGAL, ok.guard("name")),
        _rule(
            "LEGAL_PARTY",
            "labelled",
            _labelled(rf"\b{represented}\b\s*(?:소송\s*대리인|법률\s*대리인|대리인)\b", COLON_OR_SPACE, rf"(?!(?:법무법인|법률사무소|담당변호사|변호사)(?=\s|$)){_SPACED_NAME}", r"(?=[^가-힣]|$)"),
            "legal_party",
            LEGAL,
            ok.guard("name"),
        ),
        _rule(
            "LEGAL_PARTY",
            "header",
            rf"(?P<label>{_HEADS})\s*(?P<value>(?!(?:측|대리인|소송대리인|법무법인|법률사무소|주장|주장의|주장과|주장에))[가-힣]{{2,6}}?)(?=(?:{_HEADS}|\s|$))",
            "legal_party",
            LEGAL,
        ),
        Rule("LEGAL_PARTY", "parties", None, "legal_party", LEGAL),
        _rule("COMPANY", "labelled", _labelled(rf"\b{one_of(V.COMPANY_LABELS)}\b", COLON_OR_SPACE, r"[^\n]{2,80}"), "company", guard=ok.guard("company")),
        _rule("COMPANY", "whole", rf"(?P<value>(?<![가-힣A-Za-z0-9])(?:{'|'.join(V.COMPANY_PREFIXES)}|[(（]주[)）])\s*[A-Za-z0-9가-힣&.,()\-]{{1,30}}(?![가-힣A-Za-z0-9]))", "company"),
        _rule("COURT", "court", rf"(?<![가-힣])(?P<value>(?:{_TIGHT_TOP}|[가-힣]{{2,12}}{one_of(V.COURT_KINDS)})(?:\s*[가-힣0-9]{{1,12}}(?:지원|재판부))?)(?![가-힣])", "court", LEGAL),
        _rule("COURT", "court", rf"(?<![가-힣])(?P<value>{LOOSE_COURT})(?![가-힣])", "court", LEGAL),
        _rule("CASE_TITLE", "labelled", _labelled(r"\b(?:사건명|사건제목|사건명칭)\b", COLON, r"[^\n]+"), "case_title", LEGAL),
        _rule("CASE_TITLE", "labelled", _labelled(r"\b제목\b", COLON, r"[^\n]+"), "case_title", LEGAL),
        _rule("CASE_TITLE", "titled", rf"^(?P<label>{_YEAR}\s*[가-힣]{{1,4}}\s*\d{{1,10}})\s+(?P<value>[^\n]{{2,100}})$", "case_title", LEGAL, flags=re.MULTILINE),
        _rule("CASE_NUMBER", "docket", _labelled(r"\b(?:사건번호|사건|당해\s*사건|이\s*사건|본건)\b", r"\s*[:：]?\s*", rf"{_YEAR}\s*(?!구\s*상)(?:[가-힣]\s*){{1,4}}\d{{1,10}}"), "case_number", LEGAL),
        _rule("LAW_FIRM", "labelled", _labelled(r"\b(?:법무법인|법률사무소|변호사사무실|소속법무법인)\b", COLON, r"[^\n,;]{2,60}"), "law_firm", LEGAL, ok.guard("law_firm")),
        _rule("LAW_FIRM", "labelled", _labelled(r"\b(?:법무법인|법률사무소|변호사사무실)\b", r"\s+", r"[A-Za-z0-9가-힣&.()\-]{2,30}", r"(?=$|[\s,;])"), "law_firm", LEGAL, ok.guard("law_firm")),
        _rule("ATTORNEY", "labelled", _labelled(r"\b(?:변호사|담당변호사|소송대리인|법률대리인|선임변호사)\b", COLON, r"[가-힣A-Za-z ]{2,30}"), "attorney", LEGAL),
        *_approvals(),
        _rule("REGION", "labelled", _labelled(r"\b(?:소재지|관할지역|관할구역|관할|해당지역|위치|지역|행정구역)\b", COLON, r"[^\n,;]{2,80}"), "region_context", PUBLIC, ok.guard("address")),
        _rule(
            "DOC_META",
            "labelled",
            _labelled(r"(?:^|\s)시\s*행", r"(?:\s+|\s*[:：]\s*)", rf"[^\n]{{0,60}}?(?:[가-힣A-Za-z0-9]{{1,24}}{one_of(V.UNITS)}?\s*[-–—]\s*\d{{1,8}}(?:-\d{{1,8}})?)(?:{_LOOSE_DATE})?"),
            "doc_meta",
            PUBLIC,
            ok.guard("meta"),
            flags=re.MULTILINE | re.IGNORECASE,
        ),
        _rule("DOC_META", "labelled", _labelled(rf"(?:^|[\r\n])\s*{one_of(V.META_LABELS)}", COLON_OR_SPACE, r"[^\n]{1,140}?", rf"(?=\s+{one_of(V.META_STOPS)}\b|[\r\n]|$)"), "doc_meta", PUBLIC, ok.guard("meta")),
        _rule("DOC_META", "labelled", _labelled(rf"(?:^|[\r\n])\s*{one_of(V.META_OCR_LABELS)}", COLON_OR_SPACE, r"[^\n]{1,140}"), "doc_meta", PUBLIC, ok.guard("meta")),
        _rule("DOC_META", "whole", rf"(?P<value>[가-힣A-Za-z0-9]+과\s*(?:[-–]\s*\d{{1,6}}(?:{_SHORT_DATE})?\s*호(?:{_SHORT_DATE})?|제\s*\d{{1,6}}\s*호(?:{_SHORT_DATE})?))", "doc_meta", PUBLIC),
        _rule("DOC_META", "whole", rf"(?P<value>[가-힣A-Za-z0-9]{{1,20}}{one_of(V.UNITS)}\s*[-:]\s*\d{{3,5}})", "doc_meta", PUBLIC),
        _rule("DOC_META", "whole", r"(?P<value>부분공개\s*\(\s*\d{1,2}\s*\)|비공개\s*\(\s*\d{1,2}\s*\)|전부공개)", "doc_meta", PUBLIC),
    ]


def _approvals() -> list[Rule]:
    """Names and flow words of approval lines.  No profile runs these by itself; ``Options.approvals`` does."""
    longest = lambda words: one_of(sorted(words, key=len, reverse=True))
    not_signer = rf"(?!{one_of(V.NOT_SIGNERS)}(?=\s|$))"
    name = r"(?:[가-힣]{2,4}|[가-힣]\s*[가-힣]{1,3})"
    role, line_role, head = longest(V.OFFICIAL_ROLES), longest(V.LINE_ROLES), longest(V.HEAD_ROLES)
    series = one_of(V.GRADE_SERIES)
    grade, loose_grade = rf"{series}\s*[1-9]\s*[급긍]", rf"{series}\s*[1-9Bb]\s*[급긍금]"
    unit = r"[가-힣A-Za-z0-9]"
    day = rf"(?:\d{{1,2}}\s*/\s*\d{{1,2}}|{_YEAR}\.\s*\d{{1,2}}\.\s*\d{{1,2}}\.?)"
    pair = rf"(?:{role}|{loose_grade})\s*{name}"
    gap = r"(?:\s*[|/,]\s*|\s+)"
    after = r"(?=(?:연락처|전화번호|대표전화|휴대전화|휴대폰|전화|팩스|FAX|[\s\d:：,;/·]|$))"
    rows = [
        ("signer", _labelled(rf"\b{longest(V.APPROVAL_LABELS)}\b", COLON_OR_SPACE, not_signer + "[가-힣A-Za-z]{2,20}"), 0),
        ("signer", _labelled(rf"\b{line_role}\b", COLON_OR_SPACE, not_signer + name), 0),
        ("signer", rf"^\s*(?P<label>{loose_grade}){COLON_OR_SPACE}(?P<value>{name})\s*$", re.MULTILINE),
        ("signer", _labelled(rf"{unit}{{1,20}}{one_of([*V.UNITS, '본부', '사업부'])}\s*{role}", r"\s*", name), 0),
        ("signer", _labelled(rf"{unit}{{1,24}}{role}", r"\s*", r"(?:[가-힣]{2,4}?|[가-힣]\s*[가-힣]{1,3}?)", after), 0),
        ("signer", _labelled("代", r"\s*", "[가-힣]{2,4}?", r"(?=(?:친|협조자|수신|시행|접수|[\s\d:：,;/·]|$))"), 0),
        ("below", rf"^(?P<label>{role}|{grade}|{unit}{{1,20}}{head})\s*$\n^(?P<value>[가-힣]{{2,4}})\s*$", re.MULTILINE),
        ("signers", rf"(?P<value>{pair}{gap}{pair}(?:{gap}?{pair})*)", 0),
        ("signer", _labelled(rf"(?:^|\s){unit}{{0,24}}{longest(['주무관', *V.HEAD_ROLES])}(?:\s*{day})?", r"\s*[(\[]\s*", "[가-힣]{2,6}", r"(?=\s*[)\]])"), re.MULTILINE | re.IGNORECASE),
        ("signer", _labelled(rf"(?:^|\s){unit}{{1,24}}{head}\s*{day}", r"\s*[:：]?\s*", "[가-힣]{2,4}", r"(?=\s|$)"), re.MULTILINE | re.IGNORECASE),
        ("signer", _labelled(rf"(?:^|\s){day}", r"\s*[:：]?\s*", "[가-힣]{2,4}", r"(?=\s|$)"), re.MULTILINE | re.IGNORECASE),
    ]
    flow = _labelled(r"\b(?:결재\s*구분|결재\s*방식|결재\s*방법)\b", r"\s*[:：]?\s*", V.FLOW_WORDS, r"(?![가-힣A-Za-z0-9])")
    return [
        *(_rule("APPROVAL_LINE", kind, pattern, "approval_line", PUBLIC, flags=flags) for kind, pattern, flags in rows),
        _rule("APPROVAL_FLOW", "labelled", flow, "approval_line", PUBLIC, flags=re.IGNORECASE),
        _rule("APPROVAL_FLOW", "whole", rf"^\s*(?P<value>{V.FLOW_WORDS})\s*$", "approval_line", PUBLIC, flags=re.MULTILINE | re.IGNORECASE),
    ]
