"""Fixed values of the detection policy: word lists, label tables, number formats and label formats.

Results depend on exactly these values, so they are stated plainly, in one place, and used by rule tables and
validators elsewhere.
"""

from __future__ import annotations

# --- Fixed values: tags -----------------------------------------------------------------------------------------
#: tag: (label, source).  Other tags are labelled by their lower-case name, with source "regex".
TAGS = {
    "RRN": ("rrn", "regex_rrn"),
    "FOREIGN_REG": ("foreign_id", "regex_foreign_id"),
    "PHONE": ("phone", "regex_phone"),
    "EMAIL": ("email", "regex_email"),
    "BUSINESS_REG_NO": ("business_number", "regex_business_number"),
    "CARD": ("card_number", "regex_card_number"),
    "PASSPORT": ("passport_number", "regex_passport_number"),
    "ACCOUNT": ("bank_account", "regex_account_candidate"),
    "NAME": ("person_name", "regex_name_context"),
    "LEGAL_PARTY": ("person_name", "regex_legal_party"),
    "ADDRESS": ("address", "regex_address_context"),
    "PLACE": ("region_name", "regex_region"),
    "WEAK_PLACE": ("region_name", "dictionary_weak_place"),
    "REGION": ("region_name", "custom_region"),
    "ADDR_DETAIL": ("apartment_unit", "regex_address_detail"),
    "LOT_NO": ("lot_address", "regex_lot_address"),
    "CASE_NUMBER": ("case_number", "regex_case_number"),
    "DOC_META": ("document_number", "regex_document_meta"),
    "KEYWORD": ("custom_keyword", "manual_keyword"),
    "INSTITUTION_VALUE": ("institution_value", "fixed_region_institution"),
    "DEPARTMENT_VALUE": ("department_value", "fixed_region_department"),
}
REVIEW_TAGS = ("ADDRESS", "NAME", "LEGAL_PARTY", "PLACE", "WEAK_PLACE", "CASE_NUMBER", "DOC_META", "INSTITUTION_VALUE")
MASK_CONFIDENCE, REVIEW_CONFIDENCE = 0.99, 0.72
PROFILES = ("internal_review", "official_dispatch", "mixed", "legal")

# --- Fixed values: regions (the seed dictionary) --------------------------------------------------------------------
SIDO = (
    "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 경기도 강원특별자치도 "
    "충청북도 충청남도 전북특별자치도 전라남도 경상북도 경상남도 제주특별자치도"
).split()
SEOUL_GU = (
    "종로구 중구 용산구 성동구 광진구 동대문구 중랑구 성북구 강북구 도봉구 노원구 은평구 서대문구 마포구 양천구 강서구 구로구 "
    "금천구 영등포구 동작구 관악구 서초구 강남구 송파구 강동구"
).split()
SIGUNGU = [*SEOUL_GU, *"해운대구 수영구 동래구 남동구 연수구 부평구 수원시 성남시 고양시 용인시 영통구 제주시 서귀포시".split()]
EUPMYEONDONG = "목동 신정동 신월동 우동 구월동 송도동 광교동 이도동 연동 노형동".split()
WEAK_PLACES = "중동 상동 목동 우동 연동".split()

# --- Fixed values: person names --------------------------------------------------------------------------------------
SURNAMES = frozenset(
    "김이박최정강조윤장임한오서신권황안송전홍유고문양손배백허남심노하곽성차주우구민류나진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁"
    "은태국편봉피사예계간갈감견승시상빈부판팽후좌"
    "경궁근단돈두려로룡매목범복빙삼순아어옹용운음점종준즙창초춘탄평포풍필학해형호화환흥"
)
COMPOUND_SURNAMES = frozenset("남궁 황보 제갈 사공 선우 독고 서문".split())
NOT_PERSONS = frozenset(
    "관리 시스템 제도 정보 접수 신청 처리 개선 등록 변경 작성 담당 요청 서식 절차 안내 민원 직통 주장 반박 계획 기준 업무 결과 권한 문서 부서 대장 "
    "책임자 전결 대결 승인 상신 반려 공람 계약 시행 통보 회신 종결 이송 각하 기각 인용 취하 보류 완료 확인 협의 합의 재검토 "
    "관리시스템 하자관리 품질관리팀 하자관리팀 관리부서 관리부 시스템개선요청 하자관리사무실 관리자료 시스템안내".split()
)
NAME_BLOCKLIST = frozenset(
    "안전 장애인 점검 관리 지원 담당 업무 확인 검토 처리 완료 접수 신고 허가 계획 사업 운영 규정 조례 행정 민원 시설 건축 토목 환경 보건 위생 교통 예산 "
    "회계 총무 기획 감사 복지 교육 공사 준공 착공 승인 결재 반려 보완 시행 공람 상신 계약 결과 자료".split()
)
DOCUMENT_PHRASES = frozenset("검토 결과 의견 자료 보고 계획 기준 절차 안내 검토결과 검토의견 사건자료 처리결과 업무보고".split())
DOCUMENT_ENDINGS = tuple("결과 의견 자료 계획 기준 보고 절차 안내 요청 처리 검토".split())
APPROVAL_NOT_PERSONS = frozenset("공사 공사기간 연장 의원발의 드림 정함 최대 지급한 장학금 로서 주어진 권한을".split())
ORGANISATION_ENDINGS = tuple("센터 공단 공사 과 팀 국 실 부 처 청 원 소".split())
PERSON_LABELS = "이름 성명 민원인 신청인 보호자 대표자 제출인".split()
#: Words after a person label that start a workflow phrase, not a name.
AFTER_LABEL_NOT_NAMES = "제도 정보 접수 신청 처리 개선 등록 변경 작성 관리 담당 요청 서식 절차 안내 민원 직통 시스템 계획 기준 업무".split()
#: Particles that may follow a two-letter name, longest first.
PARTICLES = "이라고 라고 이라 께서 에게 한테 더러 보고 이 가 은 는 을 를 와 과 의 에 께 도 만 씨 군 양".split()
ROLES = (
    "주무관 사무관 서기관 부이사관 이사관 관리관 서기보? 주사보? 팀장 과장 국장 실장 센터장 담당자? 계장 부시장 시장 부구청장 구청장 인턴 사원 주임 선임 "
    "책임 수석 연구원 대리 차장 부장 본부장 사업부장 파트장 매니저 이사 상무 전무 부사장 사장 대표(?:이사)? CEO CTO CFO COO"
).split()

# --- Fixed values: legal ------------------------------------------------------------------------------------------------
PARTIES = "원고 피고 신청인 피신청인 상대방 항고인 피항고인 청구인 피청구인 채권자 채무자 고소인 피고소인 진정인 피진정인".split()
REPRESENTED = "원고 피고 신청인 피신청인 항고인 피항고인 청구인 피청구인 채권자 채무자".split()
HEADER_PARTIES = "원고 피고 신청인 피신청인 청구인 피청구인 항고인 피항고인 채권자 채무자".split()
TOP_COURTS = "대법원 헌법재판소 특허법원 회생법원 행정법원 가정법원 고등법원".split()
COURT_KINDS = "지방법원 고등법원 가정법원 행정법원 회생법원 지원".split()
COURT_BRANCHES = frozenset(
    "안양지원 성남지원 여주지원 평택지원 안산지원 부천지원 고양지원 남양주지원 강릉지원 원주지원 속초지원 영월지원 홍성지원 공주지원 논산지원 서산지원 천안지원 "
    "충주지원 제천지원 영동지원 안동지원 경주지원 포항지원 김천지원 상주지원 의성지원 영덕지원 마산지원 진주지원 통영지원 밀양지원 거창지원 목포지원 장흥지원 "
    "순천지원 해남지원 군산지원 정읍지원 남원지원".split()
)
NOT_COURT_ENDINGS = tuple(
    "자립지원 복지지원 생활지원 고용지원 주거지원 의료지원 교육지원 보육지원 돌봄지원 취업지원 창업지원 민원지원 행정지원 업무지원 서비스지원 기술지원 고객지원 "
    "운영지원 사업지원 재정지원 법률지원".split()
)

# --- Fixed values: organisations and official documents ------------------------------------------------------------------
COMPANY_PREFIXES = "주식회사 유한회사 합자회사 합명회사 의료법인 학교법인 사회복지법인 재단법인 사단법인".split()
COMPANY_LABELS = "회사명 법인명 상호 업체명 기관명".split()
INSTITUTION_ENDINGS = (
    "행정복지센터 동주민센터 주민센터 교육청 시의회 도의회 구의회 시청 군청 구청 도청 보건소 경찰서 소방서 우체국 공단 공사 재단 진흥원 연구원 문화원 복지관 "
    "의료원 센터"
).split()
UNITS = "과 팀 국 실 센터 사업소".split()
META_LABELS = (
    r"수신 참조 경유 문서\s*번호 공문\s*번호 방침\s*번호 시행\s*문서번호 시행\s*번호 시행 접수\s*번호 접수 결재\s*일자 작성\s*일자 시행\s*일자 "
    r"공개\s*여부 공개\s*구분 공개\s*등급 전송 팩스 FAX 담당\s*부서 부서 담당자(?:\s*\(\s*직통(?:전화)?\s*\))? 담당자\s*직통(?:전화)?"
).split(" ")
META_OCR_LABELS = (
    r"문서\s*번호 공문\s*번호 방침\s*번호 시행\s*문서\s*번호 시행\s*번호 시행 접수\s*번호 접수 결재\s*일자 작성\s*일자 시행\s*일자 "
    r"공개\s*여부 공개\s*구분 공개\s*등급 전\s*송 팩\s*스 fax FAX 담당\s*부서 담당자\s*직통(?:전화)?"
).split(" ")
META_STOPS = "관련 붙임 문서 사항 내용 참고 확인 바랍니다".split()

# --- Fixed values: number formats -----------------------------------------------------------------------------------------
DASHES = "‐‑‒–—―−－\\-"
ID_GAP = rf"(?:\s*[{DASHES}.]\s*|\s+)?"
PHONE_GAP = rf"[{DASHES}.\s]?"
AREA = r"0(?:2|[3-6][1-5]|70|50\d)"
PHONE_LABELS = "전화번호 대표전화 휴대전화 휴대폰 전화 연락처 팩스 FAX".split()
ACCOUNT_LABELS = "계좌번호 입금계좌 환급계좌 납부계좌 은행계좌".split()

# --- Fixed values: de-identification ----------------------------------------------------------------------------------------
PERSON_TAGS = ("NAME", "LEGAL_PARTY", "APPROVAL_LINE", "ATTORNEY")
ADDRESS_HEAD = r"(.{2,30}?(?:특별시|광역시|특별자치시|특별자치도|도|시|군|구))"
NAME_POOL = "김민준 이서연 박지훈 최하은 정도윤 강서윤 조현우 윤지아".split()
FIRM_POOL = "한빛 대정 새길 온율 바른길 해온".split()
#: Korean names of the tags in masked text.
KOREAN = {
    "RRN": "주민등록번호",
    "PHONE": "전화번호",
    "FOREIGN_REG": "외국인등록번호",
    "BUSINESS_REG_NO": "사업자등록번호",
    "CARD": "카드번호",
    "PASSPORT": "여권번호",
    "ACCOUNT": "계좌번호",
    "NAME": "이름",
    "ADDRESS": "주소",
    "PLACE": "지명",
    "ADDR_DETAIL": "상세주소",
    "LOT_NO": "지번",
    "LEGAL_PARTY": "당사자",
    "COMPANY": "회사명",
    "COURT": "법원명",
    "CASE_TITLE": "사건명",
    "CASE_NUMBER": "사건번호",
    "LAW_FIRM": "법무법인",
    "ATTORNEY": "변호사",
    "APPROVAL_LINE": "결재자",
    "APPROVAL_FLOW": "결재구분",
    "REGION": "지역",
    "DOC_META": "문서메타",
    "EMAIL": "이메일",
    "KEYWORD": "키워드",
    "MANUAL": "마스킹",
}

# --- Fixed values: labels on public documents --------------------------------------------------------------------------------
REGION_LABELS = frozenset("소재지 관할지역 관할구역 관할 해당지역 위치 지역 행정구역".split())
PROFILE_LABELS = frozenset("수신 수신자 참조 시행 발신 담당".split())
ADDRESS_LABELS = frozenset("주소 소재지 거소 사업장주소 송달장소 주민등록상주소 본점소재지".split())
INSTITUTION_ADDRESS_LABELS = frozenset("기관주소 기관소재지 사업장주소 본점소재지 청사주소".split())
INSTITUTION_LABELS = frozenset("기관명 법인명 회사명 상호 업체명 소속기관 발신기관 수신기관 담당부서 부서명".split())
CONTACT_LABELS = frozenset("우편번호 우 전화 전화번호 대표전화 전송 팩스 fax 이메일 email 전자우편".split())
REGION_ENDINGS = tuple("시 군 구 읍 면 동 도".split())
QUOTES = ('""', "''", "“”", "「」", "『』")

# --- Fixed values: approval lines (recognisers that every profile leaves off) -----------------------------------------------------
APPROVAL_LABELS = "기안자 기안 검토자 검토 협조자 협조 결재권자 최종결재권자 결재자 전결권자 대결권자 전결 대결 결재".split()
NOT_SIGNERS = "지침 절차 기준 양식 규정 문서 작성 검토 결재 업무 계획 방법 지시 공문 시행 요청 사유 완료 안내 결과 권한 하여 위하여 대하여".split()
OFFICIAL_ROLES = (
    "주무관 사무관 서기관 부이사관 이사관 관리관 지방시설서기 지방시설서기보 서기 서기보 주사 주사보 사무주사 사무주사보 팀장 과장 국장 실장 센터장 계장 부시장 시장 "
    "부구청장 구청장 인턴 사원 주임 선임 책임 수석 연구원 선임연구원 책임연구원 수석연구원 대리 차장 부장 본부장 사업부장 파트장 매니저 이사 상무 전무 부사장 사장 대표 "
    "대표이사 CEO CTO CFO COO"
).split()
LINE_ROLES = [*OFFICIAL_ROLES, *"담당자 담당 행정팀장 민원팀장 복지팀장 건축과장 총무과장".split()]
HEAD_ROLES = "팀장 과장 국장 실장 센터장 본부장 사업부장 부시장 시장 부구청장 구청장".split()
GRADE_SERIES = "행정 시설 건축 토목 전산 세무 사회복지 보건 환경 녹지 기계 전기 화공 농업 임업 해양수산 지적 사서 간호 의료기술 운전 방호 통신 방재안전".split()
FLOW_WORDS = r"(?:전\s*결|대\s*결|代\s*決|專\s*決|代)"
