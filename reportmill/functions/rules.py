"""Phrases and patterns that text cleaning goes by; pass other Rules to change them."""

from __future__ import annotations

from dataclasses import dataclass

# The phrase lists and patterns below must be exactly these for the cleaning to give the expected results.

SIDEBAR_MARKERS = ("STOCK DATA", "COMPANY DATA")

SIDEBAR_TERMS = (
    "재무상태표", "포괄손익계산서", "현금흐름표", "주요투자지표",
    "주가 및 상대수익률", "영업실적 및 투자지표",
    "발행주식수", "외국인 지분율", "주요주주",
    "영업활동 현금흐름", "투자활동 현금흐름", "재무활동 현금흐름",
)

LABELS = (
    "발행주식수", "평균거래량", "평균거래대금", "시가총액",
    "액면가", "자본금", "외국인지분", "외국인 지분", "외국인지분율", "외국인 지분율",
    "배당수익률", "배당금", "결산월",
    "52주최고", "52주최저", "52주 최고", "52주 최저",
    "현재가", "목표주가", "업종", "시장",
    "주요주주", "최대주주", "국민연금공단", "국민연금",
    "PER", "PBR", "EPS", "BPS", "ROE", "ROA", "EV/EBITDA",
    "OPM", "NPM", "PER(배)", "PBR(배)", "ROE(%)", "OPM(%)", "EBITDA", "순차입금",
    "기타자본구성요소", "부채와자본총계", "운전자본감소(증가)",
    "매출채권및기타채권의감소(증가)", "재고자산의감소(증가)", "매입채무및기타채무의증가(감소)",
    "금융자산의감소(증가)", "순차입금/자기자본", "유형자산의감소(증가)", "무형자산의감소(증가)",
    "단기금융부채의증가(감소)", "장기금융부채의증가(감소)", "자본의증가(감소)", "주당 현금배당금",
    "현금의 증가(감소)", "판매 및 일반관리비", "유동성이자부채", "비유동이자부채",
    "재고자산감소(증가)", "장기투자증권감소", "판매비와 관리비",
    "Price & Relative Performance", "Relative Performance",
    "주가수익률", "절대수익률", "상대수익률", "매도가능금융자산평가",
)

DISCLAIMERS = (
    "본인의 의견을 정확하게 반영하고 있으며",
    "외부의 부당한 압력이나 간섹없이",
    "신의성실하게 작성되었음을 확인",
    "본 보고서에 언급된 종목의 경우 당사 조사분석담당자",
    "당사 조사분석담당자는 본인의 담당종목을 보유하고 있지 않습니다",
    "본 보고서는 기관투자가 또는 제 3 자에게 사전 제공",
    "기관투자가 또는 제3자에게 사전 제공",
    "당사는 자료공표일 현재 해당기업과 관련하여 특별한 이해 관계",
    "자료는 고객의 증권투자의 결과에 대한 법적 책임소재",
    "투자판단 3 단계(6 개월기준)",
    "투자판단 3단계(6개월기준)",
    "종목별 투자의견은 다음과 같습니다",
    "해당회사의 지분을 1%이상 보유",
    "해당회사의 유가증권을 보유하고 있지 않습니다",
    "본 자료를 작성한 애널리스트",
    "본 조사자료는 고객의 투자에 정보를",
    "본 자료는 고객의 주식투자의 결과에",
    "무단 복제 및 배포 될 수 없습니다",
    "그 정확성이나 완전성을 보장할 수 없으므로",
    "_목표주가가 현주가 대비",
    "_업종지수가 현재지수 대비",
    "기관투자가 등 제 3자에게 사전 제공",
    "기관투자가 등 제3자에게 사전 제공",
    "신의성실 하게",
    "투자자 자신의 판단과 책임하에",
    "법적 책임소재의 증빙자료로",
    "기준일:",
    "당 보고서 공표일 기준으로",
    "회사는 해당 종목을 1%이상 보유",
    "금융투자분석사와 그 배우자",
    "E-mail등을 통하여 사전에 배포",
    "주관사로 참여하지 않았습니다",
    "본 분석자료는 투자자의 증권투자를",
    "종목투자의견은 향후 12개월간",
    "추천일 종가대비",
    "무단전재 등으로 인한 분쟁발생시",
    "법적 책임이 있음을 주지",
    "금융투자업규정 4-20조",
    "재산적 이해관계가 없습니다",
    "계열회사의 관계가 없으며",
    "외부 부당한 압력이나",
    "투자판단에 참고가 되는 정보제공",
    "정확성이나 완벽성은 보장하지 않습니다",
    "투자의 최종 결정은 자신의 판단으로",
    "업종지수상승률이 시장수익률 대비",
    "시장수익률 대비 10%p 이상",
    "시장수익률 대비 -10%p",
    "괴리율(최대/최소",
    "당사는 자료 작성일 기준",
    "유가증권 발행에 참여한 적이 없습니다",
    "해당종목의 주식을 1.0% 이상 보유하고 있지 않습니다",
    "동 자료는 당사의 제작물로서 모든 저작권은 당사에게 있습니다",
    "동 자료는 당사의 동의 없이 어떠한 경우에도",
    "동 자료에 수록된 내용은 당사 리서치센터가 신뢰할 만한",
    "고객의 주식투자의 결과에 대한 법적 책임소재에 대한 증빙자료로 사용될 수 없습니다",
)

CUT_MARKERS = (
    "Compliance Notice", "compliance notice", "COMPLIANCE NOTICE",
    "Analyst Certification", "ANALYST CERTIFICATION",
    "투자기간 및 투자등급",
    "당사 투자의견 비율",
    "투자의견 비율(%)",
    "본 자료는 고객의 증권투자를 돕기 위한",
    "본 자료는 투자자의 증권투자를 돕기 위한",
    "투자의견 변동 내역",
    "투자등급 관련사항",
    "투자의견의 유효기간",
    "금융투자상품의 비율",
    "당사 투자등급 체계",
    "리포트 이용 안내",
    "목표주가 변동추이",
    "종목추천 투자등급",
    "투자의견 비율공시",
    "투자의견 및 목표주가 변경 내용",
    "금융투자업규정",
)

NUMERIC = (
    r"^-?[\d,\.\+]+(십억원|억원|조원|천원|[%원만억조십천백])?$",
    r"^NA$|^N/A$|^-$|^\+$",
    r"^\d{1,2}[QHqh]\d{2,4}$",
    r"^\d{4}[년./-]\d{1,2}[월분기]?$",
)

CAPTIONS = (
    r"^(자료|Source)\s*[::：]",
    r"^(그림|도표)\s*\d+\s*[\. ]",
    r"^표\s*\d+\s*[\. ]",
    r"^주\s*[\d\*]*\s*[::：\.\*\)]",
    r"^Figure\s+\d+",
    r"^\*\s*(기준일|주\s*:)",
    r"^!\[.*\]\(.*\)",
)

ROW_LABELS = (
    r"손익|순이익|포괄이익|지분이익",
    r"지분법이익|지분법손실|지분법관련",
    r"사업이익|계속사업|세전계속|세전이익",
    r"유동자산|비유동자산|유동부채|비유동부채|유동성장기",
    r"증가율|감소율|성장률|이익률|수익률|회전율|보상배율",
    r"현금흐름|현금및현금성|현금성자산|현금 및 현금",
    r"누계액|주주지분|이자보상",
    r"자산부채|매출채권|매입채무|미지급금|선급금|선수금",
    r"판매비와관리비|판관비|감가상각|상각비",
    r"관계기업|종속기업|지분법",
    r"비현금항목|비현금성|유가증권평가",
    r"기타채권|기타채무|기타자산|기타부채",
    r"투자자산|투자부채",
    r"처분\(|취득\(",
    r"의\s*가감|의\s*증감|의\s*변동",
    r"재무제표|요약재무|연결재무",
    r"Financial Ratio|Peer Valuation|K-IFRS",
)

# End of the fixed values.


@dataclass(frozen=True)
class Rules:
    sidebar_markers: tuple[str, ...] = SIDEBAR_MARKERS
    sidebar_terms: tuple[str, ...] = SIDEBAR_TERMS
    labels: tuple[str, ...] = LABELS
    disclaimers: tuple[str, ...] = DISCLAIMERS
    cut_markers: tuple[str, ...] = CUT_MARKERS
    numeric: tuple[str, ...] = NUMERIC
    captions: tuple[str, ...] = CAPTIONS
    row_labels: tuple[str, ...] = ROW_LABELS


DEFAULT = Rules()
