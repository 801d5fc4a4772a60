"""Truth tables and properties of the cleaning expressions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reportmill.functions import rules as R
from reportmill.functions import text as X

SHORT, LONG = "가나다라 12", "This line is long enough not to be a label at all"


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


NOISE = [
    ("", False), ("   ", False), ("기준일: 2026년 2월 1일", True), ("자료: 회사 자료, 리서치센터", True), ("SOURCE : somebody who wrote something", True), ("PER", True), ("  현재가\t", True),
    ("매출채권 1,234 1,300", True), ("Financial Ratio", True), ("전년 동기 대비 매출 증가율은 시장 기대치를 상회", False), ("가나다라마바사아자차증가율", True), ("가나다라마바사아자차카증가율", False),
    ("# 요약", True), ("1Q22 2Q22 3Q22 4Q22 1Q23 2Q23", True), ("Consolidated 1,200 -3.5% growth", True), ("sales 1,200 1,300 growth rates ok", False), ("Revenue grew strongly in the quarter", False),
    ("x" * 19, True), ("x" * 20, False), ("가나다라마바사 x", False), ("가나다라마바 x", True), ("abc 증가율 " + "x" * 26, True), ("abc 증가율 " + "x" * 27, False),
]


def test_noise_lines(spark):
    assert values(spark, X.noise_line, [t for t, _ in NOISE]) == [v for _, v in NOISE]


BLOCKS = [
    ("a STOCK DATA b", True), ("x" * 295 + "주요주주", True), ("x" * 296 + "주요주주", False), ("\n".join([SHORT] * 6 + [LONG] * 2), True), ("\n".join([SHORT] * 5 + [LONG] * 3), False),
    ("\n".join([SHORT] * 5), False), ("\n \n".join([SHORT] * 6), True), ("\n".join(["가 1"] * 8), False), ("\n".join(["가나다라마바사아자차"] * 8), False), ("", False),
]


def test_sidebar_blocks(spark):
    assert values(spark, X.sidebar_block, [t for t, _ in BLOCKS]) == [v for _, v in BLOCKS]


CUTS = [
    ("본문\nCompliance Notice\nx", "본문"), ("Compliance Notice\n본문", "Compliance Notice\n본문"), ("Compliance Notice a Compliance Notice b", "Compliance Notice a Compliance Notice b"),
    ("a 금융투자업규정 b Compliance Notice", "a"), ("x  　\n", "x"), ("", ""),
]


def test_section_cut(spark):
    assert values(spark, X.cut_section, [t for t, _ in CUTS]) == [v for _, v in CUTS]


#: What decides about a line, the first that holds: its name, and whether the line is noise then.
VERDICTS = (("blank", False), ("fixed", True), ("row label", True), ("Korean", False), ("short", True), ("numeric", True), ("else", False))


def plain_noise(line):
    """Which conditions hold of a Python string; the table has the verdict of the first."""
    s, n, tokens = line.strip(), len(re.findall("[가-힣]", line)), line.split()
    numbers = [t for t in tokens if any(re.match(p, t) for p in R.NUMERIC)]
    holds = {
        "blank": s == "", "Korean": n > 12, "short": len(s) in range(20) and n < 7, "numeric": 2 * len(numbers) >= len(tokens), "else": True,
        "fixed": s in R.LABELS or any(s.find(p) >= 0 for p in R.DISCLAIMERS) or any(re.match(p, s, re.I) for p in R.CAPTIONS),
        "row label": any(re.search(p, s) for p in R.ROW_LABELS) and len(s) <= 34 and n <= 13,
    }
    return next(noise for name, noise in VERDICTS if holds[name])


PIECES = st.sampled_from(["가나", "매출채권", "PER", "1,200", "3Q24", " ", "\t", "text", "자료:", "Source :", "표 1.", "　", " ", "é", "-", "NA", "2024.1", "기준일:", "LONGWORDHERE", "다라마바"])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=20, max_size=60))
def test_noise_line_is_its_plain_statement(spark, lines):
    assert values(spark, X.noise_line, lines) == [plain_noise(t) for t in lines]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=" \n\t　abC가", max_size=30), min_size=10, max_size=30))
def test_strip_and_idempotence(spark, texts):
    assert values(spark, X.strip, texts) == [t.strip() for t in texts]
    once = values(spark, X.cut_section, texts)
    assert values(spark, X.cut_section, once) == once
    cleaned = values(spark, X.clean_document, texts)
    assert values(spark, X.clean_document, cleaned) == cleaned


def test_names_and_dates(spark):
    assert values(spark, X.sanitize, [' a/b:c*?"<>|\\ ']) == ["abc"]
    assert values(spark, X.shorten, ["x" * 50, "x" * 51]) == ["x" * 50, "x" * 50 + "..."]
    assert [str(d) for d in values(spark, X.short_year_date, ["24.02.21", "69.1.2", "24.02.30", None])] == ["2024-02-21", "1969-01-02", "None", "None"]


@pytest.mark.parametrize("sql,want", [("```sql\nSELECT 1\n```", "SELECT 1"), ("SELECT 1", "SELECT 1")])
def test_fences(spark, sql, want):
    assert values(spark, X.without_fences, [sql]) == [want]
