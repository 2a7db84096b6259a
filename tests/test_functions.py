import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions import classify, extract, rules
from foliant.functions import patterns as P


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).first()


@pytest.mark.parametrize(
    "text, fixed, n",
    [("", "", 0), ("建成地政事務所", "建成地政事務所事務所", 1), ("Total Amount", "Tal Amount", 1), ("****", "*", 1), ("十地", "土地", 1), ("Ａ１：", "A1:", 3), ("OOOO", "0000", 1), ("所有傑十", "所有權土", 2), (None, None, None)],
)
def test_typos(spark, text, fixed, n):
    r = rules.fix_typos(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert (r.fixed, r.typo_fixes) == (fixed, n)
    assert one(spark, text, rules.fix_typos_text(F.col("text")))[0] == fixed


def test_rule_count():
    assert len(rules.TYPOS) == 90 and len(rules.KEYWORDS) == 13


def test_formats_follow_order(spark):
    text = "地號： 0221 - 0000 統一編號  C1******** 民國 108 年 4 月 9 日 120.5 平方公米 所有樺 所有樺"
    r = rules.fix_formats(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert r.formatted == "地號: 0221-0000 統一編號: C1******** 民國108年04月09日 120.5平方公尺 所有權 所有權"
    assert r.format_corrections == 3


@pytest.mark.parametrize("text, clean", [("a 　\t\nb\r\n\n\n\nc", "a\nb\n\nc"), ("", ""), ("  a", "  a"), (None, None)])
def test_whitespace(spark, text, clean):
    assert one(spark, text, rules.clean_whitespace(F.col("text")))[0] == clean


def test_replace_first(spark):
    f = lambda t, a, b: one(spark, t, rules.replace_first(F.col("text"), F.lit(a), F.lit(b)))[0]
    assert f("aXbX", "X", "yy") == "ayybX" and f("abc", "", "z") == "abc" and f("abc", "q", "z") == "abc" and f("a.b", ".", "") == "ab"


def test_gregorian(spark):
    assert one(spark, "", rules.gregorian(F.lit(115), F.lit(3), F.lit(26)))[0] == datetime.date(2026, 3, 26)


def test_catalogue():
    assert sum(map(len, P.PATTERNS.values())) == 76 and len(P.CRITICAL) == 10 and len(P.MINOR) == 15
    assert set(P.DESCRIPTIONS) == set(P.PATTERNS)


@pytest.mark.parametrize(
    "field, text, value",
    [
        ("contract_number", "合約編號：AB-1\n合約編號：CD-2", "AB-1"),
        ("signing_date", "中華民國 115 年 3 月 26 日", "115 3 26"),
        ("signing_date", "中華民國115年03月26日", "115 03 26"),
        ("party_a", "甲方：　大公司　（代表人）", "大公司"),
        ("contract_amount", "Total Amount: TWD 2,500,000", "2,500,000"),
        ("deposit", "押金：相當於 2 個月租金", "2"),
        ("landlord_name", "租賃人：某人", "某人"),
        ("party_b", "nothing", None),
        ("monthly_rent", "月租金：NTD １２ 元", "１２"),
    ],
)
def test_fields(spark, field, text, value):
    assert one(spark, text, extract.field(F.col("text"), field))[0] == value


def test_confidence_and_result(spark):
    text = "合約編號：A-1\n甲方：甲\n乙方：乙\n合約金額：新台幣 1,000 元\n幣別：TWD"
    r = extract.fields(spark.createDataFrame([(text,)], "text string")).select(extract.result().alias("r")).first().r
    assert r.extraction_confidence == pytest.approx(0.7 * 4 / 10 + 0.3 * 1 / 15, abs=1e-4)
    assert r.rental_terms is None and r.financial_terms.currency == "TWD" and r.llm_used_for_extraction is False


@pytest.mark.parametrize("own, other, value", [("a", "b", "b"), ("a", "", "a"), ("a", None, "a"), (None, "b", "b"), (None, "", None)])
def test_merge(spark, own, other, value):
    df = spark.createDataFrame([(own, other)], "own string, other string")
    assert df.select(extract.merge(F.col("own"), F.col("other"))).first()[0] == value


@pytest.mark.parametrize("text, kind", [("謄本 租金", "transcript"), ("租金 承租人 謄本", "lease"), ("統一編號", "id_card"), ("", "unknown"), (None, "unknown"), ("x", "unknown")])
def test_kind(spark, text, kind):
    r = one(spark, text, classify.kind(F.col("text")), classify.is_transcript(F.col("text")))
    assert r[0] == kind and r[1] == ("謄本" in (text or ""))


@pytest.mark.parametrize("pattern, words", [("ab+c", ("ab",)), ("ab|c", ()), ("a?b", ()), ("(?:ab|c)d", ("ab", "c")), ("(?:ab|c)?d", ()), ("(ab)", ()), (r"\\d", ()), ("(?:a.|b)x", ())])
def test_needed_words(pattern, words):
    assert P.needed_words(pattern) == words
