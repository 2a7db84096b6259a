"""Ordered clean-up rules for recognised text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import regex

# Replacements for characters and words that recognition gets wrong.
LOOKALIKES = {"㆞": "地", "㆗": "中", "㆟": "人", "㆒": "一"}
#: Full-width digits, capitals and these signs become their half-width forms, which stand 0xFEE0 lower.
FULL_WIDTH = {chr(ord(c) + 0xFEE0): c for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ:,!?()/-_"} | {"。": ".", "「": '"', "」": '"'}
# Words of land registry transcripts.
TRANSCRIPT_WORDS = {
    "十地": "土地", "十": "土", "膽本": "謄本", "膽": "謄", "攝記": "登記", "攝": "登", "徐生": "謄本", "徐": "謄", "香驗": "查驗", "列6印": "列印", "本樁本": "本謄本",
    "上地": "土地", "所有傑": "所有權", "蛋記": "登記", "藍記": "登記", "華物": "建物", "建新": "建物", "記原因日": "登記原因:", "度智": "地址", "宇帶": "字號",
    "地政事務所主": "地政事務所", "建成地政": "建成地政事務所",
    "民國在": "民國", "民購": "民國", "年英國": "年", "年北月": "年", "時北月": "時", "月的時": "月", "的月": "月", "華在": "登記",
    "凈": "0", "ooooo": "00000", "OOOO": "0000",
    "。。。": "...", "***": "", "**": "",
    "ot": "", "E\n": "\n",
}
# Field names that recognition gets wrong.
FIELD_NAMES = {"所有傑": "所有權", "所有樺": "所有權", "權利範園": "權利範圍", "權利範闕": "權利範圍", "使用分園": "使用分區", "使用㆞類別": "使用地類別"}
# Section titles, wrong forms and right ones.
SECTION_TITLES = {"土㆞標示部": "土地標示部", "土㆞所有權部": "土地所有權部", "建物標不部": "建物標示部", "建物標元音": "建物標示部", "建物所有傑部": "建物所有權部", "建物他預耀利部": "建物他項權利部"}
SECTIONS = ("土地標示部", "土地所有權部", "建物標示部", "建物所有權部", "建物他項權利部")
# Words that a complete transcript has.
KEYWORDS = ("土地", "建物", "謄本", "登記", "地號", "面積", "所有權", "統一編號", "地政事務所", "民國", "權利範圍", "使用分區", "使用地類別")

# Formats, with the replacement as Java writes it.
LAND_NUMBER = (r"地號[\s:：]*(\d{4})\s*[-\-]\s*(\d{4,8})", "地號: $1-$2")
UNIFIED_ID = (r"統一編號[\s:：]*([A-Z0-9\*]{8,10})", "統一編號: $1")
ROC_DATE = r"民國\s*(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
ROC_DATE_STEPS = ((ROC_DATE, "民國$1年0$2月0$3日"), (r"民國(\d{2,3})年0?(\d{2})月0?(\d{2})日", "民國$1年$2月$3日"))
AREA = (r"(\d+\.?\d*)\s*平方公[米尺]", "$1平方公尺")
WATERMARKS = (r"已列印\s*已列印", r"本謄本列印完畢\s*本謄本列印完畢", r"(\*{3,})")
RULE_LINE = "=" * 40


@dataclass(frozen=True)
class TypoRules:
    """Replacements by falling length of what is replaced, in given order among equals; those of one character go last, all at once."""

    words: tuple[tuple[str, str], ...]
    single_from: str
    single_to: str

    @classmethod
    def of(cls, *tables: dict[str, str]) -> TypoRules:
        rules = {k: v for t in tables for k, v in t.items()}
        words = sorted(((k, v) for k, v in rules.items() if len(k) > 1), key=lambda kv: -len(kv[0]))
        single = [(k, v) for k, v in rules.items() if len(k) == 1]
        keys = {k for k, _ in single}
        if any(len(v) != 1 or v in keys for _, v in single):
            raise ValueError("rules of one character must give one character that no such rule replaces")
        return cls(tuple(words), "".join(k for k, _ in single), "".join(v for _, v in single))

    def __len__(self) -> int:
        return len(self.words) + len(self.single_from)


TYPOS = TypoRules.of(LOOKALIKES, FULL_WIDTH, TRANSCRIPT_WORDS)


def fix_typos(df: DataFrame, text: str, out: str = "fixed", fixes: str = "typo_fixes", rules: TypoRules = TYPOS) -> DataFrame:
    """Add the text after all rules, each on the result of those before, and how often they applied.

    A projection for each rule keeps every intermediate text computed once.
    """
    df = df.withColumns({out: F.col(text), fixes: F.lit(0).cast("long")})
    for wrong, right in rules.words:
        df = df.withColumns({fixes: F.col(fixes) + regex.occurrences(F.col(out), wrong), out: F.replace(F.col(out), F.lit(wrong), F.lit(right))})
    single = F.length(out) - F.length(F.translate(out, rules.single_from, ""))
    return df.withColumns({fixes: F.col(fixes) + single, out: F.translate(out, rules.single_from, rules.single_to)})


def fix_typos_text(text: Column, rules: TypoRules = TYPOS) -> Column:
    for wrong, right in rules.words:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.translate(text, rules.single_from, rules.single_to)


def land_number(text: Column) -> Column:
    return regex.replace_all(text, *LAND_NUMBER)


def unified_id(text: Column) -> Column:
    return regex.replace_all(text, *UNIFIED_ID)


def roc_date(text: Column) -> Column:
    for step in ROC_DATE_STEPS:
        text = regex.replace_all(text, *step)
    return text


def area(text: Column) -> Column:
    return regex.replace_all(text, *AREA)


def field_names(text: Column) -> Column:
    for wrong, right in FIELD_NAMES.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def fix_formats(df: DataFrame, text: str, out: str = "formatted", corrections: str = "format_corrections") -> DataFrame:
    """Add the text with known formats, and how many corrections count: each land number and date, and each wrong field name once."""
    t = F.col(text)
    df = df.withColumns({out: unified_id(land_number(t)), corrections: regex.count(t, LAND_NUMBER[0])})
    df = df.withColumns({corrections: F.col(corrections) + regex.count(F.col(out), ROC_DATE), out: area(roc_date(F.col(out)))})
    for wrong, right in FIELD_NAMES.items():
        df = df.withColumns({corrections: F.col(corrections) + F.contains(F.col(out), F.lit(wrong)).cast("long"), out: F.replace(F.col(out), F.lit(wrong), F.lit(right))})
    return df


def drop_watermarks(text: Column) -> Column:
    for pattern in WATERMARKS:
        text = regex.replace_all(text, pattern, "")
    return text


def restore_sections(text: Column) -> Column:
    for wrong, right in SECTION_TITLES.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    for title in SECTIONS:
        text = F.replace(text, F.lit(title), F.lit(f"\n{RULE_LINE}\n{title}\n{RULE_LINE}\n"))
    return text


def clean_whitespace(text: Column) -> Column:
    """Blanks at line ends go; more than one empty line in a row becomes one."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), r"\n{3,}", "\n\n")


def completeness(text: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Struct of keyword_count, total_keywords, has_keywords (60 percent or more), missing_keywords and confidence."""
    all_ = F.array(*map(F.lit, keywords))
    found = F.filter(all_, lambda k: F.contains(text, k))
    n = F.size(found).cast("long")
    return F.struct(n.alias("keyword_count"), F.lit(len(keywords)).cast("long").alias("total_keywords"), (n >= len(keywords) * 0.6).alias("has_keywords"), F.array_except(all_, found).alias("missing_keywords"), (n / len(keywords)).alias("confidence"))


def replace_first(text: Column, original: Column, corrected: Column) -> Column:
    """The first occurrence of original becomes corrected; nothing changes if they are equal, or original is empty, null or absent."""
    at = F.instr(text, original)
    fits = (original != corrected) & (F.length(original) > 0) & (at > 0)
    return F.when(fits, F.concat(F.substring(text, F.lit(1), at - 1), corrected, F.substring(text, at + F.length(original), F.length(text)))).otherwise(text)


def gregorian(year: Column, month: Column, day: Column) -> Column:
    """The date of a year counted from 1912; null if there is none."""
    return F.try_make_timestamp(year + 1911, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date") if hasattr(F, "try_make_timestamp") else F.make_date(year + 1911, month, day)


def postprocess(df: DataFrame, text: str = "text") -> DataFrame:
    """Typo rules, formats and whitespace, in this order; adds cleaned and stats. A null or empty text stays as it is."""
    df = fix_formats(fix_typos(df, text), "fixed")
    stats = F.struct("typo_fixes", "format_corrections", F.length(text).cast("long").alias("total_chars_before"), F.length("cleaned").cast("long").alias("total_chars_after"), F.lit(False).alias("llm_used"), F.lit(0.0).alias("llm_cost"))
    return df.withColumn("cleaned", clean_whitespace(F.col("formatted"))).withColumn("stats", stats).drop("fixed", "formatted", "typo_fixes", "format_corrections")
