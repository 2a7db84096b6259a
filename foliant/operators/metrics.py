"""How close a text is to what it should be."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def third(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.floor(F.length(text) / 3).cast("int"))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio, with the heuristic for frequent characters; null if either is null. It is no edit distance, nor symmetric."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.LongType())
def matching(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(a, b)], dtype="Int64")


def page_accuracy(text: Column, truth: Column) -> Column:
    """Percent, to 2 places, over the first third of the text without blanks."""
    return F.round(ratio(bare(truth), bare(third(text))) * 100, 2)


def accuracy_detail(text: Column, truth: Column) -> Column:
    t, g = bare(text), bare(truth)
    share = ratio(g, t) * 100
    return F.struct(F.length(g).cast("long").alias("gt_chars"), F.length(t).cast("long").alias("ocr_chars"), matching(g, t).alias("matching_chars"), F.round(share, 2).alias("accuracy"), F.round(100 - share, 2).alias("error_rate"))


def keyword_matrix(text: Column, truth: Column, keywords: tuple[str, ...]) -> Column:
    """For each keyword whether truth and text have it, and whether they agree on having it."""
    one = lambda k: F.struct(k.alias("keyword"), F.contains(truth, k).alias("in_gt"), F.contains(text, k).alias("in_ocr"), (F.contains(truth, k) & F.contains(text, k)).alias("correct"))
    return F.transform(F.array(*map(F.lit, keywords)), one)


def accuracy_band(percent: Column) -> Column:
    return F.when(percent >= 95, "excellent").when(percent >= 85, "good").when(percent >= 70, "fair").otherwise("poor")


def estimated(keywords_found: Column, confidence: Column, keywords: int = 8) -> Column:
    return 0.6 * keywords_found / keywords + 0.4 * confidence


def change(new: Column, old: Column) -> Column:
    """Difference, and difference in percent of the old value (0 for an old value of 0)."""
    return F.struct((new - old).alias("diff"), F.coalesce(F.try_divide((new - old) * 100, old), F.lit(0.0)).alias("percent"))


def speed_up(sequential: Column, parallel: Column) -> Column:
    return F.coalesce(F.try_divide(sequential, parallel), F.lit(0.0))


def gain(chars: Column, best_single: Column) -> Column:
    """How many percent more characters than the best single engine's; 0 if that has none."""
    return F.coalesce(F.try_divide((chars - best_single) * 100, best_single), F.lit(0.0))
