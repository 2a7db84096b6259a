"""From pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_text(model_used: Column, model_text: Column, rule_text: Column, raw_text: Column) -> Column:
    """The model's text if it was used, else the rules' text unless empty, else the raw one."""
    return F.when(F.coalesce(model_used, F.lit(False)), model_text).otherwise(F.coalesce(F.nullif(rule_text, F.lit("")), raw_text))


def joined(text: Column, page: Column, separator: str = "\n") -> Column:
    """Aggregate: texts in page order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page.alias("p"), text.alias("t")))), lambda x: x["t"]), separator)


def with_headers(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text): pages under a line with number and total, an empty line between pages."""
    total = df.groupBy(doc).agg(F.count("*").alias("__n"))
    head = F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit("/"), F.col("__n").cast("string"), F.lit(" ---\n"), F.col(text))
    return df.join(total, doc).groupBy(doc).agg(joined(head, F.col(page), "\n\n").alias("text"))


def merged_groups(df: DataFrame, doc: str, page: str, groups: list[str]) -> DataFrame:
    """For each group of fields the value of the last page that has one."""
    return df.groupBy(doc).agg(*[F.max_by(g, F.when(F.col(g).isNotNull(), F.col(page))).alias(g) for g in groups])


def totals(df: DataFrame, doc: str) -> DataFrame:
    """Pages, pages on which a model was used, and cost, whole and rounded to 4 places. df: doc, llm_used, llm_cost."""
    cost = F.sum(F.coalesce("llm_cost", F.lit(0.0)))
    return df.groupBy(doc).agg(F.count("*").alias("total_pages"), F.count_if("llm_used").alias("llm_pages_used"), cost.alias("llm_cost"), F.round(cost, 4).alias("estimated_cost"))


def display_totals(df: DataFrame, doc: str) -> DataFrame:
    """Fixes, corrections and cost, and pages on which a model corrected or extracted. df: doc, typo_fixes, format_corrections, llm_cost, llm_used, llm_extracted."""
    return df.groupBy(doc).agg(F.sum("typo_fixes").alias("typo_fixes"), F.sum("format_corrections").alias("format_corrections"), F.round(F.sum(F.coalesce("llm_cost", F.lit(0.0))), 4).alias("cost"), F.count_if(F.coalesce("llm_used", F.lit(False)) | F.coalesce("llm_extracted", F.lit(False))).alias("llm_pages"))


def placeholder(error: Column, text: Column, confidence: Column) -> list[Column]:
    """text and confidence of a page; a failed page keeps its row, with an empty text and confidence 0."""
    return [F.when(error.isNotNull(), "").otherwise(text).alias("text"), F.when(error.isNotNull(), 0.0).otherwise(confidence).alias("confidence"), error.alias("error")]


def response(df: DataFrame, image: str = "original_image") -> DataFrame:
    """Pages as they are given out: without the picture, which then isn't read either."""
    return df.drop(image)
