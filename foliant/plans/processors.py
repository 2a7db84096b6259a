"""Processing of pages by kind of document: a registry of steps, each a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import extract, rules
from foliant.operators import models, pages

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Processor:
    """Steps over pages (doc_id, page_number, raw_text, confidence, error)."""

    postprocess: Step = lambda df: rules.postprocess(df, "raw_text")
    extract: Step = lambda df: df.withColumn("structured_data", F.lit(None).cast("string"))
    provider: models.Provider | None = None
    extra: tuple[Step, ...] = field(default=())

    def run(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({"raw_text": F.when(F.col("error").isNotNull(), "").otherwise(F.col("raw_text")), "confidence": F.when(F.col("error").isNotNull(), 0.0).otherwise(F.col("confidence"))})
        df = self.postprocess(df)
        if self.provider is None:
            df = df.withColumns({"used": F.lit(False), "corrected": F.col("cleaned")})
        else:
            gate = models.strategy(F.lit(True), F.lit("auto"), F.col("confidence")) == "full"
            df = models.correct(df.drop("error").withColumn("page_error", F.col("error")), self.provider, gate, "cleaned").drop("error").withColumnRenamed("page_error", "error")
        for step in (self.extract, *self.extra):
            df = df.transform(step)
        return df


def _contract(df: DataFrame) -> DataFrame:
    return extract.fields(df, "cleaned").withColumn("structured_data", extract.result()).drop(*extract.P.PATTERNS)


REGISTRY: dict[str, Processor] = {"transcript": Processor(), "contract": Processor(extract=_contract)}


def register(kind: str, processor: Processor) -> None:
    REGISTRY[kind] = processor


def get(kind: str) -> Processor:
    if kind not in REGISTRY:
        raise ValueError(f"no processor for {kind}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind]


def analyze(df: DataFrame, kind: str) -> DataFrame:
    return get(kind).run(df)


def document_context(pages_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a document: its text and totals."""
    text = pages.best_text(F.col("used"), F.col("corrected"), F.col("cleaned"), F.col("raw_text"))
    return pages_.groupBy(doc).agg(pages.joined(text, F.col("page_number")).alias("text"), F.count("*").cast("long").alias("total_pages"), F.count_if("used").alias("llm_pages_used"), F.sum("stats.typo_fixes").alias("typo_fixes"), F.sum("stats.format_corrections").alias("format_corrections"))


def answer_questions(context: DataFrame, question: Column, provider: models.Provider) -> DataFrame:
    prompt = models.context(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), question)
    return models.ask(context.withColumn("prompt", prompt), "prompt", provider).drop("prompt")
