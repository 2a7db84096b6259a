"""Kinds of documents by keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by kind, kinds in order of precedence on ties.
KINDS = {
    "transcript": ("謄本", "地政", "建物標示部", "土地標示部", "所有權部"),
    "lease": ("租賃契約", "租約", "承租人", "出租人", "租金"),
    "id_card": ("身分證", "國民身分證", "統一編號", "出生地"),
}
# Features of an identity card; two make one.
ID_CARD_FEATURES = (r"[A-Z][12]\d{8}", r"國民身分證|身分證", r"出生|生日", r"性別|[男女]", r"發證|換發|補發", r"統一編號")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur; case counts."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def kind(text: Column) -> Column:
    """The kind with most keywords, the first one on ties; unknown without any, and for a null or blank text."""
    n = {k: hits(text, words) for k, words in KINDS.items()}
    most = F.greatest(*n.values())
    best = reduce(lambda rest, k: F.when(n[k] == most, F.lit(k)).otherwise(rest), reversed(list(n)), F.lit("unknown"))
    return F.when((F.length(F.trim(F.coalesce(text, F.lit("")))) > 0) & (most > 0), best).otherwise("unknown")


def is_transcript(text: Column) -> Column:
    return F.coalesce(hits(text, KINDS["transcript"]) > 0, F.lit(False))


def id_card_features(text: Column) -> Column:
    return sum((text.rlike(p).cast("int") for p in ID_CARD_FEATURES), F.lit(0))
