"""Fields of contracts and transcripts, their confidence, and how other sources of values are merged in."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import patterns as P
from foliant.functions import regex


def _guarded(text: Column, pattern: str) -> Column:
    """The first match, looked for only in texts with the words that the pattern begins with: a plain search costs far less."""
    value, words = regex.first(text, pattern, P.group_count(pattern)), P.needed_words(pattern)
    if not words:
        return value
    return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), value)


def field(text: Column, name: str) -> Column:
    """The value by the first pattern that matches; null if none does."""
    return F.coalesce(*[_guarded(text, p) for p in P.PATTERNS[name]])


def fields(df: DataFrame, text: str = "text", names: Iterable[str] = tuple(P.PATTERNS)) -> DataFrame:
    return df.withColumns({n: field(F.col(text), n) for n in names})


def present(names: Iterable[str]) -> Column:
    return sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))


def confidence() -> Column:
    """0.7 for the share of critical fields found and 0.3 for the share of others, rounded to 4 places."""
    return F.round(0.7 * present(P.CRITICAL) / len(P.CRITICAL) + 0.3 * present(P.MINOR) / len(P.MINOR), 4)


def result(llm_used: Column | None = None) -> Column:
    """The nested result; rental_terms is null if no rental field was found."""
    group = lambda names: F.struct(*names)
    return F.struct(
        group(P.METADATA).alias("contract_metadata"), group(P.PARTIES).alias("parties"), group(P.TERMS).alias("financial_terms"),
        confidence().alias("extraction_confidence"), F.coalesce(llm_used if llm_used is not None else F.lit(False), F.lit(False)).alias("llm_used_for_extraction"),
        F.when(F.coalesce(*P.RENTAL).isNotNull(), group(P.RENTAL)).alias("rental_terms"),
    )


def merge(own: Column, other: Column) -> Column:
    """The other value unless it is null or empty."""
    return F.coalesce(F.nullif(other, F.lit("")), own)


def needs_model(enabled: Column, has_image: Column, threshold: float = 0.7) -> Column:
    return (confidence() < threshold) & enabled & has_image


def describe(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in P.DESCRIPTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.lit(P.UNKNOWN_FIELD))


def candidate(text: Column, name: str) -> Column:
    return F.coalesce(*[regex.first(text, p, group) for p, group in P.CANDIDATES[name]])


def valid_land_number(proposed: Column, original: Column) -> Column:
    """The proposed number without blanks if it has the form of one, else the original."""
    bare = F.replace(regex.strip(proposed), F.lit(" "), F.lit(""))
    return F.when(regex.matches(bare, P.LAND_NUMBER_FORM), bare).otherwise(original)


def transcript_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """Extension: land number and area of a transcript, by the two patterns that are known."""
    return df.withColumns({"land_number": regex.first(F.col(text), P.TRANSCRIPT_LAND_NUMBER), "area": regex.first(F.col(text), P.TRANSCRIPT_AREA)})


def identity_kind(value: Column) -> Column:
    return F.when(value.rlike(f"^(?:{P.NATIONAL_ID})$"), "national_id").when(value.rlike(f"^(?:{P.COMPANY_ID})$"), "company_id").when(value.rlike(f"^(?:{P.MOBILE})$"), "mobile").when(value.rlike(f"^(?:{P.PHONE})$"), "phone")
