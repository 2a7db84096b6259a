"""Regular expressions with the same meaning on every row: Unicode classes, `.` stops at \\n only, `^` and `$` at lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?mdU)"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def replace_all(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, FLAGS + pattern, by)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(FLAGS + pattern)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first(text: Column, pattern: str, groups: int = 1) -> Column:
    """The first match's group, stripped; several groups are joined by a blank as they are; null without a match. groups 0: the whole match."""
    if groups > 1:
        got = F.concat_ws(" ", *[F.regexp_extract(text, FLAGS + pattern, i + 1) for i in range(groups)])
        return F.when(matches(text, pattern), got)
    # the match is looked for once: no match gives an empty string, and no pattern has a match or group that is empty
    raw = F.array(F.regexp_extract(text, FLAGS + pattern, groups))
    return F.get(F.transform(raw, lambda r: F.when(r != "", strip(r) if groups else r)), F.lit(0))


def occurrences(text: Column, part: str) -> Column:
    """How often part occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")
