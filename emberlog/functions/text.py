"""Text and set functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities, lowest first.
SEVERITIES = ("informational", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    """0 for the lowest and for what is no severity."""
    return F.greatest(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1, F.lit(0))


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def merge_severity(a: Column, b: Column) -> Column:
    """The higher of two severities; the first where they are level."""
    return F.when(severity_rank(a) >= severity_rank(b), a).otherwise(b)


def has_token(text: Column, token: str) -> Column:
    """Whether ``token`` stands in ``text`` with no letter, digit, ``_``, ``.`` or ``-`` beside it."""
    return text.contains(token) & text.rlike(rf"(?<![a-z0-9_.-]){re.escape(token)}(?![a-z0-9_.-])")


def sorted_set(*arrays: Column) -> Column:
    """The distinct values of arrays in order; null arrays are empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*(F.coalesce(a, empty) for a in arrays)))))


def joined(array: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(array), sep)


def slug(name: Column, length: int = 36) -> Column:
    return F.substring(F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_.-]+", "-"), F.lit("-._")), F.lit("")), F.lit("collection")), 1, length)


def digest(*columns: Column) -> Column:
    """SHA-256 of columns with a separator between them; null is empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def ipv4(number: Column) -> Column:
    n = number.cast("long")
    return F.concat_ws(".", *(F.shiftrightunsigned(n, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)))
