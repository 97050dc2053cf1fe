"""Ordered rules that turn a text column into a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_all(text: Column, parts: Sequence[str]) -> Column:
    """True where the text contains every part; null or false otherwise."""
    out = F.lit(True)
    for part in parts:
        out = out & text.contains(part)
    return out


def first_rule(cases: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """Value of the first case whose condition holds; conditions that are null do not."""
    out = F
    for condition, value in cases:
        out = out.when(condition, F.lit(value) if isinstance(value, str) else value)
    return out.otherwise(F.lit(otherwise) if otherwise is None or isinstance(otherwise, str) else otherwise)


def piece(text: Column, pattern: str) -> Column:
    """First group of the pattern in the text, '' without a match."""
    return F.regexp_extract(text, pattern, 1)
