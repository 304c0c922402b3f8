"""Null-safe tag predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_tag(phenomena: Column | str, tag: str | Column) -> Column:
    """Membership that is False (not null) for a missing list."""
    t = F.lit(tag) if isinstance(tag, str) else tag
    return F.coalesce(F.array_contains(_c(phenomena), t), F.lit(False))


def qa_phenomena(tags: Column | str = "tags") -> Column:
    """QA default: a missing tag record or list reads as the empty list."""
    return F.coalesce(_c(tags).getField("linguistic_phenomena"), F.array().cast("array<string>"))


def mt_phenomena(tags: Column | str = "tags") -> Column:
    """MT default: missing or empty list reads as ``["none"]``."""
    p = _c(tags).getField("linguistic_phenomena")
    return F.when(F.coalesce(F.size(p), F.lit(0)) <= 0, F.array(F.lit("none"))).otherwise(p)


def tag_list_string(phenomena: Column | str, sep: str = ",") -> Column:
    """Arrays are awkward to compare across engines: join them to text."""
    return F.array_join(_c(phenomena), sep)
