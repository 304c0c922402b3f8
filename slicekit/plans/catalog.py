"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from . import chains, compare_reports, mt_reports, pipeline, prep_queries, qa_reports, stage_queries, state_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
