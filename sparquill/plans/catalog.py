"""Importing this module registers every query."""

from __future__ import annotations

from sparquill.plans import corpus, q_aggregates, q_audits, q_extras, q_io, q_joins, q_metrics, q_records, q_segments, q_text, q_tokens
from sparquill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus", "q_aggregates", "q_audits", "q_extras", "q_io", "q_joins", "q_metrics", "q_segments", "q_text", "q_tokens"]
