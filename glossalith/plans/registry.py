"""All named queries of the engine."""

from __future__ import annotations

from . import corpus_queries, entry_queries, evidence_queries, form_queries, literal_queries, predicate_queries, quality_queries, table_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
