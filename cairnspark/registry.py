"""Queries of the engine and their SQL twins."""

from __future__ import annotations

from .plans import audits, base, inference, relational, scoring, statistics  # noqa: F401  (queries register themselves)

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
FLAGSHIP = "flagship_index"
