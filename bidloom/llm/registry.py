"""The queries of this subpackage, by name."""

from __future__ import annotations

from bidloom.llm import queries

QUERIES = queries.QUERIES
ORACLE = queries.ORACLE
