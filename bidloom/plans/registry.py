"""All queries of the core, by name."""

from __future__ import annotations

from bidloom.plans import casefit, cleaning, data_problems, entities, notices, ranking, ranking_more, relational, storage

MODULES = (data_problems, cleaning, relational, ranking, ranking_more, casefit, entities, notices, storage)
FLAGSHIP = ranking.QUERIES["rnk_02_frequency"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
