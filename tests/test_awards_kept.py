"""The awards that queries over pools write: what the models don't need is neither read nor kept."""

import re

from bidloom.operators import casefit as N
from bidloom.plans import casefit
from bidloom.plans.book import Tables

SMALL = "/root/testdata/sf0.01"
SINGLE = {f"ONLY_{g}": {g: 1.0} for g in N.GROUPS}


def awards_kept(spark, monkeypatch, models):
    """The awards that a query over these models writes."""
    kept = []
    monkeypatch.setattr(casefit, "cut", lambda df: kept.append(df) or df)
    casefit.winner_records(Tables(spark, SMALL), models)
    return kept[0]._jdf.queryExecution()


def test_columns_of_other_groups_are_not_read(spark, monkeypatch):
    def read(models) -> str:
        return re.search(r"FileScan parquet \[([^\]]*)\]", awards_kept(spark, monkeypatch, models).executedPlan().toString())[1]

    few, every = read(N.SCENARIOS), read(SINGLE)
    assert "cae_name" in few and "crit_price_weight" not in few and "b_gpa" not in few
    assert "crit_price_weight" in every and "b_gpa" in every


def test_awards_are_sorted_once(spark, monkeypatch):
    plan = awards_kept(spark, monkeypatch, SINGLE).executedPlan().toString()
    assert plan.count("Sort [") == 1
