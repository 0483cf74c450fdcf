"""The case queries over the notices make no row for each pair of a case and a supplier."""

import pytest

import __spark_entry__ as entry
from bidloom.operators import pools

SMALL = "/root/testdata/sf0.01"
#: That table has 265,531 pairs of a signature and a supplier of its context, from 5,235 awards.
MOST = 100_000


def rows_moved(spark) -> dict[int, int]:
    """Rows that each stage so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}


def moved_by(spark, name: str) -> tuple[int, list]:
    before = set(rows_moved(spark))
    rows = entry.queries()[name](spark, SMALL).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(n for k, n in rows_moved(spark).items() if k not in before), rows


@pytest.mark.parametrize("name", ["evl_01_nested_summary", "evl_11_ablations", "rnk_14_scenario_summary", "rnk_14_single_groups", "rnk_16_nested_ranks", "ml_06_full_pools", "rnk_09_buyer_features", "rnk_10_regime_share", "rnk_07_winner_features", "rnk_07_case_matrix", "ml_03_projection", "evl_12_checks", "rnk_12_masked_distances", "evl_09_scenario_stability", "evl_10_focus_response"])
def test_no_row_for_a_pair(spark, name):
    most, rows = moved_by(spark, name)
    assert rows and most < MOST


def test_suppliers_are_copied_for_the_cores_only(spark, monkeypatch):
    """Large contexts are split, so their suppliers are sent several times: only as far as that keeps cores busy."""
    monkeypatch.setattr(pools, "PAIRS", 1)
    sizes = {"A": 12, "B": 4, "C": 4, "D": 4, "E": 4}
    history = spark.createDataFrame([(c, f"{c}{i}") for c, n in sizes.items() for i in range(n)], "c2 string, s string")
    targets = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "c2 string")
    parts = {r["c2"]: r["_k"] for r in pools.parted(history, targets).collect()}
    assert parts == {"A": 3, "B": 1, "C": 1, "D": 1, "E": 1}
