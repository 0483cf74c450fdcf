"""The boosted ranker over whole pools."""

import numpy as np

from bidloom.operators import learning as M
from bidloom.plans import ranking_more
from test_learning import rows  # noqa: F401
from test_pools import MOST, moved_by


def test_trees_forget_no_row_that_is_asked(spark, rows):
    df = spark.createDataFrame(rows, ["a", "b", "a_known", "b_known", "label", "weight"])
    text = M.fit_boosted(df, ["a", "b", "a_known", "b_known"], rounds=3, depth=2).stages[1].toDebugString
    all_, few = M.Trees(text, 4), M.Trees(text, 4)
    few.KEPT = 5
    asked = np.array([[i, j, 0, k] for i in range(3) for j in range(3) for k in range(2)], dtype=np.int16)
    for a in range(0, 18, 3):
        assert few.margins(asked[a : a + 4]).tolist() == all_.margins(asked[a : a + 4]).tolist()


def test_boosted_makes_no_row_for_a_pair(spark, monkeypatch):
    """Fewer rounds: the pairs don't depend on them."""
    monkeypatch.setattr(ranking_more, "ROUNDS", 2)
    most, rows = moved_by(spark, "ml_05_boosted")
    assert rows and most < MOST
