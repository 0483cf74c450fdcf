"""Ranks over pools are those of the scores, without the scores of all models."""

import numpy as np
import pyarrow as pa

from bidloom.operators import casefit as N
from bidloom.operators import pools

SINGLE = {f"ONLY_{g}": {g: 1.0} for g in N.GROUPS}
NESTED = {m: N.equal_weights(g) for m, g in N.MODELS.items()}


def pool(n: int = 300) -> pools.Pool:
    r = np.random.default_rng(5)
    some = lambda most, k: [sorted({int(x) for x in r.integers(0, most, r.integers(0, k))}) for _ in range(n)]
    tokens, buyers = some(12, 5), some(6, 3)
    tokens[0] = [0]
    ones = lambda lists: [[int(x) for x in r.integers(1, 4, len(v))] for v in lists]
    small = lambda: r.integers(1, 4, n)
    columns = {"at": np.arange(n), "n": small(), "nb": small(), "all_n": small() + 3, "last": r.integers(90, 100, n), "h_pw": r.integers(0, 4, n) * 25.0, "t_key": tokens, "t_n": ones(tokens), "b_key": buyers, "b_n": ones(buyers), "b_last": [[int(x) for x in r.integers(90, 100, len(v))] for v in buyers]}
    return pools.Pool(pa.table(columns | {f"{x}_{k}": small() for x in N.REGIME for k in (0, 1)}))


def cases(count: int = 40) -> list[dict]:
    r = np.random.default_rng(6)
    out = []
    for k in range(count):
        sets = {f: sorted({int(x) for x in r.integers(0, 14, r.integers(0, 4))}) for f, _, _ in N.LEVELS}
        one = {"d": int(r.integers(100, 103)), "country": int(r.integers(0, 12)), "crit": [None, 3][k % 2], "pw": [None, 50.0][k % 2], "b": [None, 0, 1, 99][k % 4], **{x: [None, 0, 1][(k + i) % 3] for i, x in enumerate(N.REGIME)}}
        out.append(sets | one | {"case_id": [f"{k}a", f"{k}b", f"{k}c"], "win": [int(x) for x in r.integers(0, 300, 3)]})
    return out


def by_scores(scorer: pools.Scorer, case: dict) -> list[tuple]:
    x = scorer.scores(case)
    return [(c, scorer.pool.n, [1 + int((row > row[s]).sum()) for row in x], [int((row == row[s]).sum()) for row in x]) for c, s in zip(case["case_id"], case["win"])]


def test_ranks_are_those_of_the_scores():
    for models in (SINGLE, NESTED, N.SCENARIOS, {m: N.equal_weights(g) for m, g in N.ABLATIONS.items()}):
        scorer = pools.Scorer(pool(), models)
        for case in cases():
            assert scorer.ranks(case) == by_scores(scorer, case)


def test_single_groups_need_no_weighing(monkeypatch):
    """Their scores are kept once for all cases that share the group's part of a signature."""
    made = []
    own = pools.Pool._group
    monkeypatch.setattr(pools.Pool, "_group", lambda self, name, case: made.append(name) or own(self, name, case))
    monkeypatch.setattr(pools.Scorer, "distances", None)
    scorer = pools.Scorer(pool(), SINGLE)
    for case in cases():
        scorer.ranks(case)
    assert made.count("activity") == 3 and "buyer" not in made


def test_buyers_have_no_row_for_each_supplier(monkeypatch):
    made = []
    own = pools.Pool._group
    monkeypatch.setattr(pools.Pool, "_group", lambda self, name, case: made.append(name) or own(self, name, case))
    scorer = pools.Scorer(pool(), NESTED)
    for case in cases():
        scorer.ranks(case)
    assert made and "buyer" not in made
