import pytest

from bidloom.plans import ranking_more


def test_rounds_of_the_survey(monkeypatch):
    """ml_05 fits as many rounds as SURVEY ML-05 and the reference have, of trees of about 31 leaves."""
    asked = {}

    class Fitted(Exception):
        pass

    def fit(rows, features, rounds=30, step=0.05, depth=4):
        asked.update(rounds=rounds, step=step, depth=depth)
        raise Fitted

    monkeypatch.setattr(ranking_more, "_split", lambda t: (None, None))
    monkeypatch.setattr(ranking_more, "cut", lambda df: df)
    monkeypatch.setattr(ranking_more.M, "fit_boosted", fit)
    with pytest.raises(Fitted):
        ranking_more.QUERIES["ml_05_boosted"](None, "")
    assert asked == {"rounds": 180, "step": 0.05, "depth": 5}
