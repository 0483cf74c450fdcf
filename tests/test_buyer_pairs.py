"""A buyer with many cases and many suppliers: its pairs are made after the last exchange, and all of them."""

from datetime import date, timedelta

import pytest
from test_pools import rows_moved

from bidloom.operators import casefit as N
from bidloom.plans import casefit
from bidloom.plans.book import Tables

COLUMNS = ("id_notice_can", "id_award", "win_name", "win_country_code", "win_nationalid", "win_town", "cpv", "additional_cpvs", "tal_location_nuts", "dt_dispatch", "iso_country_code", "cae_nationalid", "cae_name", *N.REGIME, "crit_code", "crit_price_weight")
CASES, SUPPLIERS = 60, 300


def award(k: str, supplier: int, category: str, day: date, buyer: str | None = "B12345") -> dict:
    country = None if buyer is None else "PL"
    return dict.fromkeys(COLUMNS) | {"id_notice_can": k, "id_award": "1", "win_name": f"s {supplier}", "win_country_code": "PL", "win_nationalid": f"S{supplier:05}", "cpv": f"{category}000000", "dt_dispatch": f"{day:%Y-%m-%d}", "iso_country_code": country, "cae_nationalid": buyer, "cae_name": buyer}


@pytest.fixture(scope="module")
def large_buyer(spark, tmp_path_factory):
    """Every supplier worked for the buyer in 33, the odd ones for an unknown buyer in 45 as well, every third for another buyer."""
    old, new = date(2016, 1, 1), date(2017, 7, 1)
    rows = [award(f"a{i}", i, "33", old + timedelta(i % 50)) for i in range(SUPPLIERS)]
    rows += [award(f"b{i}", i, "45", old, None) for i in range(1, SUPPLIERS, 2)] + [award(f"c{i}", i, "33", old, "OTHER1") for i in range(0, SUPPLIERS, 3)]
    rows += [award(f"{x}{i}", i, x, new + timedelta(i % 9)) for x in ("33", "45", "77") for i in range(CASES)] + [award("z", 1, "33", new, "NOBODY"), award("y", 1, "33", new, None)]
    path = tmp_path_factory.mktemp("large")
    spark.createDataFrame([tuple(r[x] for x in COLUMNS) for r in rows], ", ".join(f"{x} string" for x in COLUMNS)).write.parquet(f"{path}/can_2017.parquet")
    return str(path)


def expected() -> set[tuple]:
    return {
        (f"{x}{k}||1", f"nid_country||PL||S{i:05}", 0.693147181, round(1 / (1 + (date(2017, 7, 1) + timedelta(k % 9) - date(2016, 1, 1) - timedelta(i % 50)).days), 9), 0.5 if i % 3 == 0 else 1.0)
        for x, step in (("33", 1), ("45", 2)) for k in range(CASES) for i in range(step - 1, SUPPLIERS, step)
    }


def test_pairs_are_not_sent(spark, large_buyer):
    before, key = set(rows_moved(spark)), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        rows = casefit.rnk_09_buyer_features(Tables(spark, large_buyer)).collect()
    finally:
        spark.conf.unset(key)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(rows) == len(expected()) == CASES * SUPPLIERS * 3 // 2
    assert max(n for k, n in rows_moved(spark).items() if k not in before) < 2_000


@pytest.mark.parametrize("piece", [7, 1000])
def test_every_pair_once(spark, large_buyer, monkeypatch, piece):
    monkeypatch.setattr(casefit, "PIECE", piece)
    rows = [tuple(r) for r in casefit.rnk_09_buyer_features(Tables(spark, large_buyer)).collect()]
    assert len(rows) == len(expected()) and set(rows) == expected()
