import math
from datetime import date

from pyspark.sql import functions as F

from bidloom.operators import casefit as M
from bidloom.operators import features as X
from bidloom.operators import ranking as R

SCHEMA = "k string, s string, c2 string, d date, codes array<string>, regions array<string>, country string, b string, " + ", ".join(f"{x} boolean" for x in M.REGIME) + ", crit string, pw double, sig string"


def row(k, s, d, codes=("45000000",), regions=("DE21H",), country="DE", b="b1", flags=(True, None, None, None, None), crit="L", pw=40.0):
    return (k, s, codes[0][:2] if codes else "45", d, list(codes), list(regions), country, b, *flags, crit, pw, "x")


HISTORY = [
    row("h1", "s1", date(2017, 1, 1)), row("h2", "s1", date(2017, 2, 1), codes=("45000000", "45210000"), b="b2", flags=(False, True, None, None, None)), row("h3", "s2", date(2017, 3, 1), codes=("45210000",), regions=("DE212", "FR"), country="FR", crit=None, pw=None),
    row("h4", "s3", date(2017, 1, 1), codes=("33000000",)),
]


def matrix(spark, cases):
    h = spark.createDataFrame(HISTORY, SCHEMA)
    t = M.with_signature(spark.createDataFrame(cases, SCHEMA).drop("sig").withColumnRenamed("s", "winner"))
    return t, {(r.k, r.s): r for r in t.select("k", "sig").join(M.case_matrix(h.drop("sig"), t), "sig").collect()}


def test_features_by_hand(spark):
    t, got = matrix(spark, [row("t1", "s1", date(2017, 8, 1), codes=("45000000", "45990000")), row("t2", "s2", date(2017, 8, 1), regions=(), country=None, b=None, flags=(None,) * 5, crit=None, pw=None), row("t3", "s1", date(2017, 8, 1), codes=("45000000", "45990000"))])
    assert set(got) == {(k, s) for k in ("t1", "t2", "t3") for s in ("s1", "s2")}
    a = got["t1", "s1"]
    assert math.isclose(a.cpv2_experience, math.log(3)) and math.isclose(a.buyer_breadth, math.log(3)) and math.isclose(a.public_activity_recency, 1 / (1 + 181)) and a.context_specialization == 1.0
    assert math.isclose(a.cpv_exact_set_fit, math.log(3) / 2)  # one of two codes seen, in two awards
    assert math.isclose(a.cpv3_set_fit, math.log(3) / 2) and math.isclose(a.nuts1_fit, math.log(3)) and math.isclose(a.country_fit, math.log(3))
    assert math.isclose(a.prior_buyer_count, math.log(2)) and math.isclose(a.buyer_relationship_share, 0.5) and math.isclose(a.prior_buyer_recency, 1 / (1 + 212))
    assert math.isclose(a.regime_match_share, 0.5) and math.isclose(a.crit_code_fit, math.log(3)) and a.price_weight_similarity == 1.0
    b = got["t1", "s2"]
    assert b.cpv_exact_set_fit == 0 and b.country_fit == 0 and b.price_weight_similarity == 0 and b.crit_code_fit == 0 and math.isclose(b.nuts1_fit, math.log(2)) and b.nuts3_fit == 0
    off = got["t2", "s1"]
    assert all(off[f"on_{f}"] == (f in M.GROUPS["category"] + M.GROUPS["activity"]) for f in M.FEATURES) and off.prior_buyer_count == 0
    assert t.select("sig").distinct().count() == 2  # alike cases share a signature
    assert matrix(spark, [])[1] == {}


def test_masked_groups_take_no_part(spark):
    t, _ = matrix(spark, [row("t2", "s2", date(2017, 8, 1), regions=(), country=None, b=None, flags=(None,) * 5, crit=None, pw=None)])
    d = R.grouped_distances(M.case_matrix(spark.createDataFrame(HISTORY, SCHEMA).drop("sig"), t), ["sig"], M.groups())
    d = R.combined(R.combined(d, M.equal_weights(M.MODELS["M5_STRUCTURED_CRITERIA"]), "m5"), M.equal_weights(M.MODELS["M1_CATEGORY_SET"]), "m1")
    rows = d.collect()
    assert rows and all(not r[f"{g}_on"] for r in rows for g in ("geography", "buyer", "regime", "criteria")) and all(math.isclose(r.m5, r.m1) for r in rows)


def test_pooled_candidates_are_the_pairs(spark):
    context = [("x", f"s{i}", 1 + i % 3) for i in range(20)] + [("y", f"s{i}", 2) for i in range(5)]
    relation = [("b1", "s1", 4), ("b1", "s3", 4), ("b2", "s1", 1), ("b1", "other", 9)]
    cases = [("b1", "x"), ("b1", "x"), ("b2", "y"), ("b3", "x"), (None, "x")]
    k, r, a = (spark.createDataFrame(v, s) for v, s in ((cases, "b string, c2 string"), (relation, "b string, s string, np long"), (context, "c2 string, s string, n long")))
    got = {(x.b, x.c2, x.n, x.np): x.k for x in X.pooled_candidates(k, a, r).collect()}
    want = {}
    for b, c2 in set(cases):
        for ctx, s, n in context:
            if ctx == c2:
                key = (b, c2, n, next((m for bb, ss, m in relation if (bb, ss) == (b, s)), 0))
                want[key] = want.get(key, 0) + 1
    assert {x: v for x, v in got.items() if x[0]} == {x: v for x, v in want.items() if x[0]}


def test_statistics_by_window_or_by_join(spark):
    df = spark.range(60).select((F.col("id") % 4).alias("g"), "id", (F.col("id") * 7 % 11).cast("double").alias("x"), F.lit(0.0).alias("z"))
    for f in (lambda s: R.topsis(df, ["g"], {"x": 0.6, "z": 0.4}, costs=("x",), spread=s), lambda s: R.vikor(df, ["g"], {"x": 0.5, "z": 0.5}, spread=s), lambda s: R.min_max(df, ["g"], ["x", "z"], s)):
        one, two = (sorted(map(tuple, f(s).select(*sorted(f(s).columns)).collect())) for s in (True, False))
        assert one == two
