import math

import pytest
from pyspark.sql import functions as F

from bidloom.operators import aggregates as A
from bidloom.operators import entities as E
from bidloom.operators import evaluation as V
from bidloom.operators import features as X
from bidloom.operators import ranking as R
from bidloom.operators import tables as T


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (1, " ", "x"), (2, None, "y")], "k int, a string, b string")
    with pytest.raises(T.ContractError):
        T.require_columns(df, ["k", "z"])
    with pytest.raises(T.ContractError):
        T.assert_unique(df, ["k"])
    with pytest.raises(T.ContractError):
        T.require_order(df, ["a", "k", "b"])
    assert T.resolve_column(df, ["x", "A"]) == "a"
    assert T.select_with_missing(df, ["a", "z"], year=2017).columns == ["a", "z", "year"]
    cov = {r.column_name: (r.n_values, r.share) for r in T.coverage(df).collect()}
    assert cov == {"k": (3, 1.0), "a": (1, 0.333333), "b": (2, 0.666667)}
    assert T.coverage(df.limit(0)).collect()[0].share is None


def test_aggregates(spark):
    df = spark.createDataFrame([("g", "x", 1), ("g", "x", 2), ("g", None, 3), ("h", "x", 4), ("h", "y", None)], "g string, v string, n int")
    got = {r.g: (r.u, r.d) for r in df.groupBy("g").agg(A.unanimous(F.col("v")).alias("u"), A.disagrees(F.col("v")).alias("d")).collect()}
    assert got == {"g": ("x", False), "h": (None, True)}
    hhi = {r.g: r.hhi for r in A.concentration(df, ["g"], "v", F.col("n")).collect()}
    assert hhi["g"] == 0.5 and hhi["h"] is None or hhi["h"] == 1.0
    f = A.funnel(df, [("v", F.col("v").isNotNull()), ("n", F.col("n") > 1)]).orderBy("step").collect()
    assert [(r.n_left, r.share_of_previous) for r in f] == [(4, 0.8), (2, 0.5)]
    assert [r.share_varying for r in A.variability(df, ["g"], ["v"]).collect()] == [0.5]


def test_ranks_with_ties(spark):
    rows = [("c", i, s) for i, s in enumerate([3.0, 2.0, 2.0, 2.0, 1.0])] + [("d", 1, 5.0)]
    df = spark.createDataFrame(rows, "c string, i int, s double")
    got = {(r.c, r.i): (r.best, r.worst, r.mid, r.ties) for r in R.tied_ranks(df, ["c"], "s").collect()}
    assert got["c", 1] == (2, 4, 3.0, 3) and got["d", 1] == (1, 1, 1.0, 1)
    win = {r.c: r for r in R.winner_ranks(df, ["c"], "s", F.col("i") == 1).collect()}
    assert win["c"].mid == 3.0 and win["c"].pool_size == 5 and win["c"].percentile_rank == 0.5 and win["d"].percentile_rank == 1.0
    assert R.winner_ranks(df, ["c"], "s", F.col("i") == 99).count() == 0


def test_topsis_and_vikor(spark):
    df = spark.createDataFrame([("c", 3.0, 4.0), ("c", 4.0, 3.0), ("c", 0.0, 0.0), ("k", 1.0, 1.0), ("z", 0.0, 0.0)], "c string, x double, y double")
    got = R.topsis(df, ["c"], {"x": 0.5, "y": 0.5}).collect()
    by = {(r.c, r.x): r.topsis for r in got}
    assert math.isclose(by["c", 3.0], by["c", 4.0]) and by["c", 0.0] == 0.0 and by["k", 1.0] == 0.5 and by["z", 0.0] == 0.5
    q = {(r.c, r.x): r.vikor for r in R.vikor(df, ["c"], {"x": 0.5, "y": 0.5}).collect()}
    assert q["c", 0.0] == 1.0 and q["k", 1.0] == 0.0
    cost = {r.x: r.topsis for r in R.topsis(df.filter("c = 'c'"), ["c"], {"x": 1.0}, costs=("x",)).collect()}
    assert cost[0.0] == 1.0 and cost[4.0] == 0.0


def test_groups_weigh_squared_and_renormalise(spark):
    df = spark.createDataFrame([("c", 1.0, 0.0, 5.0), ("c", 0.0, 1.0, 5.0)], "c string, x double, y double, z double")
    groups = [R.Group("a", ("x",)), R.Group("b", ("y",)), R.Group("off", ("z",), {"z": "never"})]
    d = R.grouped_distances(df.withColumn("never", F.lit(False)), ["c"], groups)
    out = R.combined(d, {"a": 0.5, "b": 0.25, "off": 0.25}, "s").orderBy("x").collect()
    assert not out[0].off_on and math.isclose(out[1].s, 2 / 3, rel_tol=1e-9) and math.isclose(out[0].s, 1 / 3, rel_tol=1e-9)


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(400).select(F.lit("m").alias("m"), (F.col("id") % 20 + 1).cast("double").alias("mid"))
    rec = df.withColumn("reciprocal_rank", 1 / F.col("mid")).withColumn("at_10", F.col("mid") <= 10)
    r = R.bootstrap(rec, ["m"], 200).collect()[0]
    assert r.hit_lo < 50 < r.hit_hi and r.hit_hi - r.hit_lo < 15 and r.resamples == 200


def test_features(spark):
    df = spark.createDataFrame([(1, "s1", "b", "x", "xy"), (2, "s1", "b", "x", None), (3, "s2", "b", "x", "xy")], "d int, s string, b string, c2 string, c3 string")
    act = X.context_activity(df, {"C2": "c2", "C3": "c3"}, "s", "d")
    assert {(r.level, r.supplier): r.n_awards for r in act.collect()} == {("C2", "s1"): 2, ("C2", "s2"): 1, ("C3", "s1"): 1, ("C3", "s2"): 1}
    pools = [X.Pool("P1", "C2", 1), X.Pool("P2", "C2", 2)]
    cases = spark.createDataFrame([(9, "s2", "x"), (8, "s2", "none")], "case int, winner string, c2 string")
    got = {(r.case, r.pool): (r.pool_size, r.winner_in, r.empty) for r in X.pool_summary(X.assignments(cases, "case", {"C2": "c2"}, pools), X.eligibility(act, pools), "case").collect()}
    assert got == {(9, "P1"): (2, True, False), (9, "P2"): (1, False, False), (8, "P1"): (0, False, True), (8, "P2"): (0, False, True)}
    assert X.bins(spark.range(100), "id").groupBy("bin").count().count() == 4


def test_entities(spark):
    rows = [("Foo GmbH", "DE111111", "DE", "A"), ("FOO GMBH", None, "DE", "A"), ("Foo GmbH---Bar", "DE111111", "DE", "A"), ("Bar", "DE222222", "DE", "B"), ("Bar", "DE333333", "DE", "B"), ("Bar", None, "DE", "B"), ("Baz", None, None, "C"), (None, None, None, None)]
    k = E.identities(spark.createDataFrame(rows, "n string, i string, c string, t string"), "n", "i", "c", "t")
    a = E.anchors(k)
    out = [(r.method, r.entity_id) for r in E.entity_of(k, a, E.bridges(k, a)).select("n", "i", "method", "entity_id").collect()]
    assert sorted(m for m, _ in out) == ["ambiguous", "bridge", "group", "identifier", "identifier", "identifier", "name_town", "unresolved"]
    assert ("bridge", "ID||DE||DE111111") in out
    assert E.anchors(k, max_names=0).filter("reliable").count() == 0


def test_scores_of_extractions(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "g array<string>, p array<string>")
    assert [r[0] for r in df.select(V.set_f1(F.col("g"), F.col("p"))).collect()] == [0.5, 1.0, 0.0]
    assert [r[0] for r in df.select(V.jaccard(F.col("g"), F.col("p"))).collect()] == [1 / 3, 1.0, 0.0]
    w = spark.range(1).select(V.bounded_weights([F.lit(0.25)] * 4, [F.lit(x) for x in (0.3, -0.2, 0.0, 0.0)])).collect()[0][0]
    assert abs(sum(w) - 1) < 1e-5 and max(w) <= 0.450001 and min(w) >= 0.099999
    q = spark.createDataFrame([("A  B\nc", "a b", True), ("x", "", False), (None, "x", False)], "t string, q string, want boolean")
    assert all(r[0] == r[1] for r in q.select(V.grounded(F.col("t"), F.col("q")), "want").collect())


def test_claims_match_one_to_one(spark):
    rows = [("p", "gold", 0, "the price is ten", "c", "a"), ("p", "gold", 1, "the price is ten", "c", "a"), ("p", "found", 0, "the price is ten", "c", "a"), ("p", "found", 1, "nothing alike at all", "zzz", "b"), ("q", "found", 0, "x", "y", "z")]
    got = V.match_claims(spark.createDataFrame(rows, "packet string, side string, idx long, quote string, claim string, aspect string")).collect()
    assert [(r.packet, r.gold_idx, r.found_idx) for r in got] == [("p", 0, 0)]
