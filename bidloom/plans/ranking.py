"""Queries of pools, features, multi-criteria ranking and its evaluation.

Awards are the order lines with one supplier and one part context per key; those before 2000
are the history, the others the target cases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators import features as X
from bidloom.operators import ranking as R
from bidloom.operators.aggregates import concentration, share, unanimous
from bidloom.plans.book import Book, Tables

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col
W = Window
LEVELS = {"C2": "c2", "C3": "c3", "C4": "c4"}
POOLS = [X.Pool("C2_MIN1", "C2", 1), X.Pool("C3_MIN1", "C3", 1), X.Pool("C4_MIN1", "C4", 1), X.Pool("C2_MIN2", "C2", 2)]
CUTOFF = date(2000, 1, 1)


def awards(t: Tables) -> DataFrame:
    """One row per key whose lines agree on supplier and context."""
    line = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_returnflag", "l_linestatus")
    part = t.part.select("p_partkey", "p_type", F.concat_ws("|", "p_type", "p_brand").alias("_c3"), F.concat_ws("|", "p_type", "p_brand", "p_size").alias("_c4"))
    order = t.orders.select("o_orderkey", "o_custkey", c("o_orderdate").cast("date").alias("_d"), "o_orderpriority")
    rows = line.join(part, c("l_partkey") == c("p_partkey"))
    keyed = rows.groupBy("l_orderkey", "l_linenumber").agg(
        unanimous(c("l_suppkey")).alias("s"), F.max("p_type").alias("c2"), F.max("_c3").alias("c3"), unanimous(c("_c4")).alias("c4"),
        F.max(c("l_extendedprice") * (1 - c("l_discount"))).alias("v"), F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("rf"), F.max("l_linestatus").alias("ls"),
    ).filter("s is not null and c4 is not null")
    return keyed.join(order, c("l_orderkey") == c("o_orderkey")).select(F.concat_ws("||", "l_orderkey", "l_linenumber").alias("case_id"), "s", c("o_custkey").alias("b"), c("_d").alias("d"), "c2", "c3", "c4", "v", "q", "rf", "ls", c("o_orderpriority").alias("pr"))


def history(t: Tables) -> DataFrame:
    return awards(t).filter(c("d") < CUTOFF)


def targets(t: Tables) -> DataFrame:
    return awards(t).filter(c("d") >= CUTOFF).withColumnRenamed("s", "winner")


_AW = """WITH aw AS (SELECT l_orderkey || '||' || l_linenumber AS case_id, max(l_suppkey) AS s, max(o_custkey) AS b, max(o_orderdate)::DATE AS d, max(p_type) AS c2, max(p_type || '|' || p_brand) AS c3,
  max(p_type || '|' || p_brand || '|' || p_size) AS c4, max(l_extendedprice * (1 - l_discount)) AS v, max(l_quantity) AS q, max(l_returnflag) AS rf, max(l_linestatus) AS ls, max(o_orderpriority) AS pr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber
  HAVING min(l_suppkey) = max(l_suppkey) AND min(p_type || '|' || p_brand || '|' || p_size) = max(p_type || '|' || p_brand || '|' || p_size)),
hist AS (SELECT * FROM aw WHERE d < DATE '2000-01-01'), tgt AS (SELECT * EXCLUDE (s), s AS winner FROM aw WHERE d >= DATE '2000-01-01')
"""
_SUM = """count(*) AS n_cases, """ + ", ".join(f"round(100 * avg((mid <= {k})::INT), 6) AS w_at_{k}" for k in R.CUTS) + """,
  round(avg(1.0 / mid), 9) AS mrr, round(avg(CASE WHEN pool_size <= 1 THEN 1.0 ELSE 1.0 - (mid - 1) / (pool_size - 1) END), 9) AS mean_percentile, median(mid) AS median_rank, round(avg(ties), 6) AS mean_ties, round(avg(pool_size), 6) AS mean_pool"""


# pools

_ACT = _AW + """, act AS (SELECT level, context, s AS supplier, count(*) AS n_awards, min(d) AS first_date, max(d) AS last_date FROM (
  SELECT 'C2' AS level, c2 AS context, * FROM hist UNION ALL SELECT 'C3', c3, * FROM hist UNION ALL SELECT 'C4', c4, * FROM hist) GROUP BY 1, 2, 3),
elig AS (SELECT 'C2_MIN1' AS pool, * FROM act WHERE level = 'C2' UNION ALL SELECT 'C3_MIN1', * FROM act WHERE level = 'C3' UNION ALL SELECT 'C4_MIN1', * FROM act WHERE level = 'C4' UNION ALL SELECT 'C2_MIN2', * FROM act WHERE level = 'C2' AND n_awards >= 2),
asg AS (SELECT case_id, winner, 'C2_MIN1' AS pool, c2 AS context FROM tgt UNION ALL SELECT case_id, winner, 'C3_MIN1', c3 FROM tgt UNION ALL SELECT case_id, winner, 'C4_MIN1', c4 FROM tgt UNION ALL SELECT case_id, winner, 'C2_MIN2', c2 FROM tgt),
ps AS (SELECT a.case_id, a.pool, a.context, coalesce(z.size, 0) AS pool_size, m.supplier IS NOT NULL AS winner_in, z.size IS NULL AS empty FROM asg a
  LEFT JOIN (SELECT pool, context, count(*) AS size FROM elig GROUP BY 1, 2) z USING (pool, context) LEFT JOIN elig m ON m.pool = a.pool AND m.context = a.context AND m.supplier = a.winner)
"""


def activity(t: Tables) -> DataFrame:
    return X.context_activity(history(t), LEVELS, "s", "d")


@BOOK.query(_AW + "SELECT 'C2' AS level, c2 AS context, count(*) AS n FROM hist GROUP BY 2 UNION ALL SELECT 'C3', c3, count(*) FROM hist GROUP BY 2 UNION ALL SELECT 'C4', c4, count(*) FROM hist GROUP BY 2")
def pool_01_contexts(t: Tables) -> DataFrame:
    return X.contexts(history(t), LEVELS).groupBy("level", "context").agg(F.count("*").alias("n"))


@BOOK.query(_ACT + "SELECT * FROM act")
def pool_02_activity(t: Tables) -> DataFrame:
    return activity(t)


@BOOK.query(_ACT + "SELECT pool, context, supplier, n_awards FROM elig")
def pool_03_eligibility(t: Tables) -> DataFrame:
    return X.eligibility(activity(t), POOLS).select("pool", "context", "supplier", "n_awards")


@BOOK.query(_ACT + "SELECT * FROM asg")
def pool_04_assignments(t: Tables) -> DataFrame:
    return X.assignments(targets(t), "case_id", LEVELS, POOLS)


def _pools(t: Tables) -> DataFrame:
    return X.pool_summary(X.assignments(targets(t), "case_id", LEVELS, POOLS), X.eligibility(activity(t), POOLS), "case_id")


@BOOK.query(_ACT + "SELECT * FROM ps")
def pool_05_case_summary(t: Tables) -> DataFrame:
    return _pools(t)


@BOOK.query(_ACT + "SELECT pool, count(*) AS n_cases, round(100 * avg(winner_in::INT), 6) AS coverage, round(avg(pool_size), 6) AS mean_size, median(pool_size) AS median_size, count(*) FILTER (WHERE empty) AS n_empty FROM ps GROUP BY 1")
def pool_06_coverage(t: Tables) -> DataFrame:
    return _pools(t).groupBy("pool").agg(F.count("*").alias("n_cases"), F.round(100 * F.avg(c("winner_in").cast("double")), 6).alias("coverage"), F.round(F.avg("pool_size"), 6).alias("mean_size"), F.median("pool_size").alias("median_size"), F.count_if("empty").alias("n_empty"))


_COVER = "count(*) AS n_cases, round(100 * avg(winner_in::INT), 6) AS coverage, round(100 * avg(winner_in::INT) FILTER (WHERE NOT empty), 6) AS coverage_if_any, count(*) FILTER (WHERE empty) AS n_empty, round(avg(pool_size), 6) AS mean_size, max(pool_size) AS max_size"


@BOOK.query(_ACT + ", px AS (SELECT ps.*, c2, c_nationkey FROM ps JOIN tgt USING (case_id) JOIN customer ON c_custkey = b) " + " UNION ALL ".join(f"SELECT '{k}' AS report, pool, CAST({v} AS VARCHAR) AS value, {_COVER} FROM px GROUP BY pool, {v}" for k, v in (("country", "c_nationkey"), ("category", "c2"), ("all", "'all'"))))
def pool_06_reports(t: Tables) -> DataFrame:
    """Coverage of all cases and of those with a pool, and sizes: by country, by category and over all."""
    where = targets(t).select("case_id", "c2", c("b").alias("c_custkey")).join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    each = F.array(*[F.struct(F.lit(k).alias("report"), v.alias("value")) for k, v in (("country", c("c_nationkey").cast("string")), ("category", c("c2")), ("all", F.lit("all")))])
    x = _pools(t).join(where, "case_id").select("pool", "winner_in", "empty", "pool_size", F.inline(each))
    hit = c("winner_in").cast("double")
    return x.groupBy("report", "pool", "value").agg(
        F.count("*").alias("n_cases"), F.round(100 * F.avg(hit), 6).alias("coverage"), F.round(100 * F.avg(F.when(~c("empty"), hit)), 6).alias("coverage_if_any"), F.count_if("empty").alias("n_empty"), F.round(F.avg("pool_size"), 6).alias("mean_size"), F.max("pool_size").alias("max_size"))


@BOOK.query(_ACT + "SELECT pool, count(*) AS n_pairs, count(DISTINCT context) AS n_contexts, count(DISTINCT supplier) AS n_suppliers, round(avg(n_awards), 6) AS mean_awards, max(last_date) AS last_date FROM elig GROUP BY 1")
def pool_06_eligibility(t: Tables) -> DataFrame:
    return X.eligibility(activity(t), POOLS).groupBy("pool").agg(F.count("*").alias("n_pairs"), F.count_distinct("context").alias("n_contexts"), F.count_distinct("supplier").alias("n_suppliers"), F.round(F.avg("n_awards"), 6).alias("mean_awards"), F.max("last_date").alias("last_date"))


@BOOK.query(_AW + "SELECT (SELECT max(d) FROM hist) AS last_history, (SELECT min(d) FROM tgt) AS first_target, (SELECT max(d) FROM hist) < (SELECT min(d) FROM tgt) AS strict")
def pool_07_firewall(t: Tables) -> DataFrame:
    return X.temporal_firewall(history(t), targets(t), "d")


@BOOK.query(_ACT + "SELECT a.case_id, pool, count(*) AS n_pairs, sum(e.n_awards) AS n_awards FROM asg a JOIN elig e USING (pool, context) GROUP BY 1, 2")
def jon_11_case_pool(t: Tables) -> DataFrame:
    """The pairs of cases and eligible suppliers over all pools, aggregated. What is asked of a
    pool depends on its context only, so it is aggregated per context and joined to the cases:
    the pairs themselves are never formed."""
    per = X.eligibility(activity(t), POOLS).groupBy("pool", "context").agg(F.count("*").alias("n_pairs"), F.sum("n_awards").alias("n_awards"))
    return X.assignments(targets(t), "case_id", LEVELS, POOLS).join(per, ["pool", "context"]).select("case_id", "pool", "n_pairs", "n_awards")


# features

_FS = """SELECT supplier, n_awards, n_buyers, round(hhi, 9) AS hhi, n_contexts, round(value_sum, 2) AS value_sum, round(value_median, 2) AS value_median, first_date, last_date FROM (
  SELECT s AS supplier, count(*) AS n_awards, count(DISTINCT b) AS n_buyers, count(DISTINCT c3) AS n_contexts, sum(v) AS value_sum, median(v) AS value_median, min(d) AS first_date, max(d) AS last_date FROM hist GROUP BY 1)
  JOIN (SELECT s AS supplier, sum(n * n) / pow(sum(n), 2) AS hhi FROM (SELECT s, b, count(*)::DOUBLE AS n FROM hist GROUP BY 1, 2) GROUP BY 1) USING (supplier)"""


@BOOK.query(_AW + _FS)
def fs_02_supplier_features(t: Tables) -> DataFrame:
    h = history(t).withColumnRenamed("s", "supplier")
    hhi = concentration(h, ["supplier"], "b").withColumnRenamed("n_members", "n_buyers")
    wide = h.groupBy("supplier").agg(F.count("*").alias("n_awards"), F.count_distinct("c3").alias("n_contexts"), F.round(F.sum("v"), 2).alias("value_sum"), F.round(F.median("v"), 2).alias("value_median"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))
    return wide.join(hhi, "supplier").select("supplier", "n_awards", "n_buyers", F.round("hhi", 9).alias("hhi"), "n_contexts", "value_sum", "value_median", "first_date", "last_date")


_CTX = """, ctx AS (SELECT c2, s, count(*) AS n, count(DISTINCT b) AS nb, sum(v) AS vs, max(d) AS last, sum(q) AS q FROM hist GROUP BY 1, 2)
"""
_FOUR = """, f AS (SELECT c2, s, n, ln(1 + n) AS exp, ln(1 + nb) AS breadth, 1.0 / (1 + date_diff('day', last, DATE '2000-01-01')) AS rec, n / sum(n) OVER (PARTITION BY s) AS spec FROM ctx)
"""


def context_features(t: Tables) -> DataFrame:
    """Per context and supplier the four base criteria: experience, breadth, recency, specialisation."""
    pairs = history(t).groupBy("c2", "s", "b").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    per = pairs.groupBy("c2", "s").agg(F.sum("n").alias("n"), F.count("b").alias("nb"), F.max("last").alias("last"))
    days = F.datediff(F.lit(CUTOFF), "last")
    return per.select("c2", "s", "n", F.log1p("n").alias("exp"), F.log1p("nb").alias("breadth"), (1.0 / (1 + days)).alias("rec"), share(c("n"), F.sum("n").over(W.partitionBy("s"))).alias("spec"))


BASE = ["exp", "breadth", "rec", "spec"]
EQUAL = dict.fromkeys(BASE, 0.25)


@BOOK.query(_AW + _CTX + "SELECT c2, s, n, nb, round(vs, 2) AS vs, round(n / sum(n) OVER (PARTITION BY s), 9) AS share_of_supplier, round(n / sum(n) OVER (PARTITION BY c2), 9) AS share_of_context FROM ctx")
def fs_03_context_features(t: Tables) -> DataFrame:
    per = history(t).groupBy("c2", "s").agg(F.count("*").alias("n"), F.count_distinct("b").alias("nb"), F.round(F.sum("v"), 2).alias("vs"))
    return per.select("c2", "s", "n", "nb", "vs", F.round(share(c("n"), F.sum("n").over(W.partitionBy("s"))), 9).alias("share_of_supplier"), F.round(share(c("n"), F.sum("n").over(W.partitionBy("c2"))), 9).alias("share_of_context"))


@BOOK.query(_AW + """, w AS (SELECT s, count(*) AS n, count(DISTINCT b) AS nb, max(d) AS last FROM hist GROUP BY 1), x AS (SELECT s, c2, count(*) AS n FROM hist GROUP BY 1, 2), r AS (SELECT s, b, count(*) AS n FROM hist GROUP BY 1, 2)
SELECT case_id, winner, tgt.c2, c3, c4, tgt.b AS buyer, tgt.d AS dispatch, coalesce(w.n, 0) AS winner_awards, coalesce(w.nb, 0) AS winner_buyers, date_diff('day', w.last, tgt.d) AS winner_days, coalesce(x.n, 0) AS winner_in_context, coalesce(r.n, 0) AS winner_with_buyer
FROM tgt LEFT JOIN w ON w.s = winner LEFT JOIN x ON x.s = winner AND x.c2 = tgt.c2 LEFT JOIN r ON r.s = winner AND r.b = tgt.b""")
def fs_04_target_features(t: Tables) -> DataFrame:
    """The target cases with what the history knows of their winner."""
    h = history(t).withColumnRenamed("s", "winner")
    all_ = h.groupBy("winner").agg(F.count("*").alias("winner_awards"), F.count_distinct("b").alias("winner_buyers"), F.max("d").alias("last"))
    here = h.groupBy("winner", "c2").agg(F.count("*").alias("winner_in_context"))
    with_ = h.groupBy("winner", "b").agg(F.count("*").alias("winner_with_buyer"))
    x = targets(t).join(all_, "winner", "left").join(here, ["winner", "c2"], "left").join(with_, ["winner", "b"], "left").withColumn("winner_days", F.datediff("d", "last"))
    counts = ("winner_awards", "winner_buyers", "winner_in_context", "winner_with_buyer")
    return x.select("case_id", "winner", "c2", "c3", "c4", c("b").alias("buyer"), c("d").alias("dispatch"), "winner_days", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


@BOOK.query(_AW + "SELECT case_id, s_nationkey <> c_nationkey AS cross_border FROM aw JOIN supplier ON s = s_suppkey JOIN customer ON b = c_custkey")
def fs_05_cross_border(t: Tables) -> DataFrame:
    sup, cus = t.supplier.select("s_suppkey", "s_nationkey"), t.customer.select("c_custkey", "c_nationkey")
    return awards(t).join(sup, c("s") == c("s_suppkey")).join(cus, c("b") == c("c_custkey")).select("case_id", (c("s_nationkey") != c("c_nationkey")).alias("cross_border"))


_DIMS = {"context": "c2", "subcontext": "c3", "buyer": "b", "priority": "pr", "flag": "rf", "status": "ls"}


@BOOK.query(_AW + "SELECT dimension, value, supplier, count(*) AS n_matched FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, CAST({v} AS VARCHAR) AS value, s AS supplier FROM hist" for k, v in _DIMS.items()) + ") GROUP BY 1, 2, 3")
def fit_01_indices(t: Tables) -> DataFrame:
    return X.fit_index(history(t), _DIMS, "s")


@BOOK.query(_AW + "SELECT b AS buyer, s AS supplier, count(*) AS n_prior, max(d) AS last_prior, round(count(*) / sum(count(*)) OVER (PARTITION BY s), 9) AS prior_share FROM hist GROUP BY 1, 2")
def fit_04_relationships(t: Tables) -> DataFrame:
    return X.relationships(history(t), "b", "s", "d").withColumn("prior_share", F.round("prior_share", 9))


@BOOK.query(_AW + "SELECT field, value, s AS supplier, count(*) AS n FROM (SELECT 'returned' AS field, rf = 'R' AS value, s FROM hist UNION ALL SELECT 'open', ls = 'O', s FROM hist UNION ALL SELECT 'urgent', pr LIKE '1%', s FROM hist) GROUP BY 1, 2, 3")
def fit_05_regime(t: Tables) -> DataFrame:
    flags = history(t).select(c("s").alias("supplier"), (c("rf") == "R").alias("returned"), (c("ls") == "O").alias("open"), c("pr").like("1%").alias("urgent"))
    return flags.unpivot(["supplier"], ["returned", "open", "urgent"], "field", "value").groupBy("field", "value", "supplier").agg(F.count("*").alias("n"))


@BOOK.query(_AW + "SELECT c2, count(*) AS n_rows, count(v) AS value_n, round(quantile_cont(v, 0.5), 6) AS value_p50, round(quantile_cont(v, 0.75), 6) AS value_p75, round(quantile_cont(v, 0.9), 6) AS value_p90, count(rf) AS returned_n, round(avg((rf = 'R')::INT), 9) AS returned_share FROM hist GROUP BY 1")
def fit_07_descriptors(t: Tables) -> DataFrame:
    return X.descriptors(history(t), "c2", {"value": c("v")}, {"returned": c("rf") == "R"})


@BOOK.query(_AW + """, ix AS (SELECT value, supplier, count(*) AS n FROM (SELECT c3 AS value, s AS supplier FROM hist) GROUP BY 1, 2), tok AS (SELECT b AS buyer, list(DISTINCT c3) AS ts FROM tgt GROUP BY 1),
e AS (SELECT buyer, len(ts) AS m, unnest(ts) AS value FROM tok) SELECT buyer, supplier, round(sum(ln(1 + n)) / max(m), 9) AS fit FROM e JOIN ix USING (value) GROUP BY 1, 2""")
def rnk_08_set_fit(t: Tables) -> DataFrame:
    index = X.fit_index(history(t), {"c3": "c3"}, "s").drop("dimension")
    cases = targets(t).groupBy(c("b").alias("buyer")).agg(F.collect_set("c3").alias("ts"))
    return X.set_fit(cases, "buyer", "ts", index).withColumn("fit", F.round("fit", 9))


# scores

@BOOK.query(_AW + _CTX + _FOUR + "SELECT c2, s, round(exp, 9) AS exp, round(breadth, 9) AS breadth, round(rec, 9) AS rec, round(spec, 9) AS spec FROM f")
def rnk_01_base_features(t: Tables) -> DataFrame:
    return context_features(t).select("c2", "s", *[F.round(x, 9).alias(x) for x in BASE])


_RANKS = """SELECT tgt.case_id, r.pool_size, r.best, r.ties, (r.best + r.best + r.ties - 1) / 2.0 AS mid FROM tgt JOIN (
  SELECT c2, s, count(*) OVER (PARTITION BY c2) AS pool_size, rank() OVER (PARTITION BY c2 ORDER BY {0} DESC) AS best, count(*) OVER (PARTITION BY c2, {0}) AS ties FROM {1}) r ON r.c2 = tgt.c2 AND r.s = tgt.winner"""


def _records(t: Tables, scored: DataFrame, score: str) -> DataFrame:
    """Ranks are computed once per context; cases with one signature share them."""
    ranked = R.tied_ranks(scored, ["c2"], score).withColumn("pool_size", F.count("*").over(W.partitionBy("c2"))).select("c2", c("s").alias("winner"), "best", "ties", "pool_size")
    return R.case_record(targets(t).select("case_id", "c2", "winner").join(ranked, ["c2", "winner"]))


@BOOK.query(_AW + _CTX + f"SELECT 'frequency' AS method, {_SUM} FROM ({_RANKS.format('n', 'ctx')})")
def rnk_02_frequency(t: Tables) -> DataFrame:
    """Ranking by awards in the context, evaluated over all target cases."""
    scored = history(t).groupBy("c2", "s").agg(F.count("*").alias("n"))
    return R.summary(_records(t, scored, "n").withColumn("method", F.lit("frequency")), ["method"])


_MM = ", ".join(f"CASE WHEN max({x}) OVER w > min({x}) OVER w THEN ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) ELSE 0 END AS {x}_mm" for x in BASE)


@BOOK.query(_AW + _CTX + _FOUR + "SELECT c2, s, " + ", ".join(f"round({x}_mm, 9) AS {x}_mm" for x in BASE) + f" FROM (SELECT *, {_MM} FROM f WINDOW w AS (PARTITION BY c2))")
def rnk_03_min_max(t: Tables) -> DataFrame:
    return R.min_max(context_features(t), ["c2"], BASE, spread=True).select("c2", "s", *[F.round(f"{x}_mm", 9).alias(f"{x}_mm") for x in BASE])


@BOOK.query(_AW + _CTX + _FOUR + f"SELECT c2, s, round(({' + '.join(x + '_mm' for x in BASE)}) / 4, 9) AS wsm FROM (SELECT *, {_MM} FROM f WINDOW w AS (PARTITION BY c2))")
def rnk_04_weighted_sum(t: Tables) -> DataFrame:
    return R.weighted_sum(context_features(t), ["c2"], BASE, spread=True).select("c2", "s", F.round("wsm", 9).alias("wsm"))


_VN = ", ".join(f"{x} / nullif(sqrt(sum({x} * {x}) OVER (PARTITION BY c2)), 0) AS {x}_v" for x in BASE)
_TOP = f""", vn AS (SELECT c2, s, {', '.join(f'coalesce({x}_v, 0) AS {x}' for x in BASE)} FROM (SELECT *, {_VN} FROM f)),
dd AS (SELECT c2, s, {' + '.join(f'pow(0.25 * ({x} - max({x}) OVER w), 2)' for x in BASE)} AS p2, {' + '.join(f'pow(0.25 * ({x} - min({x}) OVER w), 2)' for x in BASE)} AS m2 FROM vn WINDOW w AS (PARTITION BY c2)),
tp AS (SELECT c2, s, CASE WHEN sqrt(p2) + sqrt(m2) > 0 THEN sqrt(m2) / (sqrt(p2) + sqrt(m2)) ELSE 0.5 END AS topsis FROM dd)
"""


@BOOK.query(_AW + _CTX + _FOUR + _TOP + "SELECT c2, s, round(topsis, 9) AS topsis FROM tp")
def rnk_05_topsis(t: Tables) -> DataFrame:
    return R.topsis(context_features(t), ["c2"], EQUAL, spread=True).select("c2", "s", F.round("topsis", 9).alias("topsis"))


_VIK = f""", rg AS (SELECT c2, s, {', '.join(f'CASE WHEN max({x}) OVER w > min({x}) OVER w THEN 0.25 * (max({x}) OVER w - {x}) / (max({x}) OVER w - min({x}) OVER w) ELSE 0 END AS {x}' for x in BASE)} FROM f WINDOW w AS (PARTITION BY c2)),
sr AS (SELECT c2, s, {' + '.join(BASE)} AS sv, greatest({', '.join(BASE)}) AS rv FROM rg)
SELECT c2, s, round(0.5 * CASE WHEN max(sv) OVER w > min(sv) OVER w THEN (sv - min(sv) OVER w) / (max(sv) OVER w - min(sv) OVER w) ELSE 0 END + 0.5 * CASE WHEN max(rv) OVER w > min(rv) OVER w THEN (rv - min(rv) OVER w) / (max(rv) OVER w - min(rv) OVER w) ELSE 0 END, 9) AS vikor FROM sr WINDOW w AS (PARTITION BY c2)"""


@BOOK.query(_AW + _CTX + _FOUR + _VIK)
def rnk_06_vikor(t: Tables) -> DataFrame:
    return R.vikor(context_features(t), ["c2"], EQUAL, spread=True).select("c2", "s", F.round("vikor", 9).alias("vikor"))


GROUPS = [R.Group("activity", ("exp", "breadth")), R.Group("recency", ("rec",)), R.Group("special", ("spec",))]
MODELS = {"m_all": {"activity": 1 / 3, "recency": 1 / 3, "special": 1 / 3}, "m_no_recency": {"activity": 0.5, "special": 0.5}, "m_activity": {"activity": 1.0}}
_GD = """, vn AS (SELECT c2, s, """ + ", ".join(f"coalesce({x}_v, 0) AS {x}" for x in BASE) + f""" FROM (SELECT *, {_VN} FROM f)),
gd AS (SELECT c2, s, (pow(exp - max(exp) OVER w, 2) + pow(breadth - max(breadth) OVER w, 2)) / 4 AS ap, (pow(exp - min(exp) OVER w, 2) + pow(breadth - min(breadth) OVER w, 2)) / 4 AS am,
  pow(rec - max(rec) OVER w, 2) AS rp, pow(rec - min(rec) OVER w, 2) AS rm, pow(spec - max(spec) OVER w, 2) AS sp, pow(spec - min(spec) OVER w, 2) AS sm FROM vn WINDOW w AS (PARTITION BY c2))
"""


def _combined_sql(name: str, a: float, r: float, s: float) -> str:
    p, m = f"{a}*{a}*ap + {r}*{r}*rp + {s}*{s}*sp", f"{a}*{a}*am + {r}*{r}*rm + {s}*{s}*sm"
    return f"round(CASE WHEN sqrt({p}) + sqrt({m}) > 0 THEN sqrt({m}) / (sqrt({p}) + sqrt({m})) ELSE 0.5 END, 9) AS {name}"


def _grouped(t: Tables) -> DataFrame:
    return R.grouped_distances(context_features(t), ["c2"], GROUPS, spread=True)


@BOOK.query(_AW + _CTX + _FOUR + _GD + "SELECT c2, s, round(ap, 12) AS activity_plus, round(am, 12) AS activity_minus, round(rp, 12) AS recency_plus, round(sm, 12) AS special_minus FROM gd")
def rnk_12_group_distances(t: Tables) -> DataFrame:
    return _grouped(t).select("c2", "s", *[F.round(x, 12).alias(x) for x in ("activity_plus", "activity_minus", "recency_plus", "special_minus")])


@BOOK.query(_AW + _CTX + _FOUR + _GD + "SELECT c2, s, " + ", ".join((_combined_sql("m_all", 1 / 3, 1 / 3, 1 / 3), _combined_sql("m_no_recency", 0.5, 0.0, 0.5), _combined_sql("m_activity", 1.0, 0.0, 0.0))) + " FROM gd")
def rnk_16_nested_models(t: Tables) -> DataFrame:
    """Several models from one computation of the group distances."""
    out = _grouped(t)
    for name, w in MODELS.items():
        out = R.combined(out, w, name)
    return out.select("c2", "s", *[F.round(x, 9).alias(x) for x in MODELS])


# cases with buyer features: a pool per case

_CASE = _AW + """, ct AS (SELECT c2, s, count(*) AS n FROM hist GROUP BY 1, 2), rel AS (SELECT b, s, count(*) AS np FROM hist GROUP BY 1, 2),
cf AS (SELECT case_id, ct.s, winner, ct.n, ln(1 + ct.n) AS exp, ln(1 + coalesce(np, 0)) AS prior FROM tgt JOIN ct USING (c2) LEFT JOIN rel ON rel.b = tgt.b AND rel.s = ct.s),
cv AS (SELECT *, coalesce(exp / nullif(sqrt(sum(exp * exp) OVER (PARTITION BY case_id)), 0), 0) AS ev, coalesce(prior / nullif(sqrt(sum(prior * prior) OVER (PARTITION BY case_id)), 0), 0) AS pv FROM cf),
cd AS (SELECT case_id, s, winner, pow(0.5 * (ev - max(ev) OVER w), 2) + pow(0.5 * (pv - max(pv) OVER w), 2) AS p2, pow(0.5 * (ev - min(ev) OVER w), 2) + pow(0.5 * (pv - min(pv) OVER w), 2) AS m2 FROM cv WINDOW w AS (PARTITION BY case_id)),
cs AS (SELECT case_id, s, winner, round_even(CASE WHEN sqrt(p2) + sqrt(m2) > 0 THEN sqrt(m2) / (sqrt(p2) + sqrt(m2)) ELSE 0.5 END, 9) AS score FROM cd),
rec AS (SELECT *, (best + best + ties - 1) / 2.0 AS mid FROM (SELECT case_id, count(*) AS pool_size, count(*) FILTER (WHERE score > own) + 1 AS best, count(*) FILTER (WHERE score = own) AS ties FROM (
  SELECT *, max(score) FILTER (WHERE s = winner) OVER (PARTITION BY case_id) AS own FROM cs) WHERE own IS NOT NULL GROUP BY 1))
"""


def _case_records(t: Tables) -> DataFrame:
    """Every target case's record in its primary pool by TOPSIS over experience and prior relation."""
    h = history(t)
    context = h.groupBy("c2", "s").agg(F.count("*").alias("n"))
    relation = h.groupBy("b", "s").agg(F.count("*").alias("np"))
    x = X.pooled_candidates(targets(t), context, relation).withColumn("exp", F.log1p("n")).withColumn("prior", F.log1p("np"))
    w = W.partitionBy("b", "c2")
    plus = minus = F.lit(0.0)
    for f in ("exp", "prior"):
        x = x.withColumn("_n", F.sqrt(F.sum(c("k") * c(f) * c(f)).over(w))).withColumn(f, F.when(c("_n") > 0, c(f) / c("_n")).otherwise(0.0))
    for f in ("exp", "prior"):
        plus = plus + F.pow(0.5 * (c(f) - F.max(f).over(w)), F.lit(2))
        minus = minus + F.pow(0.5 * (c(f) - F.min(f).over(w)), F.lit(2))
    pools = x.withColumn("score", F.bround(R.closeness(plus, minus), 9)).groupBy("b", "c2").agg(F.sum("k").alias("pool_size"), F.collect_list(F.struct("n", "np", "score", "k")).alias("rows"))  # one row per kind of supplier
    own = targets(t).select("case_id", "b", "c2", "winner").join(context.withColumnRenamed("s", "winner"), ["c2", "winner"]).join(relation.withColumnRenamed("s", "winner"), ["b", "winner"], "left").withColumn("np", F.coalesce("np", F.lit(0)))
    at = own.join(pools, ["b", "c2"]).withColumn("own", F.filter("rows", lambda r: (r["n"] == c("n")) & (r["np"] == c("np")))[0]["score"])
    count = lambda rule: F.aggregate(F.filter("rows", rule), F.lit(0).cast("bigint"), lambda a, r: a + r["k"])
    return R.case_record(at.select("case_id", "pool_size", (count(lambda r: r["score"] > c("own")) + 1).alias("best"), count(lambda r: r["score"] == c("own")).alias("ties")))


@BOOK.query(_CASE + "SELECT case_id, pool_size, best, ties, mid FROM rec")
def rnk_17_case_records(t: Tables) -> DataFrame:
    return _case_records(t).select("case_id", "pool_size", "best", "ties", "mid")


@BOOK.query(_CASE + f"SELECT 'topsis' AS method, {_SUM} FROM rec")
def evl_01_summary(t: Tables) -> DataFrame:
    return R.summary(_case_records(t).withColumn("method", F.lit("topsis")), ["method"])


@BOOK.query(_CASE + f"SELECT c2, {_SUM} FROM rec JOIN tgt USING (case_id) GROUP BY 1")
def evl_02_by_context(t: Tables) -> DataFrame:
    return R.summary(_case_records(t).join(targets(t).select("case_id", "c2"), "case_id"), ["c2"])


@BOOK.query(_CASE + """, h AS (SELECT pool_size, count(*) AS m FROM rec GROUP BY 1), hh AS (SELECT pool_size, m, list_sum([1.0 / i FOR i IN range(1, pool_size + 1)]) / pool_size AS h FROM h)
SELECT 'topsis' AS method, sum(m) AS n_cases, """ + ", ".join(f"round(100 * sum(m * least(1.0, {k} / pool_size)) / sum(m), 6) AS random_at_{k}" for k in R.CUTS) + ", round(sum(m * h) / sum(m), 9) AS random_mrr FROM hh")
def evl_03_random_expectation(t: Tables) -> DataFrame:
    return R.random_expectation(_case_records(t).withColumn("method", F.lit("topsis")), ["method"])


@BOOK.query(_CASE + """, h AS (SELECT pool_size, count(*) AS m FROM rec GROUP BY 1), hh AS (SELECT pool_size, m, list_sum([1.0 / i FOR i IN range(1, pool_size + 1)]) / pool_size AS h FROM h),
a AS (SELECT """ + ", ".join(f"100 * avg((mid <= {k})::INT) AS w{k}" for k in R.CUTS) + ", avg(1.0 / mid) AS mrr FROM rec), b AS (SELECT " + ", ".join(f"100 * sum(m * least(1.0, {k} / pool_size)) / sum(m) AS r{k}" for k in R.CUTS) + ", sum(m * h) / sum(m) AS rr FROM hh) SELECT 'topsis' AS method, " + ", ".join(f"round(w{k} - r{k}, 4) AS gain_at_{k}, round(w{k} / nullif(r{k}, 0), 5) AS lift_at_{k}" for k in R.CUTS) + ", round(mrr - rr, 7) AS gain_mrr, round(mrr / rr, 5) AS lift_mrr FROM a, b")
def evl_03_lift(t: Tables) -> DataFrame:
    """What the ranking gains over a random order, as difference and as ratio."""
    records = _case_records(t).withColumn("method", F.lit("topsis"))
    x = R.summary(records, ["method"]).join(R.random_expectation(records, ["method"]).drop("n_cases"), "method")
    gains = [e for k in R.CUTS for e in (F.round(c(f"w_at_{k}") - c(f"random_at_{k}"), 4).alias(f"gain_at_{k}"), F.round(F.try_divide(f"w_at_{k}", f"random_at_{k}"), 5).alias(f"lift_at_{k}"))]
    return x.select("method", *gains, F.round(c("mrr") - c("random_mrr"), 7).alias("gain_mrr"), F.round(c("mrr") / c("random_mrr"), 5).alias("lift_mrr"))


@BOOK.query(_AW + _CTX + _FOUR + _TOP + f""", a AS ({_RANKS.format('n', 'ctx')}), b AS ({_RANKS.format('topsis', '(SELECT c2, s, round_even(topsis, 9) AS topsis FROM tp)')}), m AS (SELECT b.mid - a.mid AS d, 1.0 / a.mid AS ra, 1.0 / b.mid AS rb FROM a JOIN b USING (case_id))
SELECT count(*) AS n_cases, round(avg(d), 6) AS mean_move, median(d) AS median_move, round(avg(abs(d)), 6) AS mean_abs_move, round(100.0 * count(*) FILTER (WHERE d < 0) / count(*), 6) AS pct_up, round(100.0 * count(*) FILTER (WHERE d = 0) / count(*), 6) AS pct_same,
  round(100.0 * count(*) FILTER (WHERE d > 0) / count(*), 6) AS pct_down, round(avg(rb) - avg(ra), 9) AS delta_mrr FROM m""")
def evl_04_movement(t: Tables) -> DataFrame:
    f = context_features(t)
    scored = R.topsis(f, ["c2"], EQUAL, spread=True).withColumn("topsis", F.bround("topsis", 9))
    return R.movement(_records(t, f.select("c2", "s", "n"), "n"), _records(t, scored.select("c2", "s", "topsis"), "topsis"), ["case_id"])


@BOOK.query(_AW + _CTX + _FOUR + """, r AS (SELECT *, rank() OVER (PARTITION BY c2 ORDER BY exp DESC) + (count(*) OVER (PARTITION BY c2, exp) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY c2 ORDER BY spec DESC) + (count(*) OVER (PARTITION BY c2, spec) - 1) / 2.0 AS ry FROM f)
SELECT c2, count(*) AS n, round(corr(exp, spec), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY 1""")
def evl_05_correlation(t: Tables) -> DataFrame:
    return R.rank_correlation(context_features(t), ["c2"], "exp", "spec")


@BOOK.query()
def evl_06_bootstrap(t: Tables) -> DataFrame:
    """Intervals of the ranking's quality from 300 Poisson resamples."""
    return R.bootstrap(_case_records(t).withColumn("method", F.lit("topsis")), ["method"])


@BOOK.query(_CASE + """, e AS (SELECT quantile_cont(pool_size, [0.25, 0.5, 0.75]) AS q FROM rec) SELECT len(list_filter(list_distinct(q), lambda x: x < pool_size)) + 1 AS bin, count(*) AS n_cases, round(avg(1.0 / mid), 9) AS mrr FROM rec, e GROUP BY 1""")
def evl_07_pool_bins(t: Tables) -> DataFrame:
    return X.bins(_case_records(t), "pool_size").groupBy("bin").agg(F.count("*").alias("n_cases"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"))


@BOOK.query(_CASE + """, seen AS (SELECT s, count(*) AS n FROM hist GROUP BY 1), g0 AS (SELECT case_id, EXISTS (SELECT 1 FROM rel WHERE rel.b = tgt.b AND rel.s = tgt.winner) AS prior_buyer, seen.n AS seen, s_nationkey <> c_nationkey AS cross_border
  FROM tgt JOIN seen ON seen.s = tgt.winner JOIN supplier ON s_suppkey = tgt.winner JOIN customer ON c_custkey = tgt.b), g AS (SELECT *, seen <= (SELECT median(seen) FROM g0) AS little_seen FROM g0)
""" + " UNION ALL ".join(f"SELECT '{x}' AS subgroup, {x} AS member, count(*) AS n_cases, round(avg(1.0 / mid), 9) AS mrr, median(mid) AS median_rank FROM rec JOIN g USING (case_id) GROUP BY 2" for x in ("prior_buyer", "little_seen", "cross_border")))
def evl_08_subgroups(t: Tables) -> DataFrame:
    """By three properties of a case: the buyer knew the winner, the winner was seldom seen (at most
    the median), buyer and winner are of different countries."""
    h = history(t)
    rel = h.select("b", c("s").alias("winner"), F.lit(True).alias("_p")).distinct()
    seen = h.groupBy(c("s").alias("winner")).agg(F.count("*").alias("seen"))
    x = targets(t).join(seen, "winner").join(rel, ["b", "winner"], "left")
    x = x.join(t.supplier.select(c("s_suppkey").alias("winner"), "s_nationkey"), "winner").join(t.customer.select(c("c_custkey").alias("b"), "c_nationkey"), "b")
    x = x.select("case_id", "seen", F.coalesce("_p", F.lit(False)).alias("prior_buyer"), (c("s_nationkey") != c("c_nationkey")).alias("cross_border"))
    x = x.withColumn("little_seen", c("seen") <= x.agg(F.median("seen")).scalar()).drop("seen")
    long = x.unpivot(["case_id"], ["prior_buyer", "little_seen", "cross_border"], "subgroup", "member")
    return _case_records(t).join(long, "case_id").groupBy("subgroup", "member").agg(F.count("*").alias("n_cases"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"), F.median("mid").alias("median_rank"))


@BOOK.query(_AW + _CTX + _FOUR + """, a AS (SELECT c2, s FROM (SELECT c2, s, row_number() OVER (PARTITION BY c2 ORDER BY exp DESC, s) AS k FROM f) WHERE k <= 10), b AS (SELECT c2, s FROM (SELECT c2, s, row_number() OVER (PARTITION BY c2 ORDER BY spec DESC, s) AS k FROM f) WHERE k <= 10)
SELECT c2, round(count(b.s) / count(*), 9) AS overlap FROM a LEFT JOIN b USING (c2, s) GROUP BY 1""")
def evl_09_overlap(t: Tables) -> DataFrame:
    f = context_features(t)
    return R.overlap_at(f.select("c2", "s", c("exp").alias("x")), f.select("c2", "s", c("spec").alias("x")), ["c2"], "s", "x", 10)


@BOOK.query(_AW + """, ds AS (SELECT d, row_number() OVER (ORDER BY d) / count(*) OVER () AS p FROM (SELECT DISTINCT d FROM tgt)) SELECT CASE WHEN p <= 0.6 THEN 'train' WHEN p <= 0.8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(d) AS first_date, max(d) AS last_date FROM tgt JOIN ds USING (d) GROUP BY 1""")
def ml_01_chronological_split(t: Tables) -> DataFrame:
    return X.splits(targets(t), "d").groupBy("split").agg(F.count("*").alias("n"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))
