"""Case-level ranking over the award notices themselves: the feature matrix, the nested and the
ablated models, the scenarios, and how they compare.

Awards dispatched before ``CUTOFF`` are the history, the others the target cases; a case's pool
are the suppliers with an award in its two-digit category (the primary pool)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C
from bidloom.operators import casefit as M
from bidloom.operators import pools as L
from bidloom.operators import ranking as R
from bidloom.operators.aggregates import unanimous
from bidloom.plans import cleaning as S
from bidloom.plans.book import Book, Tables
from bidloom.sources.tables import cut

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col
W = Window
CUTOFF = date(2017, 7, 1)


def awards(t: Tables) -> DataFrame:
    """One row per award key whose rows agree on supplier and category."""
    rows = t.can_2017.filter("win_name is not null and instr(win_name, '---') = 0").select(
        C.award_key(c("id_notice_can"), c("id_award")).alias("k"), C.supplier_key(*[c(x) for x in ("win_country_code", "win_nationalid", "win_name", "win_town")]).alias("s"), "cpv", "additional_cpvs", "tal_location_nuts",
        C.parse_date(c("dt_dispatch")).alias("d"), C.buyer_key(c("iso_country_code"), c("cae_nationalid"), c("cae_name")).alias("b"), C.upper_clean(c("iso_country_code")).alias("country"),
        *[C.parse_bool(c(x)).alias(x) for x in M.REGIME], C.upper_clean(c("crit_code")).alias("crit"), C.parse_number(c("crit_price_weight")).alias("pw"),
    )
    # keys are nearly unique: rows are sent as they are and sorted once, not summed up before as well
    keyed = rows.filter("k is not null").repartition("k").groupBy("k").agg(
        unanimous(c("s")).alias("s"), unanimous(C.cpv_prefix(c("cpv"), 2)).alias("c2"), F.max("cpv").alias("cpv"), F.max("additional_cpvs").alias("adds"), F.max("tal_location_nuts").alias("nuts"), F.min("d").alias("d"),
        F.max("b").alias("b"), F.max("country").alias("country"), *[unanimous(c(x)).alias(x) for x in M.REGIME], F.max("crit").alias("crit"), F.max("pw").alias("pw"),
    ).filter("s is not null and c2 is not null and d is not null")
    regions = F.filter(F.transform(F.split(F.coalesce("nuts", F.lit("")), "[,;|]+|---"), C.nuts_code), lambda x: x.isNotNull())
    codes = F.regexp_extract_all(F.concat_ws("---", "cpv", "adds"), F.lit(r"(\d{8})"), F.lit(1))
    return keyed.withColumn("codes", F.array_distinct(codes)).withColumn("regions", F.array_distinct(regions)).drop("cpv", "adds", "nuts")


def history(t: Tables) -> DataFrame:
    return awards(t).filter(c("d") < CUTOFF)


def targets(t: Tables) -> DataFrame:
    return M.with_signature(awards(t).filter(c("d") >= CUTOFF).withColumnRenamed("k", "case_id").withColumnRenamed("s", "winner"))


def matrix(t: Tables) -> DataFrame:
    return M.case_matrix(history(t), targets(t))


# the same in SQL

def _unanimous(x: str) -> str:
    return f"CASE WHEN count(DISTINCT {x}) = 1 THEN max({x}) END"


def _aw_sql() -> str:
    flags = ", ".join(f"{S._BOOL.format(x)} AS {x}" for x in M.REGIME)
    kept = ", ".join(f"CASE WHEN count(DISTINCT {x}) = 1 THEN bool_or({x}) END AS {x}" for x in M.REGIME)
    return f"""WITH a0 AS (SELECT {S._CLEAN.format('id_notice_can')} || '||' || {S._CLEAN.format('id_award')} AS k, {S._SUPPLIER} AS s, cpv, additional_cpvs AS adds, tal_location_nuts AS nuts, {S._DATE.format('dt_dispatch')} AS d, {S._BUYER} AS b,
  {S._CTRY.format('iso_country_code')} AS country, {flags}, {S._CTRY.format('crit_code')} AS crit, {S._NUM.format('crit_price_weight')} AS pw, CASE WHEN length({S._CPV}) >= 2 THEN substr({S._CPV}, 1, 2) END AS c2
  FROM can_2017 WHERE win_name IS NOT NULL AND instr(win_name, '---') = 0),
aw AS (SELECT k, {_unanimous('s')} AS s, {_unanimous('c2')} AS c2, list_distinct(regexp_extract_all(concat_ws('---', max(cpv), max(adds)), '\\d{{8}}')) AS codes,
  list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(max(nuts), ''), '[,;|]+|---'), lambda x: upper(regexp_replace(trim(x), '\\s+', '', 'g'))), lambda x: regexp_matches(x, '^[A-Z]{{2}}[A-Z0-9]{{1,3}}$'))) AS regions,
  min(d) AS d, max(b) AS b, max(country) AS country, {kept}, max(crit) AS crit, max(pw) AS pw FROM a0 WHERE k IS NOT NULL GROUP BY k),
ok AS (SELECT * FROM aw WHERE s IS NOT NULL AND c2 IS NOT NULL AND d IS NOT NULL),
h AS (SELECT * FROM ok WHERE d < DATE '{CUTOFF}'), t AS (SELECT * RENAME (k AS case_id, s AS winner) FROM ok WHERE d >= DATE '{CUTOFF}')
"""


def _matrix_sql() -> str:
    def level(f: str, column: str, n: int) -> str:
        cut = f"list_distinct(list_transform(list_filter({column}, lambda x: length(x) >= {n}), lambda x: substr(x, 1, {n})))"
        return f""", i_{f} AS (SELECT v, s, ln(1 + count(*)) AS u FROM (SELECT k, s, unnest({cut}) AS v FROM h) GROUP BY 1, 2),
  q_{f} AS (SELECT case_id, s, sum(u / m) AS x FROM (SELECT case_id, len({cut}) AS m, unnest({cut}) AS v FROM t) JOIN i_{f} USING (v) GROUP BY 1, 2)"""

    regime = " + ".join(f"CASE WHEN t.{x} IS NULL OR coalesce(p.{x}_1 + p.{x}_0, 0) = 0 THEN 0 WHEN t.{x} THEN p.{x}_1::DOUBLE / (p.{x}_1 + p.{x}_0) ELSE p.{x}_0::DOUBLE / (p.{x}_1 + p.{x}_0) END" for x in M.REGIME)
    known = "(" + " + ".join(f"(t.{x} IS NOT NULL)::INT" for x in M.REGIME) + ")"
    value = {
        "cpv2_experience": "ln(1 + x.n)", "buyer_breadth": "ln(1 + x.nb)", "public_activity_recency": "1.0 / (1 + date_diff('day', x.last, t.d))", "context_specialization": "x.n / p.all_n",
        **{f: f"coalesce(q_{f}.x, 0)" for f, _, _ in M.LEVELS},
        "country_fit": "ln(1 + coalesce(ic.n, 0))", "prior_buyer_count": "ln(1 + coalesce(r.n, 0))", "prior_buyer_recency": "CASE WHEN date_diff('day', r.last, t.d) >= 0 THEN 1.0 / (1 + date_diff('day', r.last, t.d)) ELSE 0 END",
        "buyer_relationship_share": "coalesce(r.share, 0)", "regime_match_share": f"CASE WHEN {known} > 0 THEN ({regime}) / {known} ELSE 0 END", "crit_code_fit": "ln(1 + coalesce(ik.n, 0))",
        "price_weight_similarity": "coalesce(1 - least(abs(x.pw - t.pw) / 100, 1.0), 0)",
    }
    on = dict.fromkeys(M.GROUPS["original"], "true") | {f: f"len(list_filter(t.{k}, lambda y: length(y) >= {n})) > 0" for f, k, n in M.LEVELS}
    on |= {"country_fit": "t.country IS NOT NULL", **dict.fromkeys(M.GROUPS["buyer"], "t.b IS NOT NULL"), "regime_match_share": f"{known} > 0", "crit_code_fit": "t.crit IS NOT NULL", "price_weight_similarity": "t.pw IS NOT NULL"}
    counts = ", ".join(f"count(*) FILTER (WHERE {x}) AS {x}_1, count(*) FILTER (WHERE NOT {x}) AS {x}_0" for x in M.REGIME)
    joins = " ".join(f"LEFT JOIN q_{f} ON q_{f}.case_id = t.case_id AND q_{f}.s = x.s" for f, _, _ in M.LEVELS)
    return _aw_sql() + f""", ctx AS (SELECT c2, s, count(*) AS n, count(DISTINCT b) AS nb, max(d) AS last, median(pw) AS pw FROM h GROUP BY 1, 2), p AS (SELECT s, count(*) AS all_n, {counts} FROM h GROUP BY 1),
rel AS (SELECT b, s, count(*) AS n, max(d) AS last, count(*) / sum(count(*)) OVER (PARTITION BY s) AS share FROM h WHERE b IS NOT NULL GROUP BY 1, 2), ic0 AS (SELECT country, s, count(*) AS n FROM h GROUP BY 1, 2), ik0 AS (SELECT crit, s, count(*) AS n FROM h GROUP BY 1, 2)
""" + "".join(level(*x) for x in M.LEVELS) + f""", m AS (SELECT t.case_id, t.winner, x.s, {', '.join(f'({v})::DOUBLE AS {f}' for f, v in value.items())}, {', '.join(f'({v}) AS on_{f}' for f, v in on.items())}
  FROM t JOIN ctx x USING (c2) JOIN p ON p.s = x.s LEFT JOIN rel r ON r.b = t.b AND r.s = x.s LEFT JOIN ic0 ic ON ic.country = t.country AND ic.s = x.s LEFT JOIN ik0 ik ON ik.crit = t.crit AND ik.s = x.s {joins})
"""


def _distances_sql() -> str:
    features = M.FEATURES
    normed = ", ".join(f"coalesce({f} / nullif(sqrt(sum({f} * {f}) OVER w), 0), 0) AS {f}, on_{f} AND sum({f} * {f}) OVER w > 0 AS u_{f}" for f in features)
    sums = []
    for g, columns in M.GROUPS.items():
        size = "(" + " + ".join(f"u_{f}::INT" for f in columns) + ")"
        for name, side in (("plus", "max"), ("minus", "min")):
            total = " + ".join(f"CASE WHEN u_{f} THEN pow({f} - {side}({f}) OVER w, 2) ELSE 0 END" for f in columns)
            sums.append(f"CASE WHEN {size} > 0 THEN ({total}) / ({size} * {size}) ELSE 0 END AS {g}_{name}")
        sums.append(f"{size} > 0 AS {g}_on")
    return _matrix_sql() + f""", v AS (SELECT case_id, winner, s, {normed} FROM m WINDOW w AS (PARTITION BY case_id)),
g AS (SELECT case_id, winner, s, {', '.join(sums)} FROM v WINDOW w AS (PARTITION BY case_id))
"""


def _score_sql(weights: dict[str, float]) -> str:
    total = "(" + " + ".join(f"CASE WHEN {g}_on THEN {w!r} ELSE 0 END" for g, w in weights.items()) + ")"
    sides = []
    for name in ("plus", "minus"):
        sides.append("sqrt(" + " + ".join(f"CASE WHEN {g}_on THEN pow({w!r} / {total}, 2) * {g}_{name} ELSE 0 END" for g, w in weights.items()) + ")")
    p, m = sides
    return f"round_even(CASE WHEN {p} + {m} > 0 THEN {m} / ({p} + {m}) ELSE 0.5 END, 9)"


def _ranks_sql(models: dict[str, dict[str, float]]) -> str:
    scores = ", ".join(f"{_score_sql(w)} AS {m}" for m, w in models.items())
    each = " UNION ALL ".join(
        f"SELECT case_id, '{m}' AS model, count(*) AS pool_size, count(*) FILTER (WHERE x > own) + 1 AS best, count(*) FILTER (WHERE x = own) AS ties FROM (SELECT case_id, {m} AS x, max({m}) FILTER (WHERE s = winner) OVER (PARTITION BY case_id) AS own FROM sc) WHERE own IS NOT NULL GROUP BY 1" for m in models)
    return _distances_sql() + f", sc AS (SELECT case_id, winner, s, {scores} FROM g), rk AS (SELECT *, (best + best + ties - 1) / 2.0 AS mid FROM ({each}))\n"


def sides(t: Tables, groups: Iterable[str] = M.GROUPS) -> tuple[DataFrame, DataFrame]:
    """History and targets over awards that are written once: they are read again and again. What only groups other than ``groups`` need is null."""
    every = awards(t)
    unused = [x for g, columns in (("regime", M.REGIME), ("criteria", ("crit", "pw"))) if g not in groups for x in columns]
    every = cut(every.withColumns({x: F.lit(None).cast(every.schema[x].dataType) for x in unused}))
    return every.filter(c("d") < CUTOFF), M.with_signature(every.filter(c("d") >= CUTOFF).withColumnRenamed("k", "case_id").withColumnRenamed("s", "winner"))


def winner_records(t: Tables, models: dict[str, dict[str, float]]) -> DataFrame:
    """The winner's rank by every model, per case. The pools are ranked where they lie: no row is made for a pair."""
    ranks = L.over_pools(*sides(t, {g for w in models.values() for g in w}), lambda pool: L.Scorer(pool, models).ranks, "case_id string, pool_size bigint, best array<bigint>, ties array<bigint>", winners_only=True)
    each = F.arrays_zip(F.array(*[F.lit(m) for m in models]).alias("model"), c("best").alias("best"), c("ties").alias("ties"))
    return R.case_record(ranks.select("case_id", "pool_size", F.inline(each)))


NESTED = {m: M.equal_weights(g) for m, g in M.MODELS.items()}
ABLATED = {m: M.equal_weights(g) for m, g in M.ABLATIONS.items()}
_SUMMARY = """count(*) AS n_cases, """ + ", ".join(f"round(100 * avg((mid <= {k})::INT), 6) AS w_at_{k}" for k in R.CUTS) + """, round(avg(1.0 / mid), 9) AS mrr,
  round(avg(CASE WHEN pool_size <= 1 THEN 1.0 ELSE 1.0 - (mid - 1) / (pool_size - 1) END), 9) AS mean_percentile, median(mid) AS median_rank, round(avg(ties), 6) AS mean_ties, round(avg(pool_size), 6) AS mean_pool"""


@BOOK.query(_matrix_sql() + "SELECT case_id, count(*) AS pool_size, " + ", ".join(f"bool_or(on_{f}) AS on_{f}, round(sum({f}), 6) AS {f}" for f in M.FEATURES) + " FROM m GROUP BY 1")
def rnk_07_case_matrix(t: Tables) -> DataFrame:
    """The whole matrix, summed up per case."""
    kinds = ", ".join(f"on_{f} boolean, {f} double" for f in M.FEATURES)

    def sums(pool: L.Pool):
        def one(case: dict) -> list[tuple]:
            each = [x for f in M.FEATURES for v in (pool.feature(f, case),) for x in (bool(v.on), v.total())]
            return [(k, pool.n, *each) for k in case["case_id"]]

        return one

    return L.over_pools(*sides(t), sums, f"case_id string, pool_size bigint, {kinds}").withColumns({f: F.round(f, 6) for f in M.FEATURES})


@BOOK.query(_matrix_sql() + "SELECT case_id, " + ", ".join(f"round({f}, 9) AS {f}" for f in M.FEATURES) + " FROM m WHERE s = winner")
def rnk_07_winner_features(t: Tables) -> DataFrame:
    """The winners' own rows of it."""
    def own(pool: L.Pool):
        def one(case: dict) -> list[tuple]:
            each = [pool.feature(f, case) for f in M.FEATURES]
            return [(k, *[v.value_at(s) for v in each]) for k, s in zip(case["case_id"], case["win"])]

        return one

    rows = L.over_pools(*sides(t), own, "case_id string, " + ", ".join(f"{f} double" for f in M.FEATURES), winners_only=True)
    return rows.select("case_id", *[F.round(f, 9).alias(f) for f in M.FEATURES])


@BOOK.query(_ranks_sql(NESTED) + "SELECT case_id, model, pool_size, best, ties FROM rk")
def rnk_16_nested_ranks(t: Tables) -> DataFrame:
    """The winner's rank by each of the seven nested models."""
    return winner_records(t, NESTED).select("case_id", "model", "pool_size", "best", "ties")


@BOOK.query(_ranks_sql(NESTED) + f"SELECT model, {_SUMMARY} FROM rk GROUP BY 1")
def evl_01_nested_summary(t: Tables) -> DataFrame:
    return R.summary(winner_records(t, NESTED), ["model"])


@BOOK.query(_ranks_sql(ABLATED) + f"SELECT model, {_SUMMARY} FROM rk GROUP BY 1")
def evl_11_ablations(t: Tables) -> DataFrame:
    """The ten models that leave groups of features out."""
    return R.summary(winner_records(t, ABLATED), ["model"])


@BOOK.query(_ranks_sql(M.SCENARIOS) + f"SELECT model, {_SUMMARY} FROM rk GROUP BY 1")
def rnk_14_scenario_summary(t: Tables) -> DataFrame:
    """Scenarios weigh the groups; weights are shared out over the groups that are on."""
    return R.summary(winner_records(t, M.SCENARIOS), ["model"])


_TOP = "(SELECT case_id, s FROM (SELECT case_id, s, row_number() OVER (PARTITION BY case_id ORDER BY {0} DESC, s) AS k FROM sc) WHERE k <= {1})"
_STABLE = _ranks_sql(M.SCENARIOS) + ", mr AS (SELECT case_id, " + ", ".join(f"(2 * rank() OVER (PARTITION BY case_id ORDER BY {m}) + count(*) OVER (PARTITION BY case_id, {m}) - 1) / 2.0 AS r_{m}, {m}" for m in M.SCENARIOS) + " FROM sc)"
_CORR = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN corr({0}, {1}) WHEN stddev_pop({0}) > 0 OR stddev_pop({1}) > 0 THEN 0 ELSE 1 END"


@BOOK.query(_STABLE + " SELECT model, round(avg(pearson), 5) AS pearson, round(avg(spearman), 5) AS spearman, round(avg(o10), 5) AS overlap_10, round(avg(o50), 5) AS overlap_50, count(*) AS n_cases FROM (" + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT case_id, '{m}' AS model, {_CORR.format('BALANCED', m)} AS pearson, {_CORR.format('r_BALANCED', 'r_' + m)} AS spearman FROM mr GROUP BY 1)
    JOIN (SELECT case_id, count(b.s) / count(*) AS o10 FROM {_TOP.format('BALANCED', 10)} a LEFT JOIN {_TOP.format(m, 10)} b USING (case_id, s) GROUP BY 1) USING (case_id)
    JOIN (SELECT case_id, count(b.s) / count(*) AS o50 FROM {_TOP.format('BALANCED', 50)} a LEFT JOIN {_TOP.format(m, 50)} b USING (case_id, s) GROUP BY 1) USING (case_id)""" for m in M.SCENARIOS if m != "BALANCED") + ") GROUP BY 1")
def evl_09_scenario_stability(t: Tables) -> DataFrame:
    """Each scenario against the balanced one: correlation of scores and of ranks, and what their top lists share; means over cases."""
    names = list(M.SCENARIOS)

    def stability(pool: L.Pool):
        scorer = L.Scorer(pool, M.SCENARIOS)

        def one(case: dict) -> list[tuple]:
            x = scorer.scores(case)
            ranks = [L.mid_ranks(s) for s in x]
            tops = [[L.top(s, n) for n in (10, 50)] for s in x]
            each = [(L.correlation(x[0], x[i]), L.correlation(ranks[0], ranks[i]), *[len(np.intersect1d(a, b)) / len(a) for a, b in zip(tops[0], tops[i])]) for i in range(1, len(names))]
            return [(m, len(case["case_id"]), *e) for m, e in zip(names[1:], each)]

        return one

    rows = L.over_pools(*sides(t), stability, "model string, k bigint, pearson double, spearman double, o10 double, o50 double")
    mean = lambda x, name: F.round(F.sum(c(x) * c("k")) / F.sum("k"), 5).alias(name)
    return rows.groupBy("model").agg(mean("pearson", "pearson"), mean("spearman", "spearman"), mean("o10", "overlap_10"), mean("o50", "overlap_50"), F.sum("k").alias("n_cases"))


_FOCUS = {m: {g: 1.0} for m, g in M.FOCUS.items()}


@BOOK.query(_ranks_sql(M.SCENARIOS | {"F_" + m: w for m, w in _FOCUS.items()}) + " SELECT model, count(*) AS n_cases, round(avg(enter), 6) AS entering, round(avg(leave), 6) AS leaving, round(avg(enter - leave), 6) AS response FROM (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, case_id, avg(F_{m}) FILTER (WHERE kb > 10 AND km <= 10) AS enter, avg(F_{m}) FILTER (WHERE kb <= 10 AND km > 10) AS leave FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY BALANCED DESC, s) AS kb, row_number() OVER (PARTITION BY case_id ORDER BY {m} DESC, s) AS km FROM sc) GROUP BY 2""" for m in M.FOCUS) + ") WHERE enter IS NOT NULL AND leave IS NOT NULL GROUP BY 1")
def evl_10_focus_response(t: Tables) -> DataFrame:
    """Whether the suppliers that enter a scenario's top ten fit its focus group better than those that leave."""
    models = M.SCENARIOS | {"F_" + m: w for m, w in _FOCUS.items()}
    place = {m: i for i, m in enumerate(models)}

    def response(pool: L.Pool):
        scorer = L.Scorer(pool, models)

        def one(case: dict) -> list[tuple]:
            x = scorer.scores(case)
            out, base = [], L.top(x[place["BALANCED"]], 10)
            for m in M.FOCUS:
                mine = L.top(x[place[m]], 10)
                enter, leave = np.setdiff1d(mine, base), np.setdiff1d(base, mine)
                if len(enter) and len(leave):
                    focus = x[place["F_" + m]]
                    out.append((m, len(case["case_id"]), float(focus[enter].mean()), float(focus[leave].mean())))
            return out

        return one

    rows = L.over_pools(*sides(t), response, "model string, k bigint, enter double, leave double")
    mean = lambda x, name: F.round(F.sum(x * c("k")) / F.sum("k"), 6).alias(name)
    return rows.groupBy("model").agg(F.sum("k").alias("n_cases"), mean(c("enter"), "entering"), mean(c("leave"), "leaving"), mean(c("enter") - c("leave"), "response"))


_BUYER = M.GROUPS["buyer"]
#: How many cases of a buyer and context are joined to its suppliers in one task.
PIECE = 1000


@BOOK.query(_matrix_sql() + "SELECT case_id, s, " + ", ".join(f"round({f}, 9) AS {f}" for f in _BUYER) + " FROM m WHERE prior_buyer_count > 0")
def rnk_09_buyer_features(t: Tables) -> DataFrame:
    """The relation of a case's buyer to the suppliers it knows; for all others the three are 0. Only
    the pairs that have one are made, after the last exchange: what is sent is a buyer's suppliers and
    its cases by day, so a value is computed once for a supplier and a day. Of a context with many
    cases of the buyer, each ``PIECE`` of them in the order of days meet a copy of the suppliers."""
    every = cut(awards(t).select("k", "s", "c2", "d", "b"))
    h, cases = every.filter(c("d") < CUTOFF), every.filter((c("d") >= CUTOFF) & c("b").isNotNull())
    own = h.repartition("s")  # what follows is grouped and joined where it lies
    context = own.groupBy("s").agg(F.collect_set("c2").alias("c2s"))
    relation = own.filter("b is not null").groupBy("s", "b").agg(F.count("*").alias("n"), F.max("d").alias("last")).withColumn("buyer_relationship_share", c("n") / F.sum("n").over(W.partitionBy("s")))
    asked = cases.groupBy("b", "c2").agg(F.count("*").alias("m")).groupBy("b").agg(F.collect_list(F.struct("c2", "m")).alias("asked"))  # 100 contexts at most
    known = relation.join(context, "s").join(asked, "b").withColumn("prior_buyer_count", F.log1p("n"))
    known = known.select("b", "s", "last", *[F.round(f, 9).alias(f) for f in ("prior_buyer_count", "buyer_relationship_share")], F.inline(F.filter("asked", lambda x: F.array_contains("c2s", x["c2"]))))
    known = known.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((c("m") - 1) / PIECE)))).drop("m")
    days = cases.withColumn("piece", F.floor((F.row_number().over(W.partitionBy("b", "c2").orderBy("d", "k")) - 1) / PIECE)).groupBy("b", "c2", "piece", "d").agg(F.collect_list("k").alias("ks"))
    tasks = max(48, 8 * t.spark.sparkContext.defaultParallelism)
    known, days = [x.repartition(tasks, "b", "c2", "piece") for x in (known, days)]
    gap = F.datediff("d", "last")
    x = known.join(days, ["b", "c2", "piece"]).withColumn("prior_buyer_recency", F.round(F.when(gap >= 0, 1.0 / (1 + gap)).otherwise(0.0), 9))
    return x.select(F.explode("ks").alias("case_id"), "s", *_BUYER)


@BOOK.query(_matrix_sql() + "SELECT case_id, bool_or(on_regime_match_share) AS active, count(*) FILTER (WHERE regime_match_share > 0) AS n_known, round(sum(regime_match_share), 6) AS total, round(max(regime_match_share), 9) AS most FROM m GROUP BY 1")
def rnk_10_regime_share(t: Tables) -> DataFrame:
    """How far the suppliers' histories agree with a case's flags, over the flags that it knows."""
    def shares(pool: L.Pool):
        def one(case: dict) -> list[tuple]:
            v = pool.feature("regime_match_share", case)
            return [(k, bool(v.on), int((v.values > 0).sum()), v.total(), float(v.values.max())) for k in case["case_id"]]

        return one

    rows = L.over_pools(*sides(t), shares, "case_id string, active boolean, n_known bigint, total double, most double")
    return rows.withColumns({"total": F.round("total", 6), "most": F.round("most", 9)})


@BOOK.query(_distances_sql() + "SELECT case_id, " + ", ".join(f"bool_or({g}_on) AS {g}_on, round(sum({g}_plus), 8) AS {g}_plus, round(sum({g}_minus), 8) AS {g}_minus" for g in M.GROUPS) + " FROM g GROUP BY 1")
def rnk_12_masked_distances(t: Tables) -> DataFrame:
    """The groups' distances with criteria switched off where the case lacks them, summed up per case."""
    def sums(pool: L.Pool):
        def one(case: dict) -> list[tuple]:
            each = []
            for g in M.GROUPS:
                d = pool.group(g, case)
                each += [False, 0.0, 0.0] if d is None else [True, float(d[0].sum()), float(d[1].sum())]
            return [(k, *each) for k in case["case_id"]]

        return one

    rows = L.over_pools(*sides(t), sums, "case_id string, " + ", ".join(f"{g}_on boolean, {g}_plus double, {g}_minus double" for g in M.GROUPS))
    return rows.withColumns({x: F.round(x, 8) for g in M.GROUPS for x in (f"{g}_plus", f"{g}_minus")})


_SINGLE = {g: {g: 1.0} for g in M.GROUPS}


@BOOK.query(_ranks_sql({f"ONLY_{g}": w for g, w in _SINGLE.items()}) + f"SELECT model, {_SUMMARY} FROM rk GROUP BY 1")
def rnk_14_single_groups(t: Tables) -> DataFrame:
    """Every group by itself."""
    return R.summary(winner_records(t, {f"ONLY_{g}": w for g, w in _SINGLE.items()}), ["model"])


_CHECKS = ("n_cases", "n_history", "late_history", "repeated_cases", "negative_features", "shares_above_one", "masked_but_positive", "cases_without_pool", "winners_in_pool")


@BOOK.query(_matrix_sql() + ", per AS (SELECT t.case_id, count(m.s) AS n, bool_or(m.s = t.winner) AS won FROM t LEFT JOIN m USING (case_id) GROUP BY 1) SELECT unnest(['" + "', '".join(_CHECKS) + "']) AS metric, unnest([(SELECT count(*) FROM t), (SELECT count(*) FROM h), (SELECT count(*) FROM h WHERE d >= (SELECT min(d) FROM t)), (SELECT count(*) - count(DISTINCT case_id) FROM t), (SELECT count(*) FROM m WHERE least(" + ", ".join(M.FEATURES) + ") < 0), (SELECT count(*) FROM m WHERE greatest(context_specialization, buyer_relationship_share, regime_match_share) > 1), (SELECT count(*) FROM m WHERE " + " OR ".join(f"NOT on_{f} AND {f} > 0" for f in M.FEATURES) + "), (SELECT count(*) FROM per WHERE n = 0), (SELECT count(*) FROM per WHERE won)])::DOUBLE AS value")
def evl_12_checks(t: Tables) -> DataFrame:
    """A ledger of validations of the whole experiment: each counts what must not be, or what there is."""
    shares = ("context_specialization", "buyer_relationship_share", "regime_match_share")

    def ledger(pool: L.Pool):
        def one(case: dict) -> list[tuple]:
            each = {f: pool.feature(f, case) for f in M.FEATURES}
            bad = pool.any_of((v, v.values < 0) for v in each.values()), pool.any_of((each[f], each[f].values > 1) for f in shares), pool.any_of((v, v.values > 0) for v in each.values() if not v.on)
            return [(k, *bad, s is not None) for k, s in zip(case["case_id"], case["win"])]

        return one

    h, cases = sides(t)
    rows = L.over_pools(h, cases, ledger, "case_id string, negative_features bigint, shares_above_one bigint, masked_but_positive bigint, won boolean")
    first = cases.agg(F.min("d")).scalar()
    found = rows.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(x) for x in ("negative_features", "shares_above_one", "masked_but_positive")], F.count_if("won").cast("double").alias("winners_in_pool"))
    empty = cases.join(h.select("c2").distinct(), "c2", "left_anti").agg(F.count("*").cast("double").alias("cases_without_pool"))
    there = cases.agg(F.count("*").cast("double").alias("n_cases"), (F.count("*") - F.count_distinct("case_id")).cast("double").alias("repeated_cases"))
    old = h.agg(F.count("*").cast("double").alias("n_history"), F.count_if(c("d") >= first).cast("double").alias("late_history"))
    long = [x.unpivot([], x.columns, "metric", "value") for x in (there, found, empty, old)]
    return long[0].unionByName(long[1]).unionByName(long[2]).unionByName(long[3])
