"""More queries of ranking: fits, regimes, sensitivity, learned rankers, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C
from bidloom.operators import evaluation as V
from bidloom.operators import casefit as N
from bidloom.operators import features as X
from bidloom.operators import learning as M
from bidloom.operators import pools as L
from bidloom.operators import ranking as R
from bidloom.operators.aggregates import unanimous
from bidloom.plans import casefit as P
from bidloom.plans import cleaning as S
from bidloom.plans import ranking as K
from bidloom.plans.book import Book, Tables
from bidloom.sources.tables import cut

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col
W = Window


# indices over the notices themselves

_CODES = "(SELECT DISTINCT id_award, win_name AS supplier, nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') AS code FROM (SELECT id_award, win_name, cpv AS x FROM can_2017 UNION ALL SELECT id_award, win_name, unnest(string_split(additional_cpvs, '---')) FROM can_2017) WHERE win_name IS NOT NULL)"


@BOOK.query(f"SELECT level, substr(code, 1, level) AS value, supplier, count(*) AS n_matched FROM (SELECT DISTINCT id_award, supplier, level, substr(code, 1, level) AS code FROM {_CODES}, (SELECT unnest([2, 3, 4, 8]) AS level) WHERE length(code) >= level) GROUP BY 1, 2, 3")
def fit_02_category_index(t: Tables) -> DataFrame:
    """Main and additional codes at four levels, each counted once per award."""
    codes = F.concat(F.array("cpv"), F.coalesce(F.split("additional_cpvs", "---"), F.array().cast("array<string>")))
    each = t.can_2017.filter("win_name is not null").select("id_award", c("win_name").alias("supplier"), F.explode(codes).alias("x")).select("id_award", "supplier", C.cpv_digits(c("x")).alias("d"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.when(F.length("d") >= k, F.substring("d", 1, k)).alias("value")) for k in (2, 3, 4, 8)])
    return each.select("id_award", "supplier", F.inline(levels)).filter("value is not null").distinct().groupBy("level", "value", "supplier").agg(F.count("*").alias("n_matched"))


_NUTS = r"upper(regexp_replace(trim(x), '\s+', '', 'g'))"


@BOOK.query(f"""WITH e AS (SELECT id_award, win_name AS supplier, {_NUTS} AS n FROM (SELECT id_award, win_name, unnest(regexp_split_to_array(tal_location_nuts, '[,;|]+')) AS x FROM can_2017 WHERE win_name IS NOT NULL) WHERE regexp_matches({_NUTS}, '^[A-Z]{{2}}[A-Z0-9]{{1,3}}$'))
SELECT level, value, supplier, count(*) AS n_matched FROM (SELECT DISTINCT id_award, supplier, level, substr(n, 1, level) AS value FROM e, (SELECT unnest([2, 3, 4, 5]) AS level) WHERE length(n) >= level) GROUP BY 1, 2, 3""")
def fit_03_region_index(t: Tables) -> DataFrame:
    each = t.can_2017.filter("win_name is not null").select("id_award", c("win_name").alias("supplier"), F.explode(F.split("tal_location_nuts", "[,;|]+")).alias("x")).select("id_award", "supplier", C.nuts_code(c("x")).alias("n"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.when(F.length("n") >= k, F.substring("n", 1, k)).alias("value")) for k in (2, 3, 4, 5)])
    return each.select("id_award", "supplier", F.inline(levels)).filter("value is not null").distinct().groupBy("level", "value", "supplier").agg(F.count("*").alias("n_matched"))


@BOOK.query("SELECT upper(nullif(trim(crit_code), '')) AS crit_code, win_name AS supplier, count(*) AS n FROM can_2017 WHERE nullif(trim(crit_code), '') IS NOT NULL AND win_name IS NOT NULL GROUP BY 1, 2")
def fit_06_criterion_index(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(C.upper_clean(c("crit_code")).alias("crit_code"), c("win_name").alias("supplier")).agg(F.count("*").alias("n")).filter("crit_code is not null and supplier is not null")


@BOOK.query(f"SELECT id_notice_can, CASE WHEN count(DISTINCT crit_code) = 1 THEN max(crit_code) END AS crit_code, CASE WHEN count(DISTINCT top_type) = 1 THEN max(top_type) END AS top_type, round(median({S._NUM.format('number_offers')}), 6) AS offers FROM can_2017 GROUP BY 1")
def fit_08_target_profile(t: Tables) -> DataFrame:
    return t.can_2017.groupBy("id_notice_can").agg(unanimous(c("crit_code")).alias("crit_code"), unanimous(c("top_type")).alias("top_type"), F.round(F.median(C.parse_number(c("number_offers"))), 6).alias("offers"))


_FLAGS = ("b_gpa", "b_eu_funds", "b_on_behalf")


@BOOK.query(" UNION ALL ".join(f"SELECT '{x}' AS field, count(v) AS n_known, count(*) FILTER (WHERE v) AS n_true FROM (SELECT CASE WHEN count(DISTINCT {S._BOOL.format(x)}) = 1 THEN bool_or({S._BOOL.format(x)}) END AS v FROM can_2017 GROUP BY id_notice_can)" for x in _FLAGS))
def fit_09_prevalence(t: Tables) -> DataFrame:
    per = t.can_2017.groupBy("id_notice_can").agg(*[unanimous(C.parse_bool(c(x))).alias(x) for x in _FLAGS])
    return per.unpivot(["id_notice_can"], list(_FLAGS), "field", "value").groupBy("field").agg(F.count("value").alias("n_known"), F.count_if("value").alias("n_true"))


@BOOK.query("SELECT count(*) AS n_targets, count(*) FILTER (WHERE k IS NOT NULL) AS n_seen FROM (SELECT DISTINCT cpv FROM cn_2017 WHERE cpv IS NOT NULL) a LEFT JOIN (SELECT DISTINCT cpv AS k FROM can_2017) b ON a.cpv = b.k")
def fit_10_seen_in_history(t: Tables) -> DataFrame:
    seen = t.can_2017.select(c("cpv").alias("k")).distinct()
    return t.cn_2017.select("cpv").filter("cpv is not null").distinct().join(seen, c("cpv") == c("k"), "left").agg(F.count("*").alias("n_targets"), F.count("k").alias("n_seen"))


@BOOK.query(f"SELECT id_notice_can, max(coalesce({S._NUM.format('award_value_euro_fin_1')}, {S._NUM.format('award_value_euro')})) AS value, CASE WHEN max({S._NUM.format('award_value_euro_fin_1')}) IS NOT NULL THEN 'final' WHEN max({S._NUM.format('award_value_euro')}) IS NOT NULL THEN 'award' ELSE 'none' END AS origin FROM can_2017 GROUP BY 1")
def fs_01_value_source(t: Tables) -> DataFrame:
    fin, award = C.parse_number(c("award_value_euro_fin_1")), C.parse_number(c("award_value_euro"))
    return t.can_2017.groupBy("id_notice_can").agg(F.max(F.coalesce(fin, award)).alias("value"), F.when(F.max(fin).isNotNull(), "final").when(F.max(award).isNotNull(), "award").otherwise("none").alias("origin"))


@BOOK.query(f"SELECT id_notice_can, CASE WHEN min({S._ENTITY.format('win_town')}) = max({S._ENTITY.format('win_town')}) THEN max({S._ENTITY.format('win_town')}) END AS town FROM can_2017 GROUP BY 1")
def er_07_unanimous_town(t: Tables) -> DataFrame:
    return t.can_2017.groupBy("id_notice_can").agg(unanimous(C.normalize_entity(c("win_town"))).alias("town"))


@BOOK.query("SELECT record_id, id_notice_cn_clean FROM cn_notice WHERE is_core_eligible_target OR (is_core_eligible_target IS NULL AND source_row_count = 1)")
def er_06_cohort(t: Tables) -> DataFrame:
    """The flagged records, or by a fallback where there is no flag."""
    return t.cn_notice.filter(F.coalesce("is_core_eligible_target", c("source_row_count") == 1)).select("record_id", "id_notice_cn_clean")


# scores

@BOOK.query(K._AW + K._CTX + K._FOUR + "SELECT c2, s, best, ties FROM (SELECT c2, s, rank() OVER (PARTITION BY c2 ORDER BY round_even(exp, 12) DESC) AS best, count(*) OVER (PARTITION BY c2, round_even(exp, 12)) AS ties FROM f)")
def rnk_15_rounded_ties(t: Tables) -> DataFrame:
    x = K.context_features(t).withColumn("x", R.score12(c("exp")))
    return R.tied_ranks(x, ["c2"], "x").select("c2", "s", "best", "ties")


@BOOK.query(K._AW + "SELECT c2, d, count(*) AS n_cases, count(DISTINCT winner) AS n_winners FROM tgt GROUP BY 1, 2")
def rnk_18_signatures(t: Tables) -> DataFrame:
    """Target cases that every score treats alike."""
    return K.targets(t).groupBy("c2", "d").agg(F.count("*").alias("n_cases"), F.count_distinct("winner").alias("n_winners"))


@BOOK.query(K._AW + ", p AS (SELECT c2, median(q) AS m FROM hist GROUP BY 1) SELECT case_id, round(1 - least(abs(m - q) / 100, 1), 9) AS similarity FROM tgt LEFT JOIN p USING (c2)")
def rnk_11_weight_similarity(t: Tables) -> DataFrame:
    mid = K.history(t).groupBy("c2").agg(F.median("q").alias("m"))
    return K.targets(t).join(mid, "c2", "left").select("case_id", F.round(1 - F.least(F.abs(c("m") - c("q")) / 100, F.lit(1.0)), 9).alias("similarity"))


@BOOK.query(K._AW + K._CTX + K._FOUR + K._GD + "SELECT c2, s, " + K._combined_sql("score", 1 / 3, 1 / 3, 1 / 3) + " FROM gd")
def rnk_13_equal_groups(t: Tables) -> DataFrame:
    d = R.combined(K._grouped(t), dict.fromkeys(("activity", "recency", "special"), 1.0), "score")
    return d.select("c2", "s", F.round("score", 9).alias("score"))


_CTL = """WITH b AS (SELECT p_type AS k, p_partkey AS i, p_retailprice AS price, p_size AS size FROM part WHERE p_size > 5),
v AS (SELECT *, price / sqrt(sum(price * price) OVER (PARTITION BY k)) AS pv, size / sqrt(sum(size * size) OVER (PARTITION BY k)) AS zv FROM b),
d AS (SELECT k, i, pow(0.6 * (pv - min(pv) OVER w), 2) + pow(0.4 * (zv - max(zv) OVER w), 2) AS p2, pow(0.6 * (pv - max(pv) OVER w), 2) + pow(0.4 * (zv - min(zv) OVER w), 2) AS m2 FROM v WINDOW w AS (PARTITION BY k)),
s AS (SELECT k, i, round(CASE WHEN sqrt(p2) + sqrt(m2) > 0 THEN sqrt(m2) / (sqrt(p2) + sqrt(m2)) ELSE 0.5 END, 9) AS score FROM d)
SELECT k, i, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS place FROM s"""


@BOOK.query(_CTL)
def rnk_19_controlled(t: Tables) -> DataFrame:
    """A benefit and a cost, with an exclusion before scoring; ties by id."""
    base = t.part.filter("p_size > 5").select(c("p_type").alias("k"), c("p_partkey").alias("i"), c("p_retailprice").alias("price"), c("p_size").cast("double").alias("size"))
    s = R.topsis(base, ["k"], {"price": 0.6, "size": 0.4}, costs=("price",), name="raw").select("k", "i", F.round("raw", 9).alias("score"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy(F.desc("score"), "i")))


#: The scenarios' weights of gain, lead and record, and whether a record of 0 excludes.
CONTROLLED = {"ECONOMIC": (0.55, 0.35, 0.10, False), "BALANCED": (0.40, 0.30, 0.30, False), "RECORD": (0.25, 0.25, 0.50, False), "CONSTRAINED": (0.45, 0.35, 0.20, True)}
RECORDS = (1.0, 0.5, 0.25, 0.0)


def _controlled_sql(name: str, weights: tuple[float, float, float, bool]) -> str:
    g, l, r, strict = weights
    kept = "WHERE record > 0" if strict else ""
    normed = ", ".join(f"coalesce({x} / nullif(sqrt(sum({x} * {x}) OVER w), 0), 0) AS {x}" for x in ("gain", "lead", "record"))
    plus = f"pow({g} * (gain - max(gain) OVER w), 2) + pow({l} * (lead - min(lead) OVER w), 2) + pow({r} * (record - max(record) OVER w), 2)"
    minus = f"pow({g} * (gain - min(gain) OVER w), 2) + pow({l} * (lead - max(lead) OVER w), 2) + pow({r} * (record - min(record) OVER w), 2)"
    return f"""SELECT '{name}' AS scenario, k, i, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, i) AS place FROM (SELECT k, i, round_even(CASE WHEN sqrt(p2) + sqrt(m2) > 0 THEN sqrt(m2) / (sqrt(p2) + sqrt(m2)) ELSE 0.5 END, 9) AS score FROM (
  SELECT k, i, {plus} AS p2, {minus} AS m2 FROM (SELECT k, i, {normed} FROM c {kept} WINDOW w AS (PARTITION BY k)) WINDOW w AS (PARTITION BY k)))"""


@BOOK.query(f"WITH c AS (SELECT p_type AS k, p_partkey AS i, p_retailprice AS gain, p_size::DOUBLE AS lead, [{', '.join(map(str, RECORDS))}][p_partkey % 4 + 1]::DOUBLE AS record FROM part) " + " UNION ALL ".join(_controlled_sql(n, w) for n, w in CONTROLLED.items()))
def rnk_19_scenarios(t: Tables) -> DataFrame:
    """Two benefits and a cost under four scenarios, one of which excludes before scoring; ties by id."""
    record = F.element_at(F.array(*[F.lit(x) for x in RECORDS]), (c("p_partkey") % 4 + 1).cast("int"))
    base = t.part.select(c("p_type").alias("k"), c("p_partkey").alias("i"), c("p_retailprice").alias("gain"), c("p_size").cast("double").alias("lead"), record.alias("record"))
    out = None
    for name, (g, l, r, strict) in CONTROLLED.items():
        s = R.topsis(base.filter("record > 0") if strict else base, ["k"], {"gain": g, "lead": l, "record": r}, costs=("lead",), name="raw", spread=True)
        s = s.select(F.lit(name).alias("scenario"), "k", "i", F.bround("raw", 9).alias("score"))
        out = s if out is None else out.unionByName(s)
    return out.withColumn("place", F.row_number().over(W.partitionBy("scenario", "k").orderBy(F.desc("score"), "i")))


@BOOK.query(K._AW + K._CTX + "SELECT case_id, count(*) AS pool_size, count(*) FILTER (WHERE ctx.n > o.n) + 1 AS best, count(*) FILTER (WHERE ctx.n = o.n) AS ties FROM tgt JOIN ctx USING (c2) JOIN ctx o ON o.c2 = tgt.c2 AND o.s = tgt.winner GROUP BY 1")
def win_05_winner_rank(t: Tables) -> DataFrame:
    """Each winner's rank by two counts. They depend only on the context and the winner, so they are made once per pair."""
    ranked = R.tied_ranks(K.history(t).groupBy("c2", "s").agg(F.count("*").alias("n")), ["c2"], "n").withColumn("pool_size", F.count("*").over(W.partitionBy("c2")))
    return K.targets(t).select("case_id", "c2", "winner").join(ranked.withColumnRenamed("s", "winner"), ["c2", "winner"]).select("case_id", "pool_size", "best", "ties")


@BOOK.query(K._AW + K._CTX + "SELECT case_id, coalesce(ctx.n, 0) AS support FROM tgt LEFT JOIN ctx ON ctx.c2 = tgt.c2 AND ctx.s = tgt.winner")
def jon_12_sparse_gather(t: Tables) -> DataFrame:
    """A sparse index looked up by key, absent entries as 0."""
    index = X.fit_index(K.history(t), {"c2": "c2"}, "s").select(c("value").alias("c2"), c("supplier").alias("winner"), "n_matched")
    return K.targets(t).join(index, ["c2", "winner"], "left").select("case_id", F.coalesce("n_matched", F.lit(0)).alias("support"))


@BOOK.query(K._AW + K._CTX + "SELECT c2, s FROM (SELECT c2, s, row_number() OVER (PARTITION BY c2 ORDER BY n DESC, s) AS k FROM ctx) WHERE k <= 50")
def srt_04_exact_k(t: Tables) -> DataFrame:
    per = K.history(t).groupBy("c2", "s").agg(F.count("*").alias("n"))
    return per.withColumn("k", F.row_number().over(W.partitionBy("c2").orderBy(F.desc("n"), "s"))).filter("k <= 50").select("c2", "s")


# learned rankers

#: Fixed value: the features of the full model without regime and criteria, fourteen with as many masks.
FOURTEEN = tuple(dict.fromkeys(x for g in N.MODELS["M3_GEO_BUYER"] for x in N.GROUPS[g]))
FEATURES = [*FOURTEEN, *(f"{x}_known" for x in FOURTEEN)]
#: Boosting rounds of the survey (ML-05) and the reference.
ROUNDS = 180


def _split(t: Tables, features: tuple[str, ...] = FOURTEEN) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The rows to train on, written once as fitting reads them again and again; the history and the cases of the later dates."""
    h, cases = P.sides(t)
    dated = X.splits(cases, "d")
    rows = cut(M.training_rows(h, dated.filter("split = 'train'").drop("split"), features))
    return M.weighted(rows), (h, dated.filter("split <> 'train'"))


@BOOK.query(P._matrix_sql() + "SELECT case_id, count(*) AS n, " + ", ".join(f"round(sum(CASE WHEN on_{x} THEN {x} ELSE 0 END), 6) AS {x}, sum(on_{x}::INT)::DOUBLE AS {x}_known" for x in FOURTEEN) + " FROM m GROUP BY 1")
def ml_03_projection(t: Tables) -> DataFrame:
    def sums(pool: L.Pool):
        def one(case: dict) -> list[tuple]:
            each = [pool.feature(f, case) for f in FOURTEEN]
            return [(k, pool.n, *[v.total() if v.on else 0.0 for v in each], *[float(pool.n * v.on) for v in each]) for k in case["case_id"]]

        return one

    rows = L.over_pools(*P.sides(t), sums, "case_id string, n bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    return rows.withColumns({f: F.round(f, 6) for f in FEATURES})


_DAYS = ", ds AS (SELECT d, row_number() OVER (ORDER BY d) / count(*) OVER () AS p FROM (SELECT DISTINCT d FROM t))"


@BOOK.query(P._matrix_sql() + _DAYS + """, x AS (SELECT case_id, m.s, (m.s = m.winner)::INT::DOUBLE AS label, cpv2_experience AS e, bool_or(m.s = m.winner) OVER (PARTITION BY case_id) AS won FROM m JOIN t USING (case_id) JOIN ds USING (d) WHERE p <= 0.6),
y AS (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY e DESC, s) AS hard FROM x WHERE won), z AS (SELECT *, row_number() OVER (PARTITION BY case_id, label, hard <= 5 ORDER BY md5(case_id || '|' || s || '|7'), s) AS any_ FROM y)
, k AS (SELECT case_id, s, label FROM z WHERE label = 1 OR hard <= 5 OR any_ <= 20) SELECT case_id, s, label, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) AS weight FROM k""")
def ml_02_training_rows(t: Tables) -> DataFrame:
    """Winners, hard negatives and random negatives of the training cases."""
    return _split(t, ())[0].select("case_id", "s", "label", "weight")


def _evaluated(scores, later: tuple[DataFrame, DataFrame], method: str) -> DataFrame:
    """Full pools of the validation and test cases, scored and ranked where they lie."""
    ranks = R.case_record(M.pool_ranks(*later, scores))
    return R.summary(ranks.withColumn("method", F.lit(method)), ["method", "split"])


@BOOK.query()
def ml_04_logistic(t: Tables) -> DataFrame:
    """A logistic ranker fitted on the training dates, evaluated on the later dates' full pools."""
    train, later = _split(t)
    return _evaluated(M.logistic_scores(M.fit_logistic(train, FEATURES), FOURTEEN), later, "logistic")


@BOOK.query()
def ml_05_boosted(t: Tables) -> DataFrame:
    """The same with boosted trees."""
    train, later = _split(t)
    return _evaluated(M.boosted_scores(M.fit_boosted(train, FEATURES, rounds=ROUNDS, depth=5), FOURTEEN), later, "boosted")


@BOOK.query(P._matrix_sql() + """, ds AS (SELECT d, row_number() OVER (ORDER BY d) / count(*) OVER () AS p FROM (SELECT DISTINCT d FROM t)), x AS (SELECT CASE WHEN p <= 0.6 THEN 'train' WHEN p <= 0.8 THEN 'validation' ELSE 'test' END AS split, case_id, m.s, m.winner, round_even(m.cpv2_experience, 9) AS score FROM m JOIN t USING (case_id) JOIN ds USING (d)),
o AS (SELECT *, max(score) FILTER (WHERE s = winner) OVER (PARTITION BY case_id) AS own FROM x WHERE split <> 'train'), rec AS (SELECT *, (best + best + ties - 1) / 2.0 AS mid FROM (SELECT split, case_id, count(*) AS pool_size, count(*) FILTER (WHERE score > own) + 1 AS best, count(*) FILTER (WHERE score = own) AS ties FROM o WHERE own IS NOT NULL GROUP BY 1, 2))
SELECT 'experience' AS method, split, """ + P._SUMMARY + " FROM rec GROUP BY split")
def ml_06_full_pools(t: Tables) -> DataFrame:
    """The evaluation of the learned rankers on full pools, for a score that needs no fit. It depends on
    the context and the supplier only, so they are ranked once per context."""
    h, cases = P.sides(t)
    ranked = R.tied_ranks(h.groupBy("c2", c("s").alias("winner")).agg(F.count("*").alias("n")).withColumn("score", F.bround(F.log1p("n"), 9)), ["c2"], "score").withColumn("pool_size", F.count("*").over(W.partitionBy("c2")))
    dated = X.splits(cases.select("case_id", "c2", "winner", "d"), "d").filter("split <> 'train'")
    ranks = R.case_record(dated.join(ranked.select("c2", "winner", "pool_size", "best", "ties"), ["c2", "winner"]))
    return R.summary(ranks.withColumn("method", F.lit("experience")), ["method", "split"])


# scoring of extractions

@BOOK.query("""WITH q AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS g, count(*) FILTER (WHERE o_orderstatus = 'O') AS p, least(count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FILTER (WHERE o_orderstatus = 'O')) AS m FROM orders GROUP BY 1),
r AS (SELECT *, CASE WHEN g = 0 AND p = 0 THEN 1.0 ELSE coalesce(m / nullif(p, 0), 0) END AS pr, CASE WHEN g = 0 AND p = 0 THEN 1.0 ELSE coalesce(m / nullif(g, 0), 0) END AS re FROM q)
SELECT k, round(pr, 9) AS precision, round(re, 9) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 9) AS f1 FROM r""")
def llm_10_packet_metrics(t: Tables) -> DataFrame:
    q = t.orders.groupBy(c("o_custkey").alias("k")).agg(F.count_if(c("o_orderstatus") == "F").alias("g"), F.count_if(c("o_orderstatus") == "O").alias("p"))
    return V.precision_recall(q.withColumn("m", F.least("g", "p")), "m", "g", "p").select("k", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


_BAD = ("guarantee", "certainly", "safe")


@BOOK.query("SELECT item_id, " + " OR ".join(f"contains(lower(item_text), '{w}')" for w in _BAD) + " AS has_forbidden, len(list_filter(['" + "', '".join(_BAD) + "'], lambda w: contains(lower(item_text), w))) AS n_forbidden FROM eval_items")
def llm_11_forbidden_terms(t: Tables) -> DataFrame:
    terms = F.array(*[F.lit(w) for w in _BAD])
    text = F.lower("item_text")
    return t.eval_items.select("item_id", F.exists(terms, lambda w: F.contains(text, w)).alias("has_forbidden"), F.size(F.filter(terms, lambda w: F.contains(text, w))).alias("n_forbidden"))
