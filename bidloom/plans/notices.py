"""Feature store, fit indices, target profiles and audits over the award and contract notices themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C
from bidloom.operators import features as X
from bidloom.operators.aggregates import unanimous
from bidloom.plans import cleaning as S
from bidloom.plans import entities as E
from bidloom.plans.book import Book, Tables
from bidloom.plans.casefit import CUTOFF

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col
W = Window
#: The flags of a procedure's regime.
FLAGS = ("b_fra_agreement", "b_dyn_purch_syst", "b_gpa", "b_eu_funds", "b_accelerated", "b_electronic_auction", "b_on_behalf", "b_involves_joint_procurement", "b_awarded_by_central_body")
TEXTS = {"contract_type": "type_of_contract", "activity": "main_activity", "authority": "cae_type", "procedure": "top_type"}
VALUES = ("award_value_euro_fin_1", "award_value_euro", "value_euro")
LEVELS = {"CPV2": "c2", "CPV3": "c3", "CPV4": "c4"}


def awards(t: Tables) -> DataFrame:
    """One row per award key whose rows agree on supplier and category, dispatched before the cutoff."""
    win = [c(x) for x in ("win_country_code", "win_nationalid", "win_name", "win_town")]
    rows = t.can_2017.filter("win_name is not null and instr(win_name, '---') = 0").select(
        C.award_key(c("id_notice_can"), c("id_award")).alias("k"), C.supplier_key(*win).alias("s"), C.cpv_digits(c("cpv")).alias("cpv"), C.parse_date(c("dt_dispatch")).alias("d"), C.parse_date(c("dt_award")).alias("ad"),
        C.buyer_key(c("iso_country_code"), c("cae_nationalid"), c("cae_name")).alias("b"), C.upper_clean(c("iso_country_code")).alias("country"), C.iso2(c("win_country_code")).alias("wc"), C.first_number(*map(c, VALUES)).alias("v"),
        C.parse_number(c("number_offers")).alias("offers"), *[C.upper_clean(c(x)).alias(n) for n, x in TEXTS.items()], *[C.parse_bool(c(x)).alias(x) for x in FLAGS],
    )
    keyed = rows.filter("k is not null").groupBy("k").agg(
        unanimous(c("s")).alias("s"), unanimous(F.substring("cpv", 1, 2)).alias("c2"), F.max("cpv").alias("cpv"), F.min("d").alias("d"), F.max("ad").alias("ad"), *[F.max(x).alias(x) for x in ("b", "country", "wc", "v", "offers", *TEXTS)], *[unanimous(c(x)).alias(x) for x in FLAGS],
    )
    kept = keyed.filter((F.length("c2") == 2) & c("s").isNotNull() & (c("d") < CUTOFF))
    return kept.withColumn("c3", F.when(F.length("cpv") >= 3, F.substring("cpv", 1, 3))).withColumn("c4", F.when(F.length("cpv") >= 4, F.substring("cpv", 1, 4)))


def _one(x: str) -> str:
    return f"CASE WHEN count(DISTINCT {x}) = 1 THEN max({x}) END"


_A = f"""WITH a0 AS (SELECT {S._CLEAN.format('id_notice_can')} || '||' || {S._CLEAN.format('id_award')} AS k, {S._SUPPLIER} AS s, {S._CPV} AS cpv, {S._DATE.format('dt_dispatch')} AS d, {S._DATE.format('dt_award')} AS ad, {S._BUYER} AS b,
  {S._CTRY.format('iso_country_code')} AS country, {S._ISO.format('win_country_code')} AS wc, coalesce({', '.join(S._NUM.format(x) for x in VALUES)}) AS v, {S._NUM.format('number_offers')} AS offers,
  {', '.join(f"{S._CTRY.format(x)} AS {n}" for n, x in TEXTS.items())}, {', '.join(f"{S._BOOL.format(x)} AS {x}" for x in FLAGS)} FROM can_2017 WHERE win_name IS NOT NULL AND instr(win_name, '---') = 0),
a1 AS (SELECT k, {_one('s')} AS s, {_one('substr(cpv, 1, 2)')} AS c2, max(cpv) AS cpv, min(d) AS d, max(ad) AS ad, {', '.join(f'max({x}) AS {x}' for x in ('b', 'country', 'wc', 'v', 'offers', *TEXTS))},
  {', '.join(f'CASE WHEN count(DISTINCT {x}) = 1 THEN bool_or({x}) END AS {x}' for x in FLAGS)} FROM a0 WHERE k IS NOT NULL GROUP BY k),
a AS (SELECT *, CASE WHEN length(cpv) >= 3 THEN substr(cpv, 1, 3) END AS c3, CASE WHEN length(cpv) >= 4 THEN substr(cpv, 1, 4) END AS c4 FROM a1 WHERE length(c2) = 2 AND s IS NOT NULL AND d < DATE '{CUTOFF}')
"""


@BOOK.query(_A + """, l AS (SELECT 'CPV2' AS level, c2 AS context, * FROM a UNION ALL SELECT 'CPV3', c3, * FROM a WHERE c3 IS NOT NULL UNION ALL SELECT 'CPV4', c4, * FROM a WHERE c4 IS NOT NULL), g AS (SELECT s, count(*) AS gn, sum(v) AS gv FROM a GROUP BY 1),
bc AS (SELECT level, context, s, sum(n) AS n_known_buyer, count(*) AS n_buyers, sum(n * n) / pow(sum(n), 2) AS hhi FROM (SELECT level, context, s, b, count(*)::DOUBLE AS n FROM l WHERE b IS NOT NULL GROUP BY ALL) GROUP BY ALL),
f AS (SELECT level, context, s, count(*) AS n_awards, count(v) AS n_value, sum(v) AS value_sum, median(v) AS value_median, avg(v) AS value_mean, count(offers) AS n_offers, median(offers) AS offers_median, count(country <> wc) AS n_comparable, avg((country <> wc)::INT) AS cross_share,
  min(ad) AS first_award, max(ad) AS last_award, min(d) AS first_dispatch, max(d) AS last_dispatch FROM l GROUP BY ALL)
SELECT level, context, s AS supplier, n_awards, n_value, round(value_sum, 2) AS value_sum, round(value_median, 4) AS value_median, round(value_mean, 4) AS value_mean, coalesce(n_buyers, 0) AS n_buyers, n_known_buyer, round(hhi, 9) AS hhi, n_offers, offers_median, n_comparable, round(cross_share, 9) AS cross_share,
  first_award, last_award, first_dispatch, last_dispatch, round(n_awards / gn, 9) AS share_awards, round(value_sum / nullif(gv, 0), 9) AS share_value FROM f JOIN g USING (s) LEFT JOIN bc USING (level, context, s)""")
def fs_03_levels(t: Tables) -> DataFrame:
    """Suppliers in their contexts at three levels: awards, values, buyers and their concentration, offers, cross-border share, dates, shares of the supplier's own."""
    a = awards(t)
    long = X.contexts(a, LEVELS)
    cross = (c("country") != c("wc")).cast("double")
    # buyers first: one row per buyer carries the sums on, so a hot supplier is combined map-side
    per = long.filter("b is not null").groupBy("level", "context", "s", "b").agg(F.count("*").cast("double").alias("n")).groupBy("level", "context", "s").agg(F.sum("n").alias("n_known_buyer"), F.count("*").alias("n_buyers"), (F.sum(c("n") * c("n")) / F.pow(F.sum("n"), F.lit(2))).alias("hhi"))
    wide = long.groupBy("level", "context", "s").agg(
        F.count("*").alias("n_awards"), F.count("v").alias("n_value"), F.sum("v").alias("value_sum"), F.median("v").alias("value_median"), F.avg("v").alias("value_mean"), F.count("offers").alias("n_offers"), F.median("offers").alias("offers_median"),
        F.count(cross).alias("n_comparable"), F.avg(cross).alias("cross_share"), F.min("ad").alias("first_award"), F.max("ad").alias("last_award"), F.min("d").alias("first_dispatch"), F.max("d").alias("last_dispatch"),
    )
    whole = a.groupBy("s").agg(F.count("*").alias("gn"), F.sum("v").alias("gv"))
    x = wide.join(whole, "s").join(per, ["level", "context", "s"], "left")
    return x.select(
        "level", "context", c("s").alias("supplier"), "n_awards", "n_value", F.round("value_sum", 2).alias("value_sum"), F.round("value_median", 4).alias("value_median"), F.round("value_mean", 4).alias("value_mean"), F.coalesce("n_buyers", F.lit(0)).alias("n_buyers"), "n_known_buyer",
        F.round("hhi", 9).alias("hhi"), "n_offers", "offers_median", "n_comparable", F.round("cross_share", 9).alias("cross_share"), "first_award", "last_award", "first_dispatch", "last_dispatch", F.round(c("n_awards") / c("gn"), 9).alias("share_awards"),
        F.round(c("value_sum") / F.nullif("gv", F.lit(0.0)), 9).alias("share_value"),
    )


_BASE = ("k", "s", "c2", "c3", "c4", "d", "ad", "b", "country", "wc", "v", "offers")


@BOOK.query(_A + f"SELECT {', '.join(_BASE)}, country <> wc AS cross_border FROM a")
def fs_01_award_base(t: Tables) -> DataFrame:
    """The history as analysed: one row per award with supplier, categories, dates, buyer, preferred value, offers."""
    return awards(t).select(*_BASE, (c("country") != c("wc")).alias("cross_border"))


@BOOK.query(_A + " SELECT level, count(*) AS n_contexts, sum(n) AS n_awards, max(n) AS most_awards, round(avg(m), 6) AS mean_suppliers, median(m) AS median_suppliers FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS level, {v} AS x, count(*) AS n, count(DISTINCT s) AS m FROM a WHERE {v} IS NOT NULL GROUP BY {v}" for k, v in LEVELS.items()) + ") GROUP BY 1")
def fs_06_context_summary(t: Tables) -> DataFrame:
    per = X.contexts(awards(t), LEVELS).groupBy("level", "context").agg(F.count("*").alias("n"), F.count_distinct("s").alias("m"))
    return per.groupBy("level").agg(F.count("*").alias("n_contexts"), F.sum("n").alias("n_awards"), F.max("n").alias("most_awards"), F.round(F.avg("m"), 6).alias("mean_suppliers"), F.median("m").alias("median_suppliers"))


_DIMS = {"cpv3": "c3", "cpv4": "c4", "buyer": "b", "country": "country", **{n: n for n in TEXTS}}


@BOOK.query(_A + "SELECT dimension, value, s AS supplier, count(*) AS n_matched FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value, s FROM a" for k, v in _DIMS.items()) + ") WHERE value IS NOT NULL GROUP BY ALL")
def fit_01_eight_indices(t: Tables) -> DataFrame:
    """Eight one-dimensional indices in one shuffle."""
    return X.fit_index(awards(t), _DIMS, "s")


@BOOK.query(_A + "SELECT dimension, value, s AS supplier, count(*) AS n_matched FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS dimension, CAST({x} AS VARCHAR) AS value, s FROM a" for x in FLAGS) + ") WHERE value IS NOT NULL GROUP BY ALL")
def fit_05_nine_flags(t: Tables) -> DataFrame:
    return X.fit_index(awards(t), {x: x for x in FLAGS}, "s")


_NUMBERS = {"offers": "number_offers", "lots": "lots_number", "price_weight": "crit_price_weight", "value": "value_euro"}


@BOOK.query(f"""WITH r AS (SELECT DISTINCT {S._CLEAN.format('id_notice_can')} AS k, {S._CLEAN.format('id_award')} AS w, CASE WHEN length({S._CPV}) >= 2 THEN substr({S._CPV}, 1, 2) END AS c2, {', '.join(f'{S._NUM.format(x)} AS {n}' for n, x in _NUMBERS.items())}, {', '.join(f'{S._BOOL.format(x)} AS {x}' for x in FLAGS)} FROM can_2017)
SELECT c2, count(*) AS n_rows, """ + ", ".join(f"count({n}) AS {n}_n, round(quantile_cont({n}, 0.5), 6) AS {n}_p50, round(quantile_cont({n}, 0.75), 6) AS {n}_p75, round(quantile_cont({n}, 0.9), 6) AS {n}_p90" for n in _NUMBERS) + ", " + ", ".join(f"count({x}) AS {x}_n, round(avg({x}::INT), 9) AS {x}_share" for x in FLAGS) + " FROM r WHERE c2 IS NOT NULL GROUP BY 1")
def fit_07_category_descriptors(t: Tables) -> DataFrame:
    """Per category the distribution of numbers and the prevalence of flags, over distinct whole rows."""
    rows = t.can_2017.select(C.clean_text(c("id_notice_can")).alias("k"), C.clean_text(c("id_award")).alias("w"), C.cpv_prefix(c("cpv"), 2).alias("c2"), *[C.parse_number(c(x)).alias(n) for n, x in _NUMBERS.items()], *[C.parse_bool(c(x)).alias(x) for x in FLAGS]).distinct()
    return X.descriptors(rows.filter("c2 is not null"), "c2", {n: c(n) for n in _NUMBERS}, {x: c(x) for x in FLAGS})


_T_NUMBERS = {"lots": "lots_number", "duration": "duration", "price_weight": "crit_price_weight", "operators": "env_operators", "operators_min": "env_min_operators", "operators_max": "env_max_operators"}
_T_TEXTS = {"lots_submission": "lots_submission", "crit_code": "crit_code"}
_T_FLAGS = (*FLAGS[:8], "b_variants", "b_options", "b_renewals", "b_recurrent_procurement")
_T_VALUES = ("value_euro", "value_euro_fin_1", "value_euro_fin_2")
_CODE = f"CASE WHEN length({S._CPV}) = 8 THEN {S._CPV} END"


@BOOK.query(f"""SELECT {S._CLEAN.format('id_notice_cn')} AS case_id, min({S._DATE.format('dt_dispatch')}) AS dispatch, max({_CODE}) AS code, {_one(S._BUYER)} AS buyer, {_one(S._ISO.format('iso_country_code'))} AS country,
  {', '.join(f"CASE WHEN count(DISTINCT {S._BOOL.format(x)}) = 1 THEN bool_or({S._BOOL.format(x)}) END AS {x}" for x in _T_FLAGS)}, {', '.join(f"{_one(S._CTRY.format(x))} AS {n}" for n, x in _T_TEXTS.items())},
  {', '.join(f"round(median({S._NUM.format(x)}), 6) AS {n}" for n, x in _T_NUMBERS.items())}, min({S._DATE.format('contract_start')}) AS starts, max({S._DATE.format('contract_completion')}) AS completes, min({S._DATE.format('dt_applications')}) AS applications,
  date_diff('day', min({S._DATE.format('dt_dispatch')}), min({S._DATE.format('dt_applications')})) AS lead_days, max(coalesce({', '.join(S._NUM.format(x) for x in _T_VALUES)})) AS value FROM cn_2017 GROUP BY 1""")
def fit_08_target_profiles(t: Tables) -> DataFrame:
    """One profile per contract notice: what its rows agree on, medians, dates and the lead to the deadline."""
    day = {n: C.parse_date(c(x)) for n, x in (("dispatch", "dt_dispatch"), ("starts", "contract_start"), ("completes", "contract_completion"), ("applications", "dt_applications"))}
    per = t.cn_2017.groupBy(C.clean_text(c("id_notice_cn")).alias("case_id")).agg(
        F.min(day["dispatch"]).alias("dispatch"), F.max(C.cpv_valid(c("cpv"))).alias("code"), unanimous(C.buyer_key(c("iso_country_code"), c("cae_nationalid"), c("cae_name"))).alias("buyer"), unanimous(C.iso2(c("iso_country_code"))).alias("country"),
        *[unanimous(C.parse_bool(c(x))).alias(x) for x in _T_FLAGS], *[unanimous(C.upper_clean(c(x))).alias(n) for n, x in _T_TEXTS.items()], *[F.round(F.median(C.parse_number(c(x))), 6).alias(n) for n, x in _T_NUMBERS.items()],
        F.min(day["starts"]).alias("starts"), F.max(day["completes"]).alias("completes"), F.min(day["applications"]).alias("applications"), F.max(C.first_number(*map(c, _T_VALUES))).alias("value"),
    )
    return per.withColumn("lead_days", F.datediff("applications", "dispatch"))


_SETS = {"additional_cpvs": r"\d{8}", "tal_location_nuts": r"[A-Z]{2}[A-Z0-9]{1,3}"}


@BOOK.query(" UNION ALL ".join(f"SELECT DISTINCT {S._CLEAN.format('id_notice_cn')} AS case_id, '{f}' AS field, unnest(regexp_extract_all(upper({f}), '{p}')) AS token FROM cn_2017" for f, p in _SETS.items()))
def fit_08_target_tokens(t: Tables) -> DataFrame:
    """The codes and regions of each contract notice, one row per distinct token."""
    sets = F.array(*[F.struct(F.lit(f).alias("field"), F.regexp_extract_all(F.upper(f), F.lit(f"({p})"), F.lit(1)).alias("tokens")) for f, p in _SETS.items()])
    return t.cn_2017.select(C.clean_text(c("id_notice_cn")).alias("case_id"), F.inline(sets)).select("case_id", "field", F.explode("tokens").alias("token")).distinct()


@BOOK.query(" UNION ALL ".join(f"SELECT '{side}' AS side, '{x}' AS field, count(v) AS n_known, count(*) FILTER (WHERE v) AS n_true, round(avg(v::INT), 9) AS share FROM (SELECT CASE WHEN count(DISTINCT {S._BOOL.format(x)}) = 1 THEN bool_or({S._BOOL.format(x)}) END AS v FROM {table} GROUP BY {key})" for side, table, key in (("target", "cn_2017", "id_notice_cn"), ("history", "can_2017", "id_notice_can")) for x in FLAGS[:8]))
def fit_09_both_sides(t: Tables) -> DataFrame:
    """How often each flag is known and true, on the target's side and in the history."""
    out = []
    for side, table, key in (("target", t.cn_2017, "id_notice_cn"), ("history", t.can_2017, "id_notice_can")):
        per = table.groupBy(key).agg(*[unanimous(C.parse_bool(c(x))).alias(x) for x in FLAGS[:8]])
        long = per.select(*FLAGS[:8]).unpivot([], list(FLAGS[:8]), "field", "v")
        out.append(long.groupBy("field").agg(F.count("v").alias("n_known"), F.count_if("v").alias("n_true"), F.round(F.avg(c("v").cast("double")), 9).alias("share")).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1])


#: How a field is read, for the audit of what can be read.
_READ: dict[str, tuple[str, ...]] = {"number": ("number_offers", "award_value_euro", "value_euro", "crit_price_weight", "lots_number"), "boolean": FLAGS[:6], "date": ("dt_dispatch", "dt_award")}
_LISTS = ("additional_cpvs", "crit_criteria", "crit_weights", "win_name", "win_town", "cae_name")


def _audit_sql() -> str:
    parsed = {"number": S._NUM, "boolean": S._BOOL, "date": S._DATE}
    rows = [f"SELECT '{kind}' AS audit, '{x}' AS field, count(nullif(trim({x}), '')) AS n_known, count({parsed[kind].format(x)}) AS n_ok, round(100.0 * count({parsed[kind].format(x)}) / nullif(count(nullif(trim({x}), '')), 0), 6) AS pct FROM can_2017" for kind, xs in _READ.items() for x in xs]
    rows += [f"SELECT 'multi_value', '{x}', count(nullif(trim({x}), '')), count(*) FILTER (WHERE instr(nullif(trim({x}), ''), '---') > 0), round(100.0 * count(*) FILTER (WHERE instr(nullif(trim({x}), ''), '---') > 0) / nullif(count(nullif(trim({x}), '')), 0), 6) FROM can_2017" for x in _LISTS]
    rows += [f"SELECT 'length', '{x}', count(nullif(trim({x}), '')), max(length(trim({x}))), round(avg(length(nullif(trim({x}), ''))), 6) FROM can_2017" for x in _LISTS]
    return " UNION ALL ".join(rows)


@BOOK.query(_audit_sql())
def fit_10_field_audits(t: Tables) -> DataFrame:
    """What share of each field can be read as it should, holds several values, and how long it is: one scan."""
    read = {"number": C.parse_number, "boolean": C.parse_bool, "date": C.parse_date}
    some = lambda x: C.clean_text(c(x))
    asked: list[tuple[str, str, Column, Column, Column]] = []
    for kind, xs in _READ.items():
        for x in xs:
            n, ok = F.count(some(x)), F.count(read[kind](c(x)))
            asked.append((kind, x, n, ok, F.round(F.try_divide(100.0 * ok, n), 6)))
    for x in _LISTS:
        n, many = F.count(some(x)), F.count_if(F.instr(some(x), "---") > 0)
        asked.append(("multi_value", x, n, many, F.round(F.try_divide(100.0 * many, n), 6)))
        asked.append(("length", x, n, F.max(F.length(some(x))).cast("bigint"), F.round(F.avg(F.length(some(x))), 6)))
    one = t.can_2017.agg(*[F.struct(n.alias("n_known"), ok.alias("n_ok"), pct.alias("pct")).alias(f"m{i}") for i, (_, _, n, ok, pct) in enumerate(asked)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("audit"), F.lit(f).alias("field"), *[c(f"m{i}.{k}").alias(k) for k in ("n_known", "n_ok", "pct")]) for i, (a, f, *_) in enumerate(asked)])))


_KINDS = {"cpv": "cpv", "country": "iso_country_code", "authority": "cae_type", "activity": "main_activity", "crit_code": "crit_code", "contract_type": "type_of_contract"}


@BOOK.query(" UNION ALL ".join(f"SELECT '{k}' AS dimension, count(*) AS n_targets, count(x) AS n_known, count(*) FILTER (WHERE x IN (SELECT {S._CTRY.format(f)} FROM can_2017)) AS n_seen FROM (SELECT id_notice_cn, {_one(S._CTRY.format(f))} AS x FROM cn_2017 GROUP BY 1)" for k, f in _KINDS.items()))
def fit_10_targets_seen(t: Tables) -> DataFrame:
    """Per dimension: targets, those that know a value, and those whose value the history has seen."""
    cases = t.cn_2017.groupBy("id_notice_cn").agg(*[unanimous(C.upper_clean(c(f))).alias(k) for k, f in _KINDS.items()]).unpivot(["id_notice_cn"], list(_KINDS), "dimension", "x")
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), C.upper_clean(c(f)).alias("x")) for k, f in _KINDS.items()])
    seen = t.can_2017.select(F.inline(pairs)).filter("x is not null").distinct().withColumn("_s", F.lit(1))
    return cases.join(seen, ["dimension", "x"], "left").groupBy("dimension").agg(F.count("*").alias("n_targets"), F.count("x").alias("n_known"), F.count("_s").alias("n_seen"))


# links, cohorts and identity audits

_COHORT = E._LINK + """, per AS (SELECT cn, count(*) AS n_links, count(cs.can) AS n_found, max(n_keys) AS n_keys, max(n_winners) AS n_winners, bool_or(any_list) AS any_list FROM pr LEFT JOIN cs0 USING (can) LEFT JOIN cs USING (can) GROUP BY 1),
n AS (SELECT id_notice_cn AS cn, bool_or(coalesce(""" + S._DATE.format("dt_dispatch") + " IS NOT NULL AND length(" + S._CPV + """) >= 2, false)) AS usable FROM cn_2017 GROUP BY 1)
SELECT n.cn, CASE WHEN NOT usable OR n.cn IS NULL THEN 'invalid_target' WHEN coalesce(n_links, 0) = 0 THEN 'no_link' WHEN n_links > 1 THEN 'multi_link' WHEN n_found = 0 THEN 'single_link_not_found' WHEN n_keys > 1 THEN 'single_link_multi_award'
  WHEN n_keys = 1 AND n_winners <> 1 THEN 'single_link_nonunique_winner' WHEN n_keys = 1 AND any_list THEN 'single_link_group_winner' WHEN n_keys = 1 THEN 'strict_single_link_single_award' ELSE 'other_review' END AS cohort FROM n LEFT JOIN per USING (cn)"""


def cohorts(t: Tables) -> DataFrame:
    """Per contract notice the label of the first rule that holds, from invalid to strictly linked."""
    keys = t.can_2017.groupBy(c("id_notice_can").alias("can")).agg(F.count_distinct(C.clean_text(c("id_award"))).alias("n_keys"))
    links = E.link_pairs(t).join(E.can_summary(t).withColumn("_f", F.lit(1)), "can", "left").join(keys, "can", "left")
    per = links.groupBy("cn").agg(F.count("*").alias("n_links"), F.count("_f").alias("n_found"), F.max("n_keys").alias("n_keys"), F.max("n_winners").alias("n_winners"), F.bool_or("any_list").alias("any_list"))
    usable = C.parse_date(c("dt_dispatch")).isNotNull() & C.cpv_prefix(c("cpv"), 2).isNotNull()
    notices = t.cn_2017.groupBy(c("id_notice_cn").alias("cn")).agg(F.bool_or(F.coalesce(usable, F.lit(False))).alias("usable"))
    one = c("n_keys") == 1
    label = C.first_of(
        (~c("usable") | c("cn").isNull(), "invalid_target"), (F.coalesce("n_links", F.lit(0)) == 0, "no_link"), (c("n_links") > 1, "multi_link"), (c("n_found") == 0, "single_link_not_found"), (c("n_keys") > 1, "single_link_multi_award"),
        (one & (c("n_winners") != 1), "single_link_nonunique_winner"), (one & c("any_list"), "single_link_group_winner"), (one, "strict_single_link_single_award"), otherwise="other_review",
    )
    return notices.join(per, "cn", "left").select("cn", label.alias("cohort"))


_COHORT = _COHORT.replace(", per AS", f", cs0 AS (SELECT id_notice_can AS can, count(DISTINCT {S._CLEAN.format('id_award')}) AS n_keys FROM can_2017 GROUP BY 1), per AS", 1)


@BOOK.query(_COHORT)
def lnk_03_cohorts(t: Tables) -> DataFrame:
    return cohorts(t)


@BOOK.query(f"WITH co AS ({_COHORT}) SELECT cohort, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM co GROUP BY 1")
def lnk_03_cohort_summary(t: Tables) -> DataFrame:
    per = cohorts(t).groupBy("cohort").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.withColumn("pct", F.round(100.0 * c("n") / total, 6))


_STRICT = f"WITH co AS ({_COHORT}), st AS (SELECT DISTINCT cn, can FROM ({E._LINK} SELECT * FROM pr) JOIN co USING (cn) WHERE cohort = 'strict_single_link_single_award')"
_TOWN = f"(SELECT id_notice_can AS can, {_one(S._ENTITY.format('win_town'))} AS town, {_one(S._ENTITY.format('win_name'))} AS winner, {_one(S._CTRY.format('win_country_code'))} AS country FROM can_2017 GROUP BY 1)"


@BOOK.query(_STRICT + f" SELECT cn, can, winner, country, town, CASE WHEN length(country) = 2 THEN country || '||' || winner END AS nc_key, town || '||' || winner AS nt_key, count(*) OVER (PARTITION BY cn) = 1 AS one_row FROM st JOIN {_TOWN} USING (can)")
def er_07_strict_targets(t: Tables) -> DataFrame:
    """The strictly linked targets with what their award's rows agree on: winner, country and, only where unanimous, town; guarded against repeated cases."""
    strict = cohorts(t).filter("cohort = 'strict_single_link_single_award'")
    winners = t.can_2017.groupBy(c("id_notice_can").alias("can")).agg(unanimous(C.normalize_entity(c("win_town"))).alias("town"), unanimous(C.normalize_entity(c("win_name"))).alias("winner"), unanimous(C.upper_clean(c("win_country_code"))).alias("country"))
    x = E.link_pairs(t).select("cn", "can").join(strict.select("cn"), "cn").join(winners, "can")
    keyed = x.withColumn("nc_key", F.when(F.length("country") == 2, F.concat("country", F.lit("||"), "winner"))).withColumn("nt_key", F.concat("town", F.lit("||"), "winner"))
    return keyed.withColumn("one_row", F.count("*").over(W.partitionBy("cn")) == 1)


_BY = {"method": "status", "country": "coalesce(ctry, '--')", "category": "coalesce(cpv2, '--')", "group": "CAST(is_group AS VARCHAR)", "identifier": "CAST(nid IS NOT NULL AS VARCHAR)"}


@BOOK.query(E._MAP + " SELECT report, value, count(*) AS n, count(*) FILTER (WHERE status IN ('identifier', 'name_country', 'name_town')) AS n_matched, round(100.0 * count(*) FILTER (WHERE status IN ('identifier', 'name_country', 'name_town')) / count(*), 6) AS pct FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS report, {v} AS value, status FROM mp" for k, v in _BY.items()) + ") GROUP BY 1, 2")
def er_10_reports(t: Tables) -> DataFrame:
    """Match rates by method, country, category, structure and known identifier, in one shuffle."""
    value = {"method": c("status"), "country": F.coalesce("ctry", F.lit("--")), "category": F.coalesce("cpv2", F.lit("--")), "group": c("is_group").cast("string"), "identifier": c("nid").isNotNull().cast("string")}
    each = E.mapped(t).select("status", F.inline(F.array(*[F.struct(F.lit(k).alias("report"), v.alias("value")) for k, v in value.items()])))
    hit = c("status").isin("identifier", "name_country", "name_town")
    return each.groupBy("report", "value").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_matched"), F.round(100.0 * F.count_if(hit) / F.count("*"), 6).alias("pct"))


@BOOK.query(E._BASE + "SELECT nc_key, count(*) AS n_rows, count(DISTINCT nid) AS n_ids, min(win_name) AS example, min(loaded_at) AS first_seen, max(loaded_at) AS last_seen FROM k WHERE nc_key IS NOT NULL AND nid IS NOT NULL GROUP BY 1 HAVING count(DISTINCT nid) > 1")
def er_11_collisions(t: Tables) -> DataFrame:
    """Names that stand with several identifiers in one country."""
    x = E.known(t).filter("nc_key is not null and nid is not null").groupBy("nc_key").agg(F.count("*").alias("n_rows"), F.count_distinct("nid").alias("n_ids"), F.min("win_name").alias("example"), F.min("loaded_at").alias("first_seen"), F.max("loaded_at").alias("last_seen"))
    return x.filter("n_ids > 1")


@BOOK.query(E._BASE + "SELECT nid, count(*) AS n_rows, count(DISTINCT name_norm) AS n_names, min(name_norm) AS lo, max(name_norm) AS hi FROM k WHERE nid IS NOT NULL AND name_norm IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name_norm) > 1")
def er_11_aliases(t: Tables) -> DataFrame:
    """Identifiers under which several names stand."""
    x = E.known(t).filter("nid is not null and name_norm is not null").groupBy("nid").agg(F.count("*").alias("n_rows"), F.count_distinct("name_norm").alias("n_names"), F.min("name_norm").alias("lo"), F.max("name_norm").alias("hi"))
    return x.filter("n_names > 1")


@BOOK.query(E._BASE + "SELECT nc_key, nid, count(*) AS n FROM k JOIN anc USING (nid) WHERE reliable AND nc_key IS NOT NULL AND NOT is_group GROUP BY 1, 2")
def er_11_bridge_edges(t: Tables) -> DataFrame:
    """The edges between names and reliable identifiers, with their weight."""
    from bidloom.operators import entities as O

    k = E.known(t)
    good = O.anchors(k).filter("reliable").select("nid")
    return k.filter("nc_key is not null and nid is not null and not is_group").join(good, "nid").groupBy("nc_key", "nid").agg(F.count("*").alias("n"))


@BOOK.query(E._BASE + "SELECT CASE WHEN is_group THEN 'group_or_list' WHEN method = 'ambiguous' THEN 'several_identifiers' WHEN name_norm IS NULL THEN 'no_name' WHEN entity_id IS NULL AND ctry IS NULL AND town_norm IS NULL THEN 'no_place' WHEN entity_id IS NULL THEN 'other' ELSE 'resolved' END AS reason, count(*) AS n, count(DISTINCT ctry) AS n_countries FROM en GROUP BY 1")
def er_11_unresolved(t: Tables) -> DataFrame:
    """Why rows stay without an entity, the first reason that applies."""
    none = c("entity_id").isNull()
    label = C.first_of((c("is_group"), "group_or_list"), (c("method") == "ambiguous", "several_identifiers"), (c("name_norm").isNull(), "no_name"), (none & c("ctry").isNull() & c("town_norm").isNull(), "no_place"), (none, "other"), otherwise="resolved")
    return E.resolved(t).groupBy(label.alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("ctry").alias("n_countries"))
