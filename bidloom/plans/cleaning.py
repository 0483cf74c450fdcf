"""Queries of the scalar cleaning functions and label ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C
from bidloom.plans.book import Book, Tables

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col

_CLEAN = "nullif(trim({0}), '')"
_ENTITY = "nullif(trim(regexp_replace(lower({0}), '[^[:alnum:]]+', ' ', 'g')), '')"
_IDENT = "nullif(regexp_replace(upper({0}), '[^[:alnum:]]+', '', 'g'), '')"
_PLACEHOLDERS = ", ".join(f"'{x}'" for x in C.PLACEHOLDER_IDS)
_ISO = "CASE WHEN regexp_matches(upper(trim({0})), '^[A-Z]{{2}}$') THEN upper(trim({0})) END"
_ALNUM = "nullif(regexp_replace(upper(trim({0})), '[^A-Z0-9]', '', 'g'), '')"
_BOOL = "CASE WHEN upper(trim({0})) IN ('Y','YES','1','TRUE','T') THEN true WHEN upper(trim({0})) IN ('N','NO','0','FALSE','F') THEN false END"
_NUM = r"CASE WHEN regexp_matches(trim({0}), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN try_cast(trim({0}) AS DOUBLE) END"
_DATE = r"""coalesce(
  CASE WHEN regexp_matches(trim({0}), '^\d{{1,2}}-[A-Za-z]{{3}}-\d{{2}}$') THEN try_strptime(trim({0}), '%d-%b-%y') END,
  CASE WHEN regexp_matches(trim({0}), '^\d{{1,2}}/\d{{1,2}}/\d{{2}}$') THEN try_strptime(trim({0}), '%d/%m/%y') END,
  CASE WHEN regexp_matches(trim({0}), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN try_strptime(trim({0}), '%Y-%m-%d') END,
  CASE WHEN regexp_matches(trim({0}), '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN try_strptime(trim({0}), '%d/%m/%Y') END,
  CASE WHEN regexp_matches(trim({0}), '^\d{{8}}$') THEN try_strptime(trim({0}), '%Y%m%d') END,
  CASE WHEN regexp_matches(trim({0}), '^\d{{1,2}}-\d{{1,2}}-\d{{4}}$') THEN try_strptime(trim({0}), '%d-%m-%Y') END)::DATE"""


@BOOK.query(f"SELECT source_row_id, {_CLEAN.format('win_name')} AS win_name, {_CLEAN.format('win_town')} AS win_town FROM can_2017")
def scl_01_clean_text(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.clean_text(c("win_name")).alias("win_name"), C.clean_text(c("win_town")).alias("win_town"))


@BOOK.query(f"SELECT {_ENTITY.format('win_name')} AS name_norm, count(*) AS n FROM can_2017 GROUP BY 1")
def scl_02_normalize_entity(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(C.normalize_entity(c("win_name")).alias("name_norm")).agg(F.count("*").alias("n"))


@BOOK.query(f"SELECT {_IDENT.format('win_nationalid')} AS id_norm, count(*) AS n FROM can_2017 GROUP BY 1")
def scl_03_normalize_identifier(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(C.normalize_identifier(c("win_nationalid")).alias("id_norm")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT nullif(regexp_replace(upper(trim(main_activity)), '[^A-Z0-9]', '', 'g'), '') AS activity, count(*) AS n FROM can_2017 GROUP BY 1")
def scl_04_alnum(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(F.nullif(F.regexp_replace(F.upper(F.trim("main_activity")), "[^A-Z0-9]", ""), F.lit("")).alias("activity")).agg(F.count("*").alias("n"))


@BOOK.query(f"SELECT upper({_CLEAN.format('top_type')}) AS top_type, count(*) AS n FROM can_2017 GROUP BY 1")
def scl_05_upper_clean(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(C.upper_clean(c("top_type")).alias("top_type")).agg(F.count("*").alias("n"))


@BOOK.query(f"SELECT source_row_id, {_BOOL.format('b_eu_funds')} AS eu_funds, {_BOOL.format('cancelled')} AS cancelled, {_BOOL.format('b_subcontracted')} AS subcontracted FROM can_2017")
def scl_06_parse_bool(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.parse_bool(c("b_eu_funds")).alias("eu_funds"), C.parse_bool(c("cancelled")).alias("cancelled"), C.parse_bool(c("b_subcontracted")).alias("subcontracted"))


@BOOK.query(f"SELECT source_row_id, {_NUM.format('award_value_euro')} AS award_value, {_NUM.format('number_offers')} AS offers FROM can_2017")
def scl_07_parse_number(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.parse_number(c("award_value_euro")).alias("award_value"), C.parse_number(c("number_offers")).alias("offers"))


_LENIENT = _NUM.format("replace(replace(replace({0}, ' ', ''), '%', ''), ',', '.')")


@BOOK.query(f"SELECT source_row_id, {_LENIENT.format('award_value_euro')} AS award_value, {_LENIENT.format('crit_price_weight')} AS price_weight FROM can_2017")
def scl_08_parse_number_lenient(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.parse_number_lenient(c("award_value_euro")).alias("award_value"), C.parse_number_lenient(c("crit_price_weight")).alias("price_weight"))


@BOOK.query(f"SELECT source_row_id, {_DATE.format('dt_award')} AS award_date, {_DATE.format('dt_dispatch')} AS dispatch_date FROM can_2017")
def scl_09_parse_date(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.parse_date(c("dt_award")).alias("award_date"), C.parse_date(c("dt_dispatch")).alias("dispatch_date"))


_LEGACY = r"""coalesce(CASE WHEN regexp_matches(trim(dt_award), '^\d{4}-\d{1,2}-\d{1,2}$') THEN try_strptime(trim(dt_award), '%Y-%m-%d') END,
  CASE WHEN regexp_matches(trim(dt_award), '^\d{1,2}/\d{1,2}/\d{2,4}$') THEN try_strptime(regexp_replace(trim(dt_award), '^(\d{1,2}/\d{1,2}/)(\d{2})$', '\100\2'), '%d/%m/%Y') END)::DATE"""


@BOOK.query(f"SELECT source_row_id, year({_LEGACY}) AS legacy_year FROM can_2017")
def scl_10_legacy_date(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", F.year(C.parse_date_legacy(c("dt_award"))).alias("legacy_year"))


@BOOK.query(f"SELECT source_row_id, CASE WHEN year(d) < 100 THEN d + INTERVAL 2000 YEAR ELSE d END::DATE AS repaired FROM (SELECT source_row_id, {_LEGACY} AS d FROM can_2017)")
def scl_11_repair_year(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.repair_year(C.parse_date_legacy(c("dt_award"))).alias("repaired"))


_CPV = "nullif(regexp_replace(cpv, '[^0-9]', '', 'g'), '')"


@BOOK.query(f"SELECT source_row_id, {_CPV} AS digits, CASE WHEN length({_CPV}) = 8 THEN {_CPV} END AS code, CASE WHEN length({_CPV}) >= 2 THEN substr({_CPV}, 1, 2) END AS cpv2, CASE WHEN length({_CPV}) >= 4 THEN substr({_CPV}, 1, 4) END AS cpv4 FROM cn_2017")
def scl_12_cpv(t: Tables) -> DataFrame:
    return t.cn_2017.select("source_row_id", C.cpv_digits(c("cpv")).alias("digits"), C.cpv_valid(c("cpv")).alias("code"), C.cpv_prefix(c("cpv"), 2).alias("cpv2"), C.cpv_prefix(c("cpv"), 4).alias("cpv4"))


_NUTS = r"upper(regexp_replace(trim(tal_location_nuts), '\s+', '', 'g'))"


@BOOK.query(f"SELECT source_row_id, CASE WHEN regexp_matches({_NUTS}, '^[A-Z]{{2}}[A-Z0-9]{{1,3}}$') THEN {_NUTS} END AS nuts FROM cn_2017")
def scl_13_nuts(t: Tables) -> DataFrame:
    return t.cn_2017.select("source_row_id", C.nuts_code(c("tal_location_nuts")).alias("nuts"))


@BOOK.query(f"SELECT {_ISO.format('win_country_code')} AS country, count(*) AS n FROM can_2017 GROUP BY 1")
def scl_14_iso2(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(C.iso2(c("win_country_code")).alias("country")).agg(F.count("*").alias("n"))


_CTRY = "upper(" + _CLEAN + ")"
_BUYER_PLACEHOLDERS = ", ".join(f"'{x}'" for x in C.BUYER_PLACEHOLDERS)
_BUYER = f"""CASE WHEN length({_CTRY.format('iso_country_code')}) = 2 AND length({_ALNUM.format('cae_nationalid')}) >= 4 AND {_ALNUM.format('cae_nationalid')} NOT IN ({_BUYER_PLACEHOLDERS}) AND NOT regexp_matches({_ALNUM.format('cae_nationalid')}, '^0+$')
  THEN 'BID||' || {_CTRY.format('iso_country_code')} || '||' || {_ALNUM.format('cae_nationalid')}
  WHEN length({_CTRY.format('iso_country_code')}) = 2 AND {_ALNUM.format('cae_name')} IS NOT NULL THEN 'BN||' || {_CTRY.format('iso_country_code')} || '||' || {_ALNUM.format('cae_name')} END"""
_WHOSE = {"i": _IDENT.format("win_nationalid"), "c": _CTRY.format("win_country_code"), "n": _ENTITY.format("win_name"), "t": _ENTITY.format("win_town")}
_LADDER = (("i", "c", "nid_country", "national_id_country"), ("n", "c", "name_country", "normalized_name_country"), ("n", "t", "name_town", "normalized_name_town"))
_SUPPLIER = "CASE " + " ".join(f"WHEN {_WHOSE[x]} IS NOT NULL AND {_WHOSE[y]} IS NOT NULL THEN '{label}||' || {_WHOSE[y]} || '||' || {_WHOSE[x]}" for x, y, label, _ in _LADDER) + " END"
_METHOD = "CASE " + " ".join(f"WHEN {_WHOSE[x]} IS NOT NULL AND {_WHOSE[y]} IS NOT NULL THEN '{m}'" for x, y, _, m in _LADDER) + " ELSE 'unresolved' END"


@BOOK.query(f"SELECT {_BUYER} AS buyer_key, count(*) AS n FROM can_2017 GROUP BY 1")
def scl_15_buyer_key(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(C.buyer_key(c("iso_country_code"), c("cae_nationalid"), c("cae_name")).alias("buyer_key")).agg(F.count("*").alias("n"))


@BOOK.query(f"SELECT source_row_id, {_CLEAN.format('id_notice_can')} || '||' || {_CLEAN.format('id_award')} AS award_key, {_SUPPLIER} AS supplier_key, {_METHOD} AS method FROM can_2017")
def scl_16_supplier_key(t: Tables) -> DataFrame:
    parts = c("win_country_code"), c("win_nationalid"), c("win_name"), c("win_town")
    return t.can_2017.select("source_row_id", C.award_key(c("id_notice_can"), c("id_award")).alias("award_key"), C.supplier_key(*parts).alias("supplier_key"), C.supplier_key_method(*parts).alias("method"))


@BOOK.query(f"SELECT source_row_id, coalesce({_NUM.format('award_value_euro_fin_1')}, {_NUM.format('award_value_euro')}, {_NUM.format('value_euro')}) AS value FROM can_2017")
def scl_17_first_number(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.first_number(c("award_value_euro_fin_1"), c("award_value_euro"), c("value_euro")).alias("value"))


@BOOK.query("SELECT source_row_id, regexp_extract(cpv, '([0-9]{2})', 1) AS cpv2 FROM can_2017")
def scl_18_regexp_extract(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", F.regexp_extract("cpv", "([0-9]{2})", 1).alias("cpv2"))


@BOOK.query("SELECT instr(coalesce(win_name, ''), '---') > 0 AS is_list, contains(coalesce(cae_name, ''), 'niver') AS has_niver, count(*) AS n FROM can_2017 GROUP BY 1, 2")
def scl_19_search(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(C.is_list_field(c("win_name")).alias("is_list"), F.contains(F.coalesce("cae_name", F.lit("")), F.lit("niver")).alias("has_niver")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT source_row_id, CASE WHEN nullif(trim(additional_cpvs), '') IS NULL THEN 0 ELSE (length(trim(additional_cpvs)) - length(replace(trim(additional_cpvs), '---', ''))) // 3 + 1 END AS n_tokens FROM cn_2017")
def scl_20_token_count(t: Tables) -> DataFrame:
    return t.cn_2017.select("source_row_id", C.list_tokens(c("additional_cpvs")).alias("n_tokens"))


@BOOK.query(f"SELECT source_row_id, date_diff('day', {_DATE.format('dt_award')}, {_DATE.format('dt_dispatch')}) AS lag_days FROM can_2017")
def scl_21_day_gap(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", F.datediff(C.parse_date(c("dt_dispatch")), C.parse_date(c("dt_award"))).alias("lag_days"))


@BOOK.query("SELECT year(o_orderdate) AS y, extract(month FROM o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
def scl_22_year(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT source_row_id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS title_norm FROM can_2017")
def scl_23_match_text(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.match_text(c("title")).alias("title_norm"))


@BOOK.query(f"SELECT coalesce(CAST({_BOOL.format('b_gpa')} AS VARCHAR), 'unknown') AS gpa, count(*) AS n FROM can_2017 GROUP BY 1")
def scl_24_bool_text(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(F.coalesce(C.parse_bool(c("b_gpa")).cast("string"), F.lit("unknown")).alias("gpa")).agg(F.count("*").alias("n"))


@BOOK.query("""SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price, round(sqrt(o_totalprice), 6) AS root, round(pow(o_totalprice / 1000, 2), 4) AS sq, least(greatest(o_totalprice / 100000, 0), 1) AS clipped,
  round(1.0 / (1 + date_diff('day', DATE '1995-01-01', o_orderdate::DATE)), 9) AS recency FROM orders""")
def scl_25_math(t: Tables) -> DataFrame:
    p = c("o_totalprice")
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return t.orders.select("o_orderkey", F.round(F.log1p(p), 6).alias("log_price"), F.round(F.sqrt(p), 6).alias("root"), F.round(F.pow(p / 1000, F.lit(2)), 4).alias("sq"), F.least(F.greatest(p / 100000, F.lit(0.0)), F.lit(1.0)).alias("clipped"), F.round(C.recency(days), 9).alias("recency"))


_GROUP = "(" + " OR ".join([f"coalesce({_BOOL.format('b_awarded_to_a_group')}, false)", *(f"instr(coalesce({x}, ''), '---') > 0" for x in ("win_name", "win_nationalid", "win_country_code", "win_town"))]) + ")"
_HYG = f"""CASE WHEN {_IDENT.format('win_nationalid')} IS NULL THEN 'missing' WHEN instr(win_nationalid, '---') > 0 THEN 'multi_value_identifier' WHEN {_GROUP} THEN 'group_or_list_record'
  WHEN {_CTRY.format('win_country_code')} IS NULL THEN 'missing_country_context' WHEN length({_CTRY.format('win_country_code')}) <> 2 THEN 'invalid_country_context' WHEN {_IDENT.format('win_nationalid')} = {_CTRY.format('win_country_code')} THEN 'country_code_placeholder'
  WHEN {_IDENT.format('win_nationalid')} IN ({_PLACEHOLDERS}) THEN 'generic_placeholder' WHEN length({_IDENT.format('win_nationalid')}) < SHORTEST THEN 'suspicious_short' ELSE 'candidate_valid_anchor' END"""


def _hygiene(min_length: int = 4) -> Column:
    parts = [c(x) for x in ("win_name", "win_nationalid", "win_country_code", "win_town")]
    return C.id_hygiene(parts[1], parts[2], C.group_or_list(C.parse_bool(c("b_awarded_to_a_group")), *parts), min_length)


@BOOK.query(f"SELECT {_HYG.replace('SHORTEST', '4')} AS status, count(*) AS n FROM can_2017 GROUP BY 1")
def prj_05_id_hygiene(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(_hygiene().alias("status")).agg(F.count("*").alias("n"))


@BOOK.query(" UNION ALL ".join(f"SELECT {k} AS min_id_length, {_HYG.replace('SHORTEST', str(k))} AS status, count(*) AS n FROM can_2017 GROUP BY 2" for k in (4, 6, 8)))
def prj_05_min_length(t: Tables) -> DataFrame:
    """The same for several shortest lengths, in one scan."""
    each = F.array(*[F.struct(F.lit(k).alias("min_id_length"), _hygiene(k).alias("status")) for k in (4, 6, 8)])
    return t.can_2017.select(F.inline(each)).groupBy("min_id_length", "status").agg(F.count("*").alias("n"))


_MISSING = f"""CASE WHEN {_CLEAN.format('id_notice_can')} IS NULL THEN 'no_notice' WHEN {_CLEAN.format('id_award')} IS NULL THEN 'no_award' WHEN {_CLEAN.format('win_name')} IS NULL THEN 'no_winner'
  WHEN instr(win_name, '---') > 0 THEN 'several_winners' WHEN length({_CPV}) < 2 OR {_CPV} IS NULL THEN 'no_category' WHEN {_DATE.format('dt_dispatch')} IS NULL THEN 'no_date' END"""


def _exclusion() -> Column:
    return C.first_of(
        (C.clean_text(c("id_notice_can")).isNull(), "no_notice"), (C.clean_text(c("id_award")).isNull(), "no_award"), (C.clean_text(c("win_name")).isNull(), "no_winner"),
        (C.is_list_field(c("win_name")), "several_winners"), (C.cpv_prefix(c("cpv"), 2).isNull(), "no_category"), (C.parse_date(c("dt_dispatch")).isNull(), "no_date"),
    )


@BOOK.query(f"SELECT source_row_id, id_notice_can FROM can_2017 WHERE {_MISSING} IS NULL")
def prj_01_candidates(t: Tables) -> DataFrame:
    return t.can_2017.filter(_exclusion().isNull()).select("source_row_id", "id_notice_can")


@BOOK.query(f"SELECT {_MISSING} AS reason, count(*) AS n FROM can_2017 WHERE {_MISSING} IS NOT NULL GROUP BY 1")
def prj_02_exclusions(t: Tables) -> DataFrame:
    return t.can_2017.withColumn("reason", _exclusion()).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@BOOK.query("SELECT * EXCLUDE (o_totalprice, o_orderpriority) FROM orders")
def prj_03_exclude(t: Tables) -> DataFrame:
    return t.orders.drop("o_totalprice", "o_orderpriority")


_LAG = f"date_diff('day', {_DATE.format('dt_award')}, {_DATE.format('dt_dispatch')})"


@BOOK.query(f"SELECT CASE WHEN {_LAG} IS NULL THEN 'missing' WHEN {_LAG} < 0 THEN 'negative' WHEN {_LAG} = 0 THEN 'same_day' WHEN {_LAG} > 730 THEN 'extreme' ELSE 'plausible' END AS quality, count(*) AS n FROM can_2017 GROUP BY 1")
def prj_04_temporal_quality(t: Tables) -> DataFrame:
    lag = F.datediff(C.parse_date(c("dt_dispatch")), C.parse_date(c("dt_award")))
    label = C.first_of((lag.isNull(), "missing"), (lag < 0, "negative"), (lag == 0, "same_day"), (lag > 730, "extreme"), otherwise="plausible")
    return t.can_2017.groupBy(label.alias("quality")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT count(*) AS n_rows, count(*) AS n_ids, count(DISTINCT source_row_id) AS n_sources FROM can_2017")
def prj_06_surrogate_ids(t: Tables) -> DataFrame:
    """Row numbers without a shuffle (not dense), and that they are unique."""
    numbered = t.can_2017.select(F.monotonically_increasing_id().alias("row_id"), "source_row_id")
    return numbered.agg(F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), F.count_distinct("source_row_id").alias("n_sources"))


@BOOK.query("SELECT source_row_id, CASE WHEN instr(coalesce(win_name, ''), '---') > 0 THEN 'list' WHEN upper(trim(b_awarded_to_a_group)) IN ('Y','YES','1','TRUE','T') THEN 'group' ELSE 'single' END AS structure FROM can_2017")
def prj_07_group_structure(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", C.first_of((C.is_list_field(c("win_name")), "list"), (C.parse_bool(c("b_awarded_to_a_group")), "group"), otherwise="single").alias("structure"))


@BOOK.query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def prj_08_prune(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")
