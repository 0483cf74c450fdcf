"""Queries of entity resolution, links between notices, evaluation of extractions and profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C
from bidloom.functions.notice_ids import canonical_notice, notice_numbers
from bidloom.operators import aggregates as A
from bidloom.operators import entities as E
from bidloom.operators import evaluation as V
from bidloom.operators import tables as T
from bidloom.plans import cleaning as S
from bidloom.plans.book import Book, Tables

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col

_ISO, _ENT, _ID = S._CTRY.format("win_country_code"), S._ENTITY.format("win_name"), S._IDENT.format("win_nationalid")
_BASE = f"""WITH k0 AS (SELECT source_row_id, loaded_at, win_name, {S._GROUP} AS is_group, {_ENT} AS name_norm, {_ISO} AS ctry, {S._ENTITY.format('win_town')} AS town_norm,
  CASE WHEN {S._HYG.replace('SHORTEST', '4')} = 'candidate_valid_anchor' THEN {_ISO} || '||' || {_ID} END AS nid, substr(nullif(regexp_replace(cpv, '[^0-9]', '', 'g'), ''), 1, 2) AS cpv2, month(loaded_at) AS m FROM can_2017),
k AS (SELECT *, CASE WHEN length(ctry) = 2 THEN ctry || '||' || name_norm END AS nc_key, town_norm || '||' || name_norm AS nt_key FROM k0),
anc AS (SELECT nid, sum(n) AS n_rows, count(name_norm) AS n_names, count(name_norm) <= 20 AS reliable FROM (SELECT nid, name_norm, count(*) AS n FROM k WHERE nid IS NOT NULL AND NOT is_group GROUP BY 1, 2) GROUP BY 1),
br AS (SELECT nc_key, count(*) AS n_anchors, CASE WHEN min(nid) = max(nid) THEN min(nid) END AS bridge_nid, CASE WHEN min(nid) = max(nid) THEN 'one' ELSE 'ambiguous' END AS bridge_status FROM (
  SELECT DISTINCT nc_key, nid FROM k JOIN anc USING (nid) WHERE reliable AND nc_key IS NOT NULL AND NOT is_group) GROUP BY 1),
en0 AS (SELECT k.*, CASE WHEN is_group THEN 'group' WHEN reliable THEN 'identifier' WHEN bridge_status = 'ambiguous' THEN 'ambiguous' WHEN bridge_status = 'one' THEN 'bridge' WHEN k.nc_key IS NOT NULL THEN 'name_country' WHEN nt_key IS NOT NULL THEN 'name_town' ELSE 'unresolved' END AS method, bridge_nid
  FROM k LEFT JOIN anc ON anc.nid = k.nid AND reliable LEFT JOIN br ON br.nc_key = k.nc_key),
en AS (SELECT * EXCLUDE (bridge_nid), CASE method WHEN 'identifier' THEN 'ID||' || nid WHEN 'bridge' THEN 'ID||' || bridge_nid WHEN 'name_country' THEN 'NC||' || nc_key WHEN 'name_town' THEN 'NT||' || nt_key END AS entity_id FROM en0)
"""


def known(t: Tables) -> DataFrame:
    rows = t.can_2017.select("source_row_id", "loaded_at", "win_name", "win_nationalid", "win_country_code", "win_town", "b_awarded_to_a_group", "cpv")
    return E.identities(rows, "win_name", "win_nationalid", "win_country_code", "win_town", C.parse_bool(c("b_awarded_to_a_group"))).withColumn("cpv2", F.substring(C.cpv_digits(c("cpv")), 1, 2)).withColumn("m", F.month("loaded_at"))


def resolved(t: Tables) -> DataFrame:
    k = known(t)
    a = E.anchors(k)
    return E.entity_of(k, a, E.bridges(k, a))


@BOOK.query(_BASE + "SELECT source_row_id, name_norm, ctry, town_norm, nid, nc_key, nt_key, is_group FROM k")
def er_01_identities(t: Tables) -> DataFrame:
    return known(t).select("source_row_id", "name_norm", "ctry", "town_norm", "nid", "nc_key", "nt_key", "is_group")


@BOOK.query(_BASE + "SELECT * FROM anc")
def er_02_anchors(t: Tables) -> DataFrame:
    return E.anchors(known(t))


@BOOK.query(_BASE + "SELECT * FROM br")
def er_03_bridges(t: Tables) -> DataFrame:
    k = known(t)
    return E.bridges(k, E.anchors(k))


@BOOK.query(_BASE + "SELECT source_row_id, entity_id, method FROM en")
def er_04_award_entities(t: Tables) -> DataFrame:
    return resolved(t).select("source_row_id", "entity_id", "method")


@BOOK.query(_BASE + """, nm AS (SELECT entity_id, win_name AS alias, count(*) AS n, min(loaded_at) AS lo, max(loaded_at) AS hi FROM en WHERE entity_id IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, hi DESC NULLS LAST, length(alias) DESC NULLS LAST, alias NULLS LAST) AS r FROM nm)
SELECT entity_id, max(alias) FILTER (WHERE r = 1) AS canonical_name, count(alias) AS n_aliases, sum(n) AS n_rows, min(lo) AS first_seen, max(hi) AS last_seen FROM rk GROUP BY 1""")
def er_05_dimension(t: Tables) -> DataFrame:
    return E.dimension(resolved(t), "win_name", "loaded_at")


_MAP = _BASE + """, h AS (SELECT * FROM en WHERE m <= 6 AND entity_id IS NOT NULL), g AS (SELECT * EXCLUDE (entity_id, method) FROM en WHERE m > 6),
l1 AS (SELECT nid, min(entity_id) AS e FROM h WHERE nid IS NOT NULL GROUP BY 1 HAVING min(entity_id) = max(entity_id)), l2 AS (SELECT nc_key, min(entity_id) AS e FROM h WHERE nc_key IS NOT NULL GROUP BY 1 HAVING min(entity_id) = max(entity_id)),
l3 AS (SELECT nt_key, min(entity_id) AS e FROM h WHERE nt_key IS NOT NULL GROUP BY 1 HAVING min(entity_id) = max(entity_id)), la AS (SELECT nc_key FROM h WHERE nc_key IS NOT NULL GROUP BY 1 HAVING min(entity_id) <> max(entity_id)),
mp AS (SELECT g.*, l1.e AS e1, l2.e AS e2, l3.e AS e3, CASE WHEN is_group OR name_norm IS NULL THEN 'invalid' WHEN l1.e IS NOT NULL THEN 'identifier' WHEN la.nc_key IS NOT NULL THEN 'ambiguous' WHEN l2.e IS NOT NULL THEN 'name_country' WHEN l3.e IS NOT NULL THEN 'name_town' ELSE 'none' END AS status
  FROM g LEFT JOIN l1 USING (nid) LEFT JOIN l2 ON l2.nc_key = g.nc_key LEFT JOIN l3 ON l3.nt_key = g.nt_key LEFT JOIN la ON la.nc_key = g.nc_key)
"""


def mapped(t: Tables) -> DataFrame:
    """The rows loaded after June mapped to the entities of those before."""
    r = resolved(t)
    return E.map_to_history(r.filter("m > 6").drop("entity_id", "method", "confidence"), E.lookups(r.filter("m <= 6")))


@BOOK.query(_MAP + "SELECT (SELECT count(*) FROM l1) AS n_nid, (SELECT count(*) FROM l2) AS n_nc, (SELECT count(*) FROM l3) AS n_nt, (SELECT count(*) FROM la) AS n_ambiguous")
def er_08_lookups(t: Tables) -> DataFrame:
    sizes = [v.agg(F.count("*").alias("n")).withColumn("k", F.lit(k)) for k, v in E.lookups(resolved(t).filter("m <= 6")).items()]
    one = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])
    return one.agg(*[F.max(F.when(c("k") == k, c("n"))).alias(n) for k, n in (("nid", "n_nid"), ("nc_key", "n_nc"), ("nt_key", "n_nt"), ("ambiguous", "n_ambiguous"))])


@BOOK.query(_MAP + "SELECT source_row_id, status, CASE status WHEN 'identifier' THEN e1 WHEN 'name_country' THEN e2 WHEN 'name_town' THEN e3 END AS entity_id FROM mp")
def er_09_history_map(t: Tables) -> DataFrame:
    return mapped(t).select("source_row_id", "status", "entity_id")


@BOOK.query(_MAP + "SELECT status, coalesce(cpv2, '--') AS cpv2, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY coalesce(cpv2, '--')), 6) AS pct FROM mp GROUP BY 1, 2")
def er_10_match_rates(t: Tables) -> DataFrame:
    per = mapped(t).groupBy("status", F.coalesce("cpv2", F.lit("--")).alias("cpv2")).agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.round(100 * c("n") / F.sum("n").over(Window.partitionBy("cpv2")), 6))


@BOOK.query(_BASE + "SELECT entity_id, count(*) AS n_rows, count(DISTINCT town_norm) AS n_towns, count(DISTINCT cpv2) AS n_cpv2, count(*) >= 20 AND (count(DISTINCT town_norm) >= 5 OR count(DISTINCT cpv2) >= 10) AS review FROM en WHERE entity_id IS NOT NULL GROUP BY 1")
def er_11_dispersion(t: Tables) -> DataFrame:
    """Entities spread over many towns or categories, for review."""
    towns = resolved(t).filter("entity_id is not null").groupBy("entity_id").agg(F.count("*").alias("n_rows"), F.count_distinct("town_norm").alias("n_towns"), F.count_distinct("cpv2").alias("n_cpv2"))
    return towns.withColumn("review", (c("n_rows") >= 20) & ((c("n_towns") >= 5) | (c("n_cpv2") >= 10)))


# links between notices

_NUM = r"(?:\d{4}-\d{8}|\d{8}-\d{4}|\d{12})"
_CANON = "CASE WHEN instr({0}, '-') = 9 THEN substr({0}, 10, 4) || substr({0}, 1, 8) ELSE replace({0}, '-', '') END"
_LINK = f"""WITH ev AS (SELECT DISTINCT id_notice_cn AS cn, {_CANON.format('x')} AS can, est FROM (SELECT id_notice_cn, unnest(regexp_extract_all(future_can_id, '{_NUM}')) AS x, {S._BOOL.format('future_can_id_estimated')} AS est FROM cn_2017)),
pr AS (SELECT cn, can, CASE WHEN bool_or(est) AND bool_or(NOT est) THEN 'mixed' WHEN bool_or(est) THEN 'estimated' WHEN bool_or(NOT est) THEN 'certain' ELSE 'unknown' END AS estimation FROM ev GROUP BY 1, 2),
cs AS (SELECT id_notice_can AS can, count(*) AS n_rows, count(DISTINCT win_name) AS n_winners, bool_or(instr(coalesce(win_name, ''), '---') > 0) AS any_list FROM can_2017 GROUP BY 1)
"""


def link_pairs(t: Tables) -> DataFrame:
    est = C.parse_bool(c("future_can_id_estimated"))
    ev = t.cn_2017.select(c("id_notice_cn").alias("cn"), F.explode(notice_numbers(c("future_can_id"))).alias("can"), est.alias("est"))
    yes, no = F.bool_or("est"), F.bool_or(~c("est"))
    return ev.groupBy("cn", "can").agg(F.when(yes & no, "mixed").when(yes, "estimated").when(no, "certain").otherwise("unknown").alias("estimation"))


def can_summary(t: Tables) -> DataFrame:
    return t.can_2017.groupBy(c("id_notice_can").alias("can")).agg(F.count("*").alias("n_rows"), F.count_distinct("win_name").alias("n_winners"), F.bool_or(C.is_list_field(c("win_name"))).alias("any_list"))


@BOOK.query(_LINK + "SELECT * FROM pr")
def lnk_01_pairs(t: Tables) -> DataFrame:
    return link_pairs(t)


@BOOK.query(_LINK + "SELECT * FROM cs")
def lnk_02_can_summary(t: Tables) -> DataFrame:
    return can_summary(t)


@BOOK.query(_LINK + "SELECT cn, count(*) AS n_links, count(cs.can) AS n_found, coalesce(sum(n_winners), 0) AS n_winners, CASE WHEN count(cs.can) = 0 THEN 'unlinked' WHEN count(*) = 1 THEN 'one_to_one' WHEN count(cs.can) = count(*) THEN 'several' ELSE 'partial' END AS structure FROM pr LEFT JOIN cs USING (can) GROUP BY 1")
def lnk_03_link_status(t: Tables) -> DataFrame:
    x = link_pairs(t).join(can_summary(t).withColumn("_f", F.lit(1)), "can", "left")
    per = x.groupBy("cn").agg(F.count("*").alias("n_links"), F.count("_f").alias("n_found"), F.coalesce(F.sum("n_winners"), F.lit(0)).alias("n_winners"))
    return per.withColumn("structure", C.first_of((c("n_found") == 0, "unlinked"), (c("n_links") == 1, "one_to_one"), (c("n_found") == c("n_links"), "several"), otherwise="partial"))


@BOOK.query(f"SELECT m, count(*) AS n_refs, count(x) AS n_parsed, count(c.k) AS n_found FROM (SELECT month(loaded_at) AS m, nullif(regexp_extract(id_notice_can_clean, '{_NUM}'), '') AS x FROM cn_future_can_pair_evidence) e LEFT JOIN (SELECT DISTINCT id_notice_can AS k FROM can_2017) c ON c.k = {_CANON.format('x')} GROUP BY 1")
def prf_07_linkability(t: Tables) -> DataFrame:
    keys = t.can_2017.select(c("id_notice_can").alias("x"), F.lit(1).alias("_f")).distinct()
    refs = t.cn_future_can_pair_evidence.select(F.month("loaded_at").alias("m"), canonical_notice(c("id_notice_can_clean")).alias("x"))
    return refs.join(keys, "x", "left").groupBy("m").agg(F.count("*").alias("n_refs"), F.count("x").alias("n_parsed"), F.count("_f").alias("n_found"))


# profiling

@BOOK.query("SELECT xsd_version, " + ", ".join(f"round(100.0 * count(nullif(trim({x}), '')) / count(*), 6) AS {x}" for x in ("cae_nationalid", "win_nationalid", "crit_weights", "award_value_euro")) + " FROM can_2017 GROUP BY 1")
def prf_01_version_coverage(t: Tables) -> DataFrame:
    return t.can_2017.groupBy("xsd_version").agg(*[F.round(100.0 * F.count(C.clean_text(c(x))) / F.count("*"), 6).alias(x) for x in ("cae_nationalid", "win_nationalid", "crit_weights", "award_value_euro")])


@BOOK.query("SELECT rows_per_key, count(*) AS n_keys FROM (SELECT id_notice_cn, count(*) AS rows_per_key FROM cn_2017 GROUP BY 1) GROUP BY 1")
def prf_02_grain(t: Tables) -> DataFrame:
    return A.counts_of_counts(t.cn_2017, ["id_notice_cn"])


_VAR = ("cae_name", "cae_town", "cpv", "win_name", "title", "dt_award")


@BOOK.query("WITH p AS (SELECT id_notice_can, count(*) AS n, " + ", ".join(f"count(DISTINCT {x}) > 1 AS {x}" for x in _VAR) + " FROM can_2017 GROUP BY 1 HAVING count(*) > 1) " + " UNION ALL ".join(f"SELECT '{x}' AS field, count(*) AS n_repeated_keys, count(*) FILTER (WHERE {x}) AS n_varying, round(count(*) FILTER (WHERE {x}) / count(*), 6) AS share_varying FROM p" for x in _VAR))
def prf_03_variability(t: Tables) -> DataFrame:
    return A.variability(t.can_2017, ["id_notice_can"], list(_VAR))


@BOOK.query(f"SELECT notice_year, count(dt_award) AS n_given, count({S._DATE.format('dt_award')}) AS n_parsed, min({S._DATE.format('dt_award')}) AS first_date, max({S._DATE.format('dt_award')}) AS last_date FROM can_2017 GROUP BY 1")
def prf_04_date_parse(t: Tables) -> DataFrame:
    d = C.parse_date(c("dt_award"))
    return t.can_2017.groupBy("notice_year").agg(F.count("dt_award").alias("n_given"), F.count(d).alias("n_parsed"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))


_MARKS = {"dashes": "---", "semicolon": ";", "comma": ",", "pipe": "|", "break": "\n"}
_LISTS = ("additional_cpvs", "future_can_id", "crit_criteria", "crit_weights", "tal_location_nuts")


@BOOK.query(" UNION ALL ".join(f"SELECT '{f}' AS field, " + ", ".join(f"count(*) FILTER (WHERE contains({f}, " + ("chr(10)" if m == "\n" else f"'{m}'") + f")) AS n_{k}" for k, m in _MARKS.items()) + " FROM cn_2017" for f in _LISTS))
def prf_05_delimiters(t: Tables) -> DataFrame:
    """Which delimiters occur in which field, in one scan."""
    one = t.cn_2017.agg(*[F.count_if(F.contains(c(f), F.lit(m))).alias(f"{f}__{k}") for f in _LISTS for k, m in _MARKS.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), *[c(f"{f}__{k}").alias(f"n_{k}") for k in _MARKS]) for f in _LISTS])
    return one.select(F.inline(rows))


@BOOK.query("SELECT cae_type, type_of_contract, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM cn_2017 GROUP BY 1, 2")
def prf_06_distributions(t: Tables) -> DataFrame:
    per = t.cn_2017.groupBy("cae_type", "type_of_contract").agg(F.count("*").alias("n"))
    return per.select("cae_type", "type_of_contract", "n", F.round(100.0 * c("n") / per.agg(F.sum("n")).scalar(), 6).alias("pct"))


@BOOK.query("SELECT column_name, n_rows, n_values, share FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) AS n_rows, count({'nullif(trim(' + x + '), ' + chr(39) * 2 + ')' if x not in ('doc_id', 'n_chars') else x}) AS n_values, round(count({'nullif(trim(' + x + '), ' + chr(39) * 2 + ')' if x not in ('doc_id', 'n_chars') else x}) / count(*), 6) AS share FROM documents" for x in ("doc_id", "text", "lang", "source", "n_chars")) + ")")
def aud_02_null_rates(t: Tables) -> DataFrame:
    return T.coverage(t.documents, ["doc_id", "text", "lang", "source", "n_chars"])


@BOOK.query("SELECT row_number() OVER ()::INT AS position, column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS column_type FROM (DESCRIBE can_2017)")
def src_07_schema(t: Tables) -> DataFrame:
    return T.schema_table(t.can_2017)


@BOOK.query("SELECT source_row_id, cae_name, CAST(NULL AS VARCHAR) AS absent_field, '2017' AS source_year FROM cn_2017")
def src_06_select_with_missing(t: Tables) -> DataFrame:
    x = T.select_with_missing(t.cn_2017, ["cae_name", "absent_field", "source_row_id"], source_year="2017")
    return x.select(c("source_row_id").cast("long"), "cae_name", "absent_field", "source_year")


@BOOK.query("SELECT record_id, feed_name, trust_rank FROM cn_notice JOIN notice_feed USING (feed_name) WHERE trust_rank >= 4")
def src_04_scan(t: Tables) -> DataFrame:
    return t.cn_notice.select("record_id", "feed_name").join(t.notice_feed, "feed_name").filter("trust_rank >= 4").select("record_id", "feed_name", "trust_rank")


# scoring of extractions

_SETS = "WITH a AS (SELECT o_custkey AS k, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS g, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS p FROM orders GROUP BY 1)"


def _sets(t: Tables) -> DataFrame:
    return t.orders.groupBy(c("o_custkey").alias("k")).agg(*[F.collect_set(F.when(c("o_orderstatus") == s, c("o_orderpriority"))).alias(n) for s, n in (("F", "g"), ("O", "p"))])


@BOOK.query(_SETS + " SELECT k, round(CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(g, p)) / (len(g) + len(p)) END, 9) AS f1, round(CASE WHEN len(g) + len(p) = 0 THEN 1.0 ELSE len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))) END, 9) AS jaccard FROM a")
def llm_02_set_scores(t: Tables) -> DataFrame:
    return _sets(t).select("k", F.round(V.set_f1(c("g"), c("p")), 9).alias("f1"), F.round(V.jaccard(c("g"), c("p")), 9).alias("jaccard"))


_SENT = "trim(string_split(item_text, '.')[1])"


@BOOK.query(f"SELECT item_id, len({_SENT}) > 0 AND contains(lower(trim(regexp_replace(item_text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(upper({_SENT}), '\\s+', ' ', 'g')))) AS grounded FROM eval_items")
def llm_07_grounding(t: Tables) -> DataFrame:
    return t.eval_items.select("item_id", V.grounded(c("item_text"), F.upper(F.trim(F.element_at(F.split("item_text", r"\."), 1)))).alias("grounded"))


#: The benchmarks an item may belong to.
BENCHMARKS = ("e3_intent", "e3b_advisory", "e4_evidence", "e5_explanation")


@BOOK.query(f"""SELECT unnest(['n_items', 'missing_ids', 'repeated_ids', 'missing_texts', 'unknown_benchmarks', 'repeated_variants', 'incomplete_cases', 'short_texts', 'ungrounded_openings']) AS metric, unnest([(SELECT count(*) FROM eval_items), (SELECT count(*) FROM eval_items WHERE item_id IS NULL), (SELECT count(item_id) - count(DISTINCT item_id) FROM eval_items),
  (SELECT count(*) FROM eval_items WHERE nullif(trim(item_text), '') IS NULL), (SELECT count(*) FROM eval_items WHERE coalesce(benchmark_name, '') NOT IN ({', '.join(f"'{b}'" for b in BENCHMARKS)})), (SELECT count(*) FROM (SELECT 1 FROM eval_items GROUP BY benchmark_name, case_id HAVING count(*) > 1)),
  (SELECT count(*) FROM (SELECT case_id FROM eval_items GROUP BY 1 HAVING count(DISTINCT benchmark_name) < {len(BENCHMARKS)})), (SELECT count(*) FROM eval_items WHERE len(string_split_regex(trim(item_text), '\\s+')) < 15), (SELECT count(*) FROM eval_items WHERE NOT contains(lower(item_text), lower(string_split(item_text, '.')[1])))])::DOUBLE AS value""")
def llm_01_validation(t: Tables) -> DataFrame:
    """What a benchmark must be: ids and variants unique, benchmarks known, cases complete, texts long enough, quotes grounded in their text."""
    one = T.ledger(t.eval_items, {
        "n_items": F.count("*"), "missing_ids": F.count_if(c("item_id").isNull()), "repeated_ids": F.count("item_id") - F.count_distinct("item_id"), "missing_texts": F.count_if(C.clean_text(c("item_text")).isNull()),
        "unknown_benchmarks": F.count_if(~F.coalesce("benchmark_name", F.lit("")).isin(*BENCHMARKS)), "short_texts": F.count_if(F.size(F.split(F.trim("item_text"), r"\s+")) < 15),
        "ungrounded_openings": F.count_if(~V.grounded(c("item_text"), F.element_at(F.split("item_text", r"\."), 1))),
    })
    variants = t.eval_items.groupBy("benchmark_name", "case_id").agg(F.count("*").alias("n"))
    cases = variants.groupBy("case_id").agg(F.count("benchmark_name").alias("b"), F.count_if(c("n") > 1).alias("r"))
    two = T.ledger(cases, {"repeated_variants": F.coalesce(F.sum("r"), F.lit(0)), "incomplete_cases": F.count_if(c("b") < len(BENCHMARKS))})
    return one.unionByName(two)


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(item_text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@BOOK.query(f"""WITH v AS (SELECT case_id, benchmark_name AS b, {_TOK} AS s FROM eval_items), p AS (SELECT x.case_id, avg(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))) AS m FROM v x JOIN v y ON x.case_id = y.case_id AND x.b < y.b GROUP BY 1)
SELECT case_id, count(*) AS n_variants, round(coalesce(max(m), 0), 9) AS consistency FROM v LEFT JOIN p USING (case_id) GROUP BY 1""")
def llm_04_consistency(t: Tables) -> DataFrame:
    v = t.eval_items.select("case_id", "benchmark_name", F.array_distinct(F.split(C.match_text(c("item_text")), " ")).alias("s"))
    return V.pairwise_consistency(v, "case_id", "benchmark_name", "s").withColumn("consistency", F.round("consistency", 9))


@BOOK.query()
def llm_05_bounded_weights(t: Tables) -> DataFrame:
    """Weights moved by deltas, within bounds and summing to one."""
    d = [F.when(c("o_orderkey") % 4 == k, 0.15).otherwise(-0.05 * (k % 2)) for k in range(4)]
    return t.orders.select("o_orderkey", V.bounded_weights([F.lit(0.25)] * 4, d).alias("weights"))


@BOOK.query()
def llm_09_claim_matches(t: Tables) -> DataFrame:
    """Sentences of one case's texts matched one to one across two benchmarks."""
    s = t.eval_items.select("case_id", "benchmark_name", F.posexplode(F.split("item_text", r"(?<=[.!?])\s+")).alias("idx", "quote"))
    side: Column = F.when(c("benchmark_name") == "e3_intent", "gold").when(c("benchmark_name") == "e4_evidence", "found")
    return V.match_claims(s.select(c("case_id").alias("packet"), side.alias("side"), c("idx").cast("long").alias("idx"), "quote", c("quote").alias("claim"), F.lit("a").alias("aspect")).filter("side is not null"), 0.6)


@BOOK.query("SELECT item_id, array_to_string(list_filter(string_split(replace(replace(replace(item_text, '. ', '.' || chr(1)), '? ', '?' || chr(1)), '! ', '!' || chr(1)), chr(1)), lambda s: NOT contains(s, 'Group')), ' ') AS kept FROM eval_items")
def llm_12_drop_sentences(t: Tables) -> DataFrame:
    return t.eval_items.select("item_id", V.drop_sentences(c("item_text"), "Group").alias("kept"))
