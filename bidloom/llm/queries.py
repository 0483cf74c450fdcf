"""The queries of the problems on texts and entities, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.notice_ids import NUMBER, canonical_notice
from bidloom.llm.language import languages
from bidloom.llm.leakage import leaked_items
from bidloom.llm.matching import match_awards
from bidloom.llm.mixing import mix_sources
from bidloom.llm.survivors import Bundle, learned_dependency, long_form, surviving_records
from bidloom.llm.variants import variant_classes, variant_pairs
from bidloom.sources.tables import read_table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of each award row that has one."""
    return match_awards(read_table(spark, sf_dir, "can_2017"), read_table(spark, sf_dir, "supplier_dim"))[0].select("source_row_id", "supplier_entity_id")


def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the rule that matched and its confidence."""
    return match_awards(read_table(spark, sf_dir, "can_2017"), read_table(spark, sf_dir, "supplier_dim"))[0]


def p6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule its matches, the labelled among them, and its confidence."""
    return match_awards(read_table(spark, sf_dir, "can_2017"), read_table(spark, sf_dir, "supplier_dim"))[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the evaluation items it gives away."""
    return leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: the documents that give it away and the longest passage."""
    leaks = leaked_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("max_words"), F.min("n_changed").alias("min_changed"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn so that each source makes up its target share, with their repeats."""
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share reached per source."""
    return mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and of every segment of a mixed one, with a confidence."""
    return languages(read_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong, and the segments of mixed documents."""
    return languages(read_table(spark, sf_dir, "documents")).filter("lang_found is not null and (seg_no > 0 or not label_ok)").select("doc_id", "seg_no", "lang_found")


#: What stands in for a missing value (folded), and the divisions of the CPV.
FILLERS = (
    "", "-", "--", "-/-", ".", "..", "...", "?", "/", "0", "x", "xx", "xxx", "xxxx", "na", "n/a", "n.a.", "n.a", "nd", "n.d.", "b.d.", "n.n.", "nn", "k.a.", "s/n",
    "nil", "none", "null", "nan", "empty", "missing", "test", "tbd", "tba", "to be defined", "to be determined", "unknown", "not known", "not applicable",
    "not available", "not specified", "not registered", "not given", "no name", "no data", "anonymous", "see documents", "see notice", "see below", "various", "name", "town", "city",
    "unbekannt", "keine angabe", "keine angaben", "nicht angegeben", "nicht bekannt", "ohne angabe", "ohne", "keine", "siehe unterlagen", "siehe vergabeunterlagen", "ort", "stadt",
    "inconnu", "inconnue", "non renseigné", "non renseigne", "non communiqué", "non précisé", "sans objet", "sans nom", "néant", "voir documents", "voir dce", "ville",
    "desconocido", "no consta", "no especificado", "no disponible", "sin datos", "sin nombre", "ver pliegos", "ver documentos",
    "sconosciuto", "non specificato", "non disponibile", "non applicabile", "vedi documenti", "nessuno",
    "nieznany", "nieznane", "brak", "brak danych", "nie dotyczy", "zob. dokumenty", "onbekend", "niet van toepassing", "n.v.t.", "nvt", "geen", "zie documenten",
    "desconhecido", "não aplicável", "não especificado", "sem dados", "ver documentos", "ukendt", "ikke oplyst", "ikke relevant", "okänd", "ej angivet", "saknas",
    "123456789", "1234567890", "12345678", "0123456789",
)
CPV_DIVISIONS = "03 09 14 15 16 18 19 22 24 30 31 32 33 34 35 37 38 39 41 42 43 44 45 48 50 51 55 60 63 64 65 66 70 71 72 73 75 76 77 79 80 85 90 92 98".split()
EARLIEST = "1993-01-01"  # before the first notices of the journal


def _valid() -> dict[str, Column]:
    def text(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c))).isin(*FILLERS)

    amount = F.col("value_euro_max")
    return {
        # an impossible date lies before the journal began or years after the record came in
        "dt_dispatch_clean": (F.col("dt_dispatch_clean") >= F.lit(EARLIEST).cast("date")) & (F.col("dt_dispatch_clean") <= F.date_add(F.coalesce(F.col("received_at").cast("date"), F.lit("2090-01-01").cast("date")), 731)),
        "cae_name_clean": text("cae_name_clean") & F.col("cae_name_clean").rlike(r"\p{L}{2}"),
        "cae_nationalid_clean": text("cae_nationalid_clean") & F.col("cae_nationalid_clean").rlike(r"\d") & ~F.col("cae_nationalid_clean").rlike(r"^\D*(\d)(\1|\W)*\D*$"),
        "cae_town_clean": text("cae_town_clean") & F.col("cae_town_clean").rlike(r"\p{L}{2}"),
        "iso_country_code_clean": text("iso_country_code_clean"),
        "cpv_clean": F.col("cpv_clean").rlike(r"^\d{8}(-\d)?$") & F.substring("cpv_clean", 1, 2).isin(*CPV_DIVISIONS),
        # an amount of one euro or less, or of nothing but nines, is none
        "value_euro_max": (amount > 1) & ~F.isnan(amount) & ~F.regexp_replace(F.format_number(amount, 2), "[,.]", "").rlike(r"^9{5,}$"),
    }


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = read_table(spark, sf_dir, "notice_feed").groupBy("feed_name").agg(F.max("trust_rank").alias("trust_rank"))
    number = F.coalesce(canonical_notice(F.col("id_notice_cn_clean")), canonical_notice(F.col("ted_notice_url_clean")))
    return read_table(spark, sf_dir, "cn_notice").withColumn("notice", number).join(feeds, "feed_name", "left")


def _trust() -> list[Column]:
    return [~F.coalesce(F.col("has_core_notice_conflict"), F.lit(False)), F.col("trust_rank"), F.col("received_at")]


#: What a buyer's identifier fixes.
FIXED_BY_BUYER = ("cae_town_clean", "iso_country_code_clean")
P4_FIELDS = ("dt_dispatch_clean", "cae_name_clean", "cae_nationalid_clean", "cae_town_clean", "cpv_clean", "value_euro_max")


def _spellings(spark: SparkSession, sf_dir: str, table: str, field: str) -> DataFrame:
    return read_table(spark, sf_dir, table).groupBy(F.col(field).alias("name")).agg(F.count("*").alias("n")).filter("name is not null")


P3_FIELDS = (("can_2017", "win_name"), ("cn_2017", "cae_name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of spellings that name the same winner or the same buyer."""
    parts = [variant_pairs(variant_classes(_spellings(spark, sf_dir, t, f))).select(F.lit(f).alias("field_name"), "name_a", "name_b") for t, f in P3_FIELDS]
    return parts[0].unionByName(parts[1])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the class of the winner or buyer it names and its number of links."""
    parts = [variant_classes(_spellings(spark, sf_dir, t, f), count_links=True).select(F.lit(f).alias("field_name"), "name", "class_id", "n_links") for t, f in P3_FIELDS]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per notice of several records and field: the record whose value is kept. Every field is
    a bundle of its own here, as the cases are defined field by field."""
    valid = _valid()
    bundles = [Bundle(f, (f,), {f: valid[f]}) for f in P4_FIELDS]
    kept = surviving_records(_notices(spark, sf_dir), "notice", "record_id", _trust(), bundles)
    return long_form(kept, "notice", bundles).filter("n_records > 1").select(F.col("notice").alias("id_notice_cn_clean"), "field_name", F.col("record").alias("record_id"))


def p4_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per notice from consistent bundles: buyer and place are each taken whole, and
    the place's town and country must be those of the buyer's identifier where the records show a rule."""
    valid = _valid()
    notices = _notices(spark, sf_dir)
    bundles = [
        Bundle("dispatch", ("dt_dispatch_clean",), valid),
        Bundle("buyer", ("cae_name_clean", "cae_nationalid_clean"), valid),
        Bundle("place", ("cae_town_clean", "iso_country_code_clean"), valid),
        Bundle("object", ("cpv_clean", "value_euro_max"), valid),
    ]
    rules = tuple(learned_dependency(notices, "cae_nationalid_clean", f, valid["cae_nationalid_clean"] & valid[f]) for f in FIXED_BY_BUYER)
    return surviving_records(notices, "notice", "record_id", _trust(), bundles, rules).withColumnRenamed("notice", "id_notice_cn_clean")


QUERIES = {f.__name__: f for f in (p3_found, p3_classes, p4_found, p4_golden, p6_found, p6_matches, p6_rules, p7_found, p7_report, p8_mix, p8_shares, p9_segments, p9_found)}
_NOTICES_SQL = r"""
WITH r AS (
  SELECT c.*, coalesce(nullif(regexp_extract(id_notice_cn_clean, 'NUM'), ''), nullif(regexp_extract(ted_notice_url_clean, 'NUM'), '')) AS raw,
         coalesce(has_core_notice_conflict, false) AS conflict, trust_rank
  FROM cn_notice c LEFT JOIN notice_feed USING (feed_name)
), n AS (
  SELECT *, CASE WHEN instr(raw, '-') = 9 THEN substr(raw, 10, 4) || substr(raw, 1, 8) ELSE replace(raw, '-', '') END AS notice FROM r WHERE raw IS NOT NULL
), m AS (SELECT *, count(*) OVER (PARTITION BY notice) AS n_records FROM n)
"""
_VALID_SQL = {
    "dt_dispatch_clean": "dt_dispatch_clean >= DATE '1993-01-01' AND dt_dispatch_clean <= coalesce(received_at::DATE, DATE '2090-01-01') + 731",
    "cae_name_clean": r"lower(trim(cae_name_clean)) NOT IN (FILL) AND regexp_matches(cae_name_clean, '\p{L}{2}')",
    "cae_nationalid_clean": r"lower(trim(cae_nationalid_clean)) NOT IN (FILL) AND regexp_matches(cae_nationalid_clean, '\d') AND length(replace(regexp_replace(cae_nationalid_clean, '\D', '', 'g'), substr(regexp_replace(cae_nationalid_clean, '\D', '', 'g'), 1, 1), '')) > 0",
    "cae_town_clean": r"lower(trim(cae_town_clean)) NOT IN (FILL) AND regexp_matches(cae_town_clean, '\p{L}{2}')",
    "iso_country_code_clean": "lower(trim(iso_country_code_clean)) NOT IN (FILL)",
    "cpv_clean": r"regexp_matches(cpv_clean, '^\d{8}(-\d)?$') AND substr(cpv_clean, 1, 2) IN (DIVISIONS)",
    "value_euro_max": "value_euro_max > 1 AND NOT isnan(value_euro_max) AND NOT regexp_matches(replace(printf('%.2f', value_euro_max), '.', ''), '^9{5,}$')",
}
_P4_SQL = (
    _NOTICES_SQL
    + ", v AS ("
    + " UNION ALL ".join(f"SELECT notice, record_id, conflict, trust_rank, received_at, '{f}' AS field_name FROM m WHERE n_records > 1 AND {_VALID_SQL[f]}" for f in P4_FIELDS)
    + """)
SELECT notice AS id_notice_cn_clean, field_name, record_id FROM (
  SELECT *, row_number() OVER (PARTITION BY notice, field_name ORDER BY conflict, trust_rank DESC NULLS LAST, received_at DESC NULLS LAST, record_id DESC) AS k FROM v
) WHERE k = 1
"""
)


def _golden_sql() -> str:
    """Every choice of a record or none for buyer and place, those that break the rule left out,
    the best by the sums of trust; the other two bundles by themselves."""
    trust = ("one", "free", "ranked", "rank", "timed", "seen")

    def candidates(prefix: str, *fields: str) -> str:
        held = " + ".join(f"({f} IS NOT NULL)::INT" for f in fields)
        some = f"SELECT notice, record_id AS {prefix}_rec, {held} AS {prefix}_n, {', '.join(f'{t} AS {prefix}_{t}' for t in trust)}, {', '.join(fields)} FROM t WHERE {held} > 0"
        none = f"SELECT DISTINCT notice, NULL, 0, {', '.join('0' for _ in trust)}, {', '.join('NULL' for _ in fields)} FROM t"
        return f"{prefix} AS ({some} UNION ALL {none})"

    def best(prefix: str) -> str:
        order = ", ".join(f"{prefix}_{t} DESC" for t in ("n", *trust))
        return f"{prefix}_best AS (SELECT * FROM {prefix} QUALIFY row_number() OVER (PARTITION BY notice ORDER BY {order}, {prefix}_rec DESC NULLS LAST) = 1)"

    def fixed(f: str) -> str:
        shown = f"SELECT cae_nationalid_clean AS k, {f} AS v, count(*) AS c FROM m WHERE {_VALID_SQL['cae_nationalid_clean']} AND {_VALID_SQL[f]} GROUP BY 1, 2"
        return f", fixed_{f} AS (SELECT k, v FROM (SELECT *, sum(c) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY c DESC, v DESC) AS r FROM ({shown})) WHERE r = 1 AND c >= 0.8 * total AND c >= 2)\n"

    values = ", ".join(f"CASE WHEN {_VALID_SQL[f]} THEN {f} END AS {f}" for f in _VALID_SQL)
    sums = ", ".join(f"b_{t} + p_{t} DESC" for t in ("n", *trust))
    return _NOTICES_SQL + f"""
, t AS (SELECT notice, record_id, n_records, 1 AS one, (NOT conflict)::INT AS free, (trust_rank IS NOT NULL)::INT AS ranked, coalesce(trust_rank, 0) AS rank, (received_at IS NOT NULL)::INT AS timed,
   coalesce(epoch_us(received_at), 0)::HUGEINT AS seen, {values} FROM m)
{"".join(fixed(f) for f in FIXED_BY_BUYER)}
, {candidates("b", "cae_name_clean", "cae_nationalid_clean")}, {candidates("p", "cae_town_clean", "iso_country_code_clean")}
, {candidates("d", "dt_dispatch_clean")}, {candidates("o", "cpv_clean", "value_euro_max")}, {best("d")}, {best("o")}
, pick AS (
  SELECT * FROM b JOIN p USING (notice) {" ".join(f"LEFT JOIN fixed_{f} ON fixed_{f}.k = cae_nationalid_clean" for f in FIXED_BY_BUYER)}
  WHERE {" AND ".join(f"(fixed_{f}.v IS NULL OR {f} IS NULL OR fixed_{f}.v = {f})" for f in FIXED_BY_BUYER)}
  QUALIFY row_number() OVER (PARTITION BY notice ORDER BY {sums}, b_rec DESC NULLS LAST, p_rec DESC NULLS LAST) = 1)
SELECT notice AS id_notice_cn_clean, n_records, d_rec AS dispatch__record, dt_dispatch_clean, b_rec AS buyer__record, cae_name_clean, cae_nationalid_clean,
  p_rec AS place__record, cae_town_clean, iso_country_code_clean, o_rec AS object__record, cpv_clean, value_euro_max
FROM (SELECT DISTINCT notice, n_records FROM m) JOIN d_best USING (notice) JOIN pick USING (notice) JOIN o_best USING (notice)"""


def _quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _filled(sql: str) -> str:
    return sql.replace("NUM", NUMBER.replace(r"(?<!\d)(", "(?:").replace(r"(?!\d)", "")).replace("FILL", _quoted(FILLERS)).replace("DIVISIONS", _quoted(CPV_DIVISIONS))


ORACLE: dict[str, str] = {"p4_found": _filled(_P4_SQL), "p4_golden": _filled(_golden_sql())}
