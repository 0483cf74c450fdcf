"""The queries of the core's own data problems (several values in a field, rows that do
not parse, references that lead nowhere), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.operators.multivalue import Packed, split_fields
from bidloom.operators.references import notice_parents, notice_references, orphan_counts, orphans
from bidloom.sources.delimited import failed_lines, load_lines, loaded_rows
from bidloom.sources.tables import read_table

CN_FIELDS = [Packed("additional_cpvs", "codes"), Packed("future_can_id", "codes")]
CAN_FIELDS = [Packed("crit_criteria", "labels"), Packed("crit_weights", "weights", "crit_criteria")]


def _values(spark: SparkSession, sf_dir: str, min_values: int) -> DataFrame:
    cn = split_fields(read_table(spark, sf_dir, "cn_2017"), "source_row_id", CN_FIELDS, "cn_2017", min_values)
    can = split_fields(read_table(spark, sf_dir, "can_2017"), "source_row_id", CAN_FIELDS, "can_2017", min_values)
    return cn.unionByName(can)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the four packed fields where a field holds two or more."""
    return _values(spark, sf_dir, 2).drop("n_values")


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: values, rows, the longest list."""
    return _values(spark, sf_dir, 1).groupBy("ref_table", "field_name").agg(
        F.count("*").alias("n_items"), F.sum((F.col("n_values") == 1).cast("long")).alias("n_single"), F.max("pos").alias("max_pos")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines that cannot be loaded, with the reason."""
    return failed_lines(load_lines(read_table(spark, sf_dir, "can_2015_lines")))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other raw lines as CAN rows."""
    return loaded_rows(load_lines(read_table(spark, sf_dir, "can_2015_lines")))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = notice_references(read_table(spark, sf_dir, "cn_2017"), read_table(spark, sf_dir, "cn_future_can_pair_evidence"))
    return orphans(refs, notice_parents(read_table(spark, sf_dir, "can_2017"), read_table(spark, sf_dir, "can_withdrawn")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references to CAN notices that lead nowhere when all data is in."""
    return _orphans(spark, sf_dir).select("ref_table", "ref_row_id", F.col("key").alias("id_notice_can"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their counts per table and month of ``loaded_at``."""
    return orphan_counts(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p2_found, p2_loaded, p5_found, p5_counts)}

_NUMBER = r"(?:\d{4}-\d{8}|\d{8}-\d{4}|\d{12})"


def _canonical_sql(x: str) -> str:
    return f"CASE WHEN instr({x}, '-') = 9 THEN substr({x}, 10, 4) || substr({x}, 1, 8) ELSE replace({x}, '-', '') END"


_P5 = f"""
WITH refs AS (
  SELECT DISTINCT ref_table, ref_row_id, {_canonical_sql('k')} AS k, seen FROM (
    SELECT 'cn_2017' AS ref_table, source_row_id AS ref_row_id, unnest(regexp_extract_all(future_can_id, '{_NUMBER}')) AS k, loaded_at AS seen FROM cn_2017
    UNION ALL
    SELECT 'cn_future_can_pair_evidence', evidence_id, nullif(regexp_extract(id_notice_can_clean, '{_NUMBER}'), ''), loaded_at FROM cn_future_can_pair_evidence
  ) WHERE k IS NOT NULL
), last AS (
  SELECT {_canonical_sql("regexp_extract(id_notice_can, '" + _NUMBER + "')")} AS k, max(loaded_at) AS loaded FROM can_2017
  WHERE id_notice_can IS NOT NULL GROUP BY 1
), gone AS (
  SELECT {_canonical_sql("regexp_extract(id_notice_can, '" + _NUMBER + "')")} AS k, max(withdrawn_at) AS gone FROM can_withdrawn WHERE id_notice_can IS NOT NULL GROUP BY 1
), alive AS (SELECT last.k FROM last LEFT JOIN gone USING (k) WHERE gone.k IS NULL OR loaded > gone),
lost AS (SELECT * FROM refs WHERE k NOT IN (SELECT k FROM alive))
"""

ORACLE = {
    "p5_found": _P5 + "SELECT ref_table, ref_row_id, k AS id_notice_can FROM lost",
    "p5_counts": _P5
    + """SELECT ref_table, strftime(seen, '%Y-%m') AS ref_month, count(*) AS n_orphan_refs,
  count(DISTINCT ref_row_id) AS n_rows, count(DISTINCT k) AS n_orphan_keys FROM lost GROUP BY 1, 2""",
}
