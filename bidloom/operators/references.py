"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.notice_ids import canonical_notice, notice_numbers


def references(df: DataFrame, ref_table: str, row_id: str, keys: Column, at: str = "loaded_at") -> DataFrame:
    """``ref_table, ref_row_id, key, at``: one row per row of ``df`` and key in the array ``keys``.

    A key named twice in a row counts once; null keys and empty arrays give no row. Only the
    columns needed are read.
    """
    return df.select(
        F.lit(ref_table).alias("ref_table"),
        F.col(row_id).cast("long").alias("ref_row_id"),
        F.explode(F.array_distinct(keys)).alias("key"),
        F.col(at).alias("at"),
    ).filter("key is not null")


def living_parents(parents: DataFrame, key: Column, loaded_at: str, withdrawn: DataFrame, withdrawn_key: Column, withdrawn_at: str) -> DataFrame:
    """The distinct keys (``key``) of parents that exist when all data is in.

    A withdrawn parent lives only if one of its rows was loaded after the withdrawal; rows
    of unknown load time do not bring it back, and a withdrawal of unknown time withdraws
    the parent for good. Of several withdrawals the latest counts. The parents are aggregated map-side to one row per key
    before they are shuffled, so a hot parent costs no more than any other.
    """
    last = parents.select(key.alias("key"), F.col(loaded_at).alias("_loaded")).filter("key is not null").groupBy("key").agg(F.max("_loaded").alias("_loaded"))
    gone = (
        withdrawn.select(withdrawn_key.alias("key"), F.col(withdrawn_at).alias("_gone")).filter("key is not null")
        .groupBy("key").agg(F.max("_gone").alias("_gone"), F.lit(True).alias("_was"))
    )
    return last.join(gone, "key", "left").filter("_was is null or _loaded > _gone").select("key")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose ``key`` is not among ``parents`` (distinct ``key``).

    The distinct keys of the references are anti-joined with the parents, so each key is
    looked up once however many rows name it; the orphan keys are then joined back to the
    rows. Both joins are on the key; a hot key's rows are split by AQE on the way back,
    where the other side has one row. Repeated rows count each; empty tables are fine (no
    parents: everything is an orphan).
    """
    missing = refs.select("key").distinct().join(parents, "key", "left_anti")
    return refs.join(missing, "key", "left_semi")


def orphan_counts(orphaned: DataFrame) -> DataFrame:
    """Per table and month: rows with an orphan, orphan references and distinct orphan keys.

    A reference of unknown time counts under a null month.
    """
    return orphaned.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month")).agg(
        F.count("*").alias("n_orphan_refs"), F.countDistinct("ref_row_id").alias("n_rows"), F.countDistinct("key").alias("n_orphan_keys")
    )


def notice_references(cn: DataFrame, evidence: DataFrame) -> DataFrame:
    """The CAN numbers that ``cn_2017`` and the extracted pairs refer to, as ``references``."""
    one = canonical_notice(F.col("id_notice_can_clean"))
    return references(cn, "cn_2017", "source_row_id", notice_numbers(F.col("future_can_id"))).unionByName(
        references(evidence, "cn_future_can_pair_evidence", "evidence_id", F.array(one))
    )


def notice_parents(can: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The CAN numbers that lead somewhere, as ``living_parents``."""
    number = canonical_notice(F.col("id_notice_can"))
    return living_parents(can, number, "loaded_at", withdrawn, number, "withdrawn_at")
