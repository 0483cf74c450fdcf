"""Conservative resolution of suppliers: identifiers as anchors, names bridged to them, no fuzzy step and no closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C

MAX_NAMES = 20


def identities(rows: DataFrame, name: str, ident: str, country: str, town: str, group: Column | None = None) -> DataFrame:
    """``rows`` with the normalised parts of the supplier's identity: ``nid, name_norm, ctry,
    town_norm, nc_key, nt_key, is_group``. A key is null if one of its parts is."""
    n, k, t = C.normalize_entity(F.col(name)), C.upper_clean(F.col(country)), C.normalize_entity(F.col(town))
    return (
        rows.withColumn("is_group", C.group_or_list(group if group is not None else F.lit(False), F.col(name), F.col(ident), F.col(country), F.col(town)))
        .withColumn("name_norm", n).withColumn("ctry", k).withColumn("town_norm", t)
        .withColumn("nid", F.when(C.id_hygiene(F.col(ident), F.col(country), F.col("is_group")) == "candidate_valid_anchor", F.concat(k, F.lit("||"), C.normalize_identifier(F.col(ident)))))
        .withColumn("nc_key", F.when(F.length(k) == 2, F.concat(k, F.lit("||"), n))).withColumn("nt_key", F.concat(t, F.lit("||"), n))
    )


def anchors(known: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """Per identifier: rows, distinct names, and whether it is reliable (not too many names)."""
    pairs = known.filter("nid is not null and not is_group").groupBy("nid", "name_norm").agg(F.count("*").alias("n"))
    return pairs.groupBy("nid").agg(F.sum("n").alias("n_rows"), F.count("name_norm").alias("n_names")).withColumn("reliable", F.col("n_names") <= max_names)


def bridges(known: DataFrame, anchor: DataFrame) -> DataFrame:
    """Per name and country: how many reliable anchors it stands with, the only one if it is
    one, and the status ``one`` or ``ambiguous``."""
    good = anchor.filter("reliable").select("nid")
    pairs = known.filter("nc_key is not null and nid is not null and not is_group").select("nc_key", "nid").distinct().join(good, "nid")
    return pairs.groupBy("nc_key").agg(F.count("*").alias("n_anchors"), F.min("nid").alias("lo"), F.max("nid").alias("hi")).select(
        "nc_key", "n_anchors", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("bridge_nid"), F.when(F.col("lo") == F.col("hi"), "one").otherwise("ambiguous").alias("bridge_status"))


def entity_of(known: DataFrame, anchor: DataFrame, bridge: DataFrame) -> DataFrame:
    """``known`` with ``entity_id, method, confidence``, by precedence: none for groups, a
    reliable identifier, none where the name stands with several, the bridged identifier, the
    name and country, the name and town. The ladder is evaluated once, as a struct."""
    good = anchor.filter("reliable").select("nid", F.lit(True).alias("_reliable"))
    x = known.join(good, "nid", "left").join(bridge.select("nc_key", "bridge_nid", "bridge_status"), "nc_key", "left")

    def to(entity: Column, method: str, confidence: str) -> Column:
        return F.struct(entity.alias("entity_id"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    none = F.lit(None).cast("string")
    ladder = (
        F.when(F.col("is_group"), to(none, "group", "none"))
        .when(F.col("_reliable"), to(F.concat(F.lit("ID||"), F.col("nid")), "identifier", "high"))
        .when(F.col("bridge_status") == "ambiguous", to(none, "ambiguous", "none"))
        .when(F.col("bridge_status") == "one", to(F.concat(F.lit("ID||"), F.col("bridge_nid")), "bridge", "high"))
        .when(F.col("nc_key").isNotNull(), to(F.concat(F.lit("NC||"), F.col("nc_key")), "name_country", "medium"))
        .when(F.col("nt_key").isNotNull(), to(F.concat(F.lit("NT||"), F.col("nt_key")), "name_town", "low"))
        .otherwise(to(none, "unresolved", "none"))
    )
    return x.withColumn("_e", ladder).select("*", "_e.*").drop("_e", "_reliable", "bridge_nid", "bridge_status")


def dimension(resolved: DataFrame, name: str, date: str) -> DataFrame:
    """One row per entity: canonical name (most frequent, then latest, longest, first in order),
    aliases, rows and date range. The names of an entity are counted before they are compared."""
    names = resolved.filter("entity_id is not null").groupBy("entity_id", F.col(name).alias("alias")).agg(F.count("*").alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi"))
    first = Window.partitionBy("entity_id").orderBy(F.desc("n"), F.desc_nulls_last("hi"), F.desc_nulls_last(F.length("alias")), F.asc_nulls_last("alias"))
    ranked = names.withColumn("_r", F.row_number().over(first))
    return ranked.groupBy("entity_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col("alias"))).alias("canonical_name"), F.count("alias").alias("n_aliases"), F.sum("n").alias("n_rows"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))


def lookups(resolved: DataFrame) -> dict[str, DataFrame]:
    """Frozen lookups of a history: identifier, unique name and country, unique name and town,
    and the names that stand for several entities."""
    known = resolved.filter("entity_id is not null")

    def unique(key: str, only: bool) -> DataFrame:
        per = known.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
        return per.filter("lo = hi").select(key, F.col("lo").alias("entity_id")) if only else per.filter("lo <> hi").select(key)

    return {"nid": unique("nid", True), "nc_key": unique("nc_key", True), "nt_key": unique("nt_key", True), "ambiguous": unique("nc_key", False)}


def map_to_history(targets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``targets`` (from ``identities``) with ``entity_id`` and ``status``: identifier, ambiguous,
    name_country, name_town, none, or invalid for groups and nameless rows."""
    x = targets
    for k in ("nid", "nc_key", "nt_key"):
        x = x.join(tables[k].withColumnRenamed("entity_id", f"_{k}"), k, "left")
    x = x.join(tables["ambiguous"].withColumn("_amb", F.lit(True)), "nc_key", "left")
    status = C.first_of(
        (F.col("is_group") | F.col("name_norm").isNull(), "invalid"), (F.col("_nid").isNotNull(), "identifier"), (F.coalesce("_amb", F.lit(False)), "ambiguous"),
        (F.col("_nc_key").isNotNull(), "name_country"), (F.col("_nt_key").isNotNull(), "name_town"), otherwise="none")
    entity = F.when(status == "identifier", F.col("_nid")).when(status == "name_country", F.col("_nc_key")).when(status == "name_town", F.col("_nt_key"))
    return x.withColumn("status", status).withColumn("entity_id", entity).drop("_nid", "_nc_key", "_nt_key", "_amb")
