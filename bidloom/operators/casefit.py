"""The case matrix: how well every supplier of a case's pool fits the case, in seventeen features.

Features that depend on the target side alone are switched off where the target lacks the
value, by one mask per feature. Cases with the same target side share one signature and are
computed once. Sets of codes are matched through sparse joins of the tokens; small
supplier-side counts (countries, criteria, flags) travel in one profile per supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators.ranking import Group

#: The features by conceptual group, the flags of a procedure's regime, the models and scenarios over the groups.
ACTIVITY = ("buyer_breadth", "public_activity_recency", "context_specialization")
GROUPS = {
    "original": ("cpv2_experience", *ACTIVITY),
    "category": ("cpv2_experience", "cpv_exact_set_fit", "cpv4_set_fit", "cpv3_set_fit"),
    "activity": ACTIVITY,
    "geography": ("country_fit", "nuts1_fit", "nuts2_fit", "nuts3_fit"),
    "buyer": ("prior_buyer_count", "prior_buyer_recency", "buyer_relationship_share"),
    "regime": ("regime_match_share",),
    "criteria": ("crit_code_fit", "price_weight_similarity"),
}
FEATURES = tuple(dict.fromkeys(x for g in GROUPS.values() for x in g))
REGIME = ("b_fra_agreement", "b_gpa", "b_eu_funds", "b_electronic_auction", "b_on_behalf")
MODELS = {
    "M0_ORIGINAL": ("original",),
    "M1_CATEGORY_SET": ("category", "activity"),
    "M2_GEO": ("category", "geography", "activity"),
    "M2_BUYER": ("category", "buyer", "activity"),
    "M3_GEO_BUYER": ("category", "geography", "buyer", "activity"),
    "M4_SELECTED_REGIME": ("category", "geography", "buyer", "regime", "activity"),
    "M5_STRUCTURED_CRITERIA": ("category", "geography", "buyer", "regime", "criteria", "activity"),
}
ABLATIONS = {
    "M0_ORIGINAL": ("original",),
    "M3_FULL": ("category", "geography", "buyer", "activity"),
    "ABLATE_CATEGORY": ("geography", "buyer", "activity"),
    "ABLATE_GEOGRAPHY": ("category", "buyer", "activity"),
    "ABLATE_BUYER": ("category", "geography", "activity"),
    "ABLATE_ACTIVITY": ("category", "geography", "buyer"),
    "CATEGORY_ONLY": ("category",),
    "GEOGRAPHY_ONLY": ("geography",),
    "BUYER_ONLY": ("buyer",),
    "ACTIVITY_ONLY": ("activity",),
}
SCENARIOS = {
    "BALANCED": {"category": 0.25, "geography": 0.25, "buyer": 0.25, "activity": 0.25},
    "CONTINUITY": {"category": 0.25, "geography": 0.20, "buyer": 0.40, "activity": 0.15},
    "DIVERSIFICATION": {"category": 0.30, "geography": 0.35, "buyer": 0.10, "activity": 0.25},
}
FOCUS = {"CONTINUITY": "buyer", "DIVERSIFICATION": "geography"}
#: The levels of a set of codes: feature, what is cut from the case's array, to which length.
LEVELS = (("cpv_exact_set_fit", "codes", 8), ("cpv4_set_fit", "codes", 4), ("cpv3_set_fit", "codes", 3), ("nuts1_fit", "regions", 3), ("nuts2_fit", "regions", 4), ("nuts3_fit", "regions", 5))
TARGET = ("c2", "d", "codes", "regions", "country", "b", *REGIME, "crit", "pw")


def equal_weights(groups: tuple[str, ...]) -> dict[str, float]:
    return dict.fromkeys(groups, 1.0 / len(groups))


def groups() -> list[Group]:
    return [Group(name, columns, {x: f"on_{x}" for x in columns}) for name, columns in GROUPS.items()]


def _tokens(df: DataFrame, key: str) -> DataFrame:
    """Each set of codes once per level: ``key, feature, value, m`` (how many values the set has)."""
    sets = [F.struct(F.lit(f).alias("feature"), F.array_distinct(F.transform(_long(c, n), _cut(n))).alias("vs")) for f, c, n in LEVELS]
    each = df.select(key, F.inline(F.array(*sets)))
    return each.select(key, "feature", F.size("vs").alias("m"), F.explode("vs").alias("value"))


def _cut(n: int):
    return lambda x: F.substring(x, 1, n)


def _long(column: str, n: int) -> Column:
    return F.filter(column, lambda x: F.length(x) >= n)


def _counts(history: DataFrame, column: str, name: str) -> DataFrame:
    """Per supplier a map from the values of ``column`` to how many awards have it; the values are few."""
    per = history.filter(F.col(column).isNotNull()).groupBy("s", column).agg(F.count("*").alias("n"))
    return per.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(name))


def with_signature(targets: DataFrame) -> DataFrame:
    """``targets`` with ``sig``: what of a case its features depend on."""
    parts = [F.coalesce(F.array_join(c, "|") if c in ("codes", "regions") else F.col(c).cast("string"), F.lit("\0")) for c in TARGET]
    return targets.withColumn("sig", F.xxhash64(*parts))


def case_matrix(history: DataFrame, targets: DataFrame) -> DataFrame:
    """``sig, s``, the seventeen ``FEATURES`` and for each ``on_<feature>``, for every signature of
    ``targets`` (as ``with_signature`` gives them) and every supplier of its context.

    Both have ``c2`` (the context), ``d`` (date), ``codes`` and ``regions`` (arrays), ``country``,
    ``b`` (buyer), the flags of ``REGIME``, ``crit`` and ``pw``; ``history`` also ``s``. Nulls switch
    the feature off on the target's side and count as nothing on the supplier's. Every award of
    the history must lie before every target. Empty tables give an empty result."""
    cases = targets.select("sig", *TARGET).dropDuplicates(["sig"])
    totals = history.groupBy("s").agg(F.count("*").alias("all_n"), *[f for x in REGIME for f in (F.count_if(x).alias(f"{x}_1"), F.count_if(~F.col(x)).alias(f"{x}_0"))])
    profile = totals.join(_counts(history, "country", "countries"), "s", "left").join(_counts(history, "crit", "criteria"), "s", "left")
    context = history.groupBy("c2", "s").agg(F.count("*").alias("n"), F.count_distinct("b").alias("nb"), F.max("d").alias("last"), F.median("pw").alias("h_pw"))
    relation = history.filter("b is not null").groupBy("b", "s").agg(F.count("*").alias("rel_n"), F.max("d").alias("rel_last")).withColumn("rel_share", F.col("rel_n") / F.sum("rel_n").over(Window.partitionBy("s")))
    index = _tokens(history.withColumn("_k", F.monotonically_increasing_id()).select("_k", "s", "codes", "regions").withColumn("_ks", F.struct("_k", "s")), "_ks")
    index = index.groupBy(F.col("_ks.s").alias("s"), "feature", "value").agg(F.log1p(F.count("*")).alias("support"))
    fits = _tokens(cases, "sig").join(index, ["feature", "value"]).groupBy("sig", "s").agg(*[F.sum(F.when(F.col("feature") == f, F.col("support") / F.col("m"))).alias(f) for f, _, _ in LEVELS])
    x = cases.join(context, "c2").join(fits, ["sig", "s"], "left").join(relation, ["b", "s"], "left").join(profile, "s")

    none = F.lit(0.0)
    gap = F.datediff("d", "rel_last")
    shares, known = none, F.lit(0)
    for f in REGIME:
        all_ = F.col(f"{f}_1") + F.col(f"{f}_0")
        shares = shares + F.when(F.col(f).isNotNull() & (all_ > 0), F.when(F.col(f), F.col(f"{f}_1")).otherwise(F.col(f"{f}_0")) / all_).otherwise(0.0)
        known = known + F.col(f).isNotNull().cast("int")
    value: dict[str, Column] = {
        "cpv2_experience": F.log1p("n"), "buyer_breadth": F.log1p("nb"), "public_activity_recency": 1.0 / (1 + F.datediff("d", "last")), "context_specialization": F.col("n") / F.col("all_n"),
        **{f: F.coalesce(f, none) for f, _, _ in LEVELS},
        "country_fit": F.log1p(F.coalesce(F.element_at("countries", F.col("country")), F.lit(0))),
        "prior_buyer_count": F.log1p(F.coalesce("rel_n", F.lit(0))), "prior_buyer_recency": F.when(gap >= 0, 1.0 / (1 + gap)).otherwise(0.0), "buyer_relationship_share": F.coalesce("rel_share", none),
        "regime_match_share": F.when(known > 0, shares / known).otherwise(0.0),
        "crit_code_fit": F.log1p(F.coalesce(F.element_at("criteria", F.col("crit")), F.lit(0))),
        "price_weight_similarity": F.coalesce(1 - F.least(F.abs(F.col("h_pw") - F.col("pw")) / 100, F.lit(1.0)), none),
    }
    on: dict[str, Column] = dict.fromkeys(GROUPS["original"], F.lit(True))
    on |= {f: F.size(_long(c, n)) > 0 for f, c, n in LEVELS}
    on |= {"country_fit": F.col("country").isNotNull(), **dict.fromkeys(GROUPS["buyer"], F.col("b").isNotNull()), "regime_match_share": known > 0, "crit_code_fit": F.col("crit").isNotNull(), "price_weight_similarity": F.col("pw").isNotNull()}
    return x.select("sig", "s", *[value[f].cast("double").alias(f) for f in FEATURES], *[F.coalesce(on[f], F.lit(False)).alias(f"on_{f}") for f in FEATURES])
