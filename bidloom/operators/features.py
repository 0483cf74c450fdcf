"""Features of suppliers in contexts: pools, context activity, fit indices, relationships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pool:
    """A pool definition: suppliers with at least ``least`` awards in the context at ``level``."""

    name: str
    level: str
    least: int


def contexts(awards: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Each award once per level (name: column) as ``level, context``, in one scan."""
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.col(v).alias("context")) for k, v in levels.items()])
    return awards.select("*", F.inline(rows)).filter("context is not null")


def context_activity(awards: DataFrame, levels: dict[str, str], supplier: str, date: str) -> DataFrame:
    """Per level, context and supplier: awards, first and last date. One shuffle for all levels."""
    return contexts(awards, levels).groupBy("level", "context", F.col(supplier).alias("supplier")).agg(F.count("*").alias("n_awards"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def eligibility(activity: DataFrame, pools: list[Pool]) -> DataFrame:
    """Per pool, context and supplier that qualifies. Pools stay factored: cases and eligible
    suppliers meet only where a query needs the pairs."""
    specs = F.array(*[F.struct(F.lit(p.name).alias("pool"), F.lit(p.level).alias("_level"), F.lit(p.least).alias("_least")) for p in pools])
    return activity.select("*", F.inline(specs)).filter("level = _level and n_awards >= _least").drop("_level", "_least", "level")


def assignments(cases: DataFrame, case: str, levels: dict[str, str], pools: list[Pool]) -> DataFrame:
    """Per case and pool the context that applies; null where the case has none at that level."""
    specs = F.array(*[F.struct(F.lit(p.name).alias("pool"), F.col(levels[p.level]).alias("context")) for p in pools])
    return cases.select(case, "winner", F.inline(specs))


def pool_summary(assigned: DataFrame, eligible: DataFrame, case: str) -> DataFrame:
    """Per case and pool: its size, whether the winner is in it, whether it is empty.

    Sizes are counted per context once; the winner is looked up by key: the pairs of cases
    and suppliers are never formed."""
    sizes = eligible.groupBy("pool", "context").agg(F.count("*").alias("size"))
    member = eligible.select("pool", "context", F.col("supplier").alias("winner"), F.lit(True).alias("_in"))
    out = assigned.join(sizes, ["pool", "context"], "left").join(member, ["pool", "context", "winner"], "left")
    return out.select(case, "pool", "context", F.coalesce("size", F.lit(0)).alias("pool_size"), F.coalesce("_in", F.lit(False)).alias("winner_in"), F.col("size").isNull().alias("empty"))


def fit_index(awards: DataFrame, dimensions: dict[str, str], supplier: str) -> DataFrame:
    """Sparse counts per dimension, value and supplier, all dimensions in one shuffle."""
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(v).cast("string").alias("value")) for k, v in dimensions.items()])
    return awards.select(F.col(supplier).alias("supplier"), F.inline(rows)).filter("value is not null").groupBy("dimension", "value", "supplier").agg(F.count("*").alias("n_matched"))


def set_fit(cases: DataFrame, case: str, tokens: str, index: DataFrame) -> DataFrame:
    """Mean log support of a case's tokens: the sum over them of log(1 + n) per supplier, over
    how many tokens the case has, known or not."""
    each = cases.select(case, F.size(tokens).alias("_m"), F.explode(tokens).alias("value"))
    return each.join(index, "value").groupBy(case, "supplier").agg((F.sum(F.log1p("n_matched")) / F.first("_m")).alias("fit"))


def relationships(awards: DataFrame, buyer: str, supplier: str, date: str) -> DataFrame:
    """Per buyer and supplier: earlier awards, the last one's date, their share of the supplier's awards."""
    pairs = awards.groupBy(F.col(buyer).alias("buyer"), F.col(supplier).alias("supplier")).agg(F.count("*").alias("n_prior"), F.max(date).alias("last_prior"))
    return pairs.withColumn("prior_share", F.col("n_prior") / F.sum("n_prior").over(Window.partitionBy("supplier")))


def descriptors(awards: DataFrame, context: str, numbers: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """Per context: exact median, P75 and P90 of numbers, share of true flags, and how many rows know each."""
    out = [f for k, c in numbers.items() for f in (F.count(c).alias(f"{k}_n"), F.round(F.percentile(c, 0.5), 6).alias(f"{k}_p50"), F.round(F.percentile(c, 0.75), 6).alias(f"{k}_p75"), F.round(F.percentile(c, 0.9), 6).alias(f"{k}_p90"))]
    out += [f for k, c in flags.items() for f in (F.count(c).alias(f"{k}_n"), F.round(F.avg(c.cast("double")), 9).alias(f"{k}_share"))]
    return awards.groupBy(context).agg(F.count("*").alias("n_rows"), *out)


def temporal_firewall(history: DataFrame, targets: DataFrame, date: str) -> DataFrame:
    """One row: the last date of the history, the first of the targets, and whether the history lies strictly before."""
    first = targets.agg(F.min(date)).scalar()
    return history.agg(F.max(date).alias("last_history")).withColumn("first_target", first).withColumn("strict", F.col("last_history") < F.col("first_target"))


def bins(df: DataFrame, c: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``bin``: which quantile bin of the whole column a row falls in (right-closed, from 1)."""
    edges = df.agg(F.array_distinct(F.percentile(c, list(quantiles)))).scalar()
    return df.withColumn("_e", edges).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(c))) + 1).drop("_e")


def splits(df: DataFrame, date: str, shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """``split``: train, validation or test by distinct dates in order, so no date is in two.

    The dates are made distinct first; ranking them needs one task for as many rows as there
    are distinct dates, not cases."""
    dates = df.select(date).distinct()
    ranked = dates.withColumn("_r", F.row_number().over(Window.orderBy(date))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    at = F.col("_r") / F.col("_n")
    named = ranked.withColumn("split", F.when(at <= shares[0], "train").when(at <= shares[1], "validation").otherwise("test")).select(date, "split")
    return df.join(named, date)


def pooled_candidates(cases: DataFrame, context: DataFrame, relation: DataFrame) -> DataFrame:
    """The pools of all cases, with suppliers that a case cannot tell apart as one row: ``b, c2, n,
    np, k``, where ``k`` suppliers of context ``c2`` have ``n`` awards in it and ``np`` with buyer ``b``.

    ``cases`` has ``b, c2``, ``context`` ``c2, s, n``, ``relation`` ``b, s, np``. Only the few suppliers
    a buyer knows differ between cases of one context; all others come from the context's
    distribution of ``n``, less those. So pairs of cases and suppliers are never formed."""
    sig = cases.select("b", "c2").distinct()
    known = sig.join(relation, "b").join(context, ["c2", "s"]).select("b", "c2", "n", "np")
    few = known.groupBy("b", "c2", "n", "np").agg(F.count("*").alias("k"))
    taken = few.groupBy("b", "c2", "n").agg(F.sum("k").alias("_t"))
    spread = context.groupBy("c2", "n").agg(F.count("*").alias("k"))
    rest = sig.join(spread, "c2").join(taken, ["b", "c2", "n"], "left").withColumn("k", F.col("k") - F.coalesce("_t", F.lit(0))).filter("k > 0")
    return rest.select("b", "c2", "n", F.lit(0).cast("bigint").alias("np"), "k").unionByName(few)
