"""Scores and ranks of candidates within cases: ties, multi-criteria methods, evaluation."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 50)


def score12(c: Column) -> Column:
    """A score to twelve decimals, half to even: what counts as a tie."""
    return F.bround(c, 12)


def tied_ranks(df: DataFrame, case: list[str], score: str, descending: bool = True) -> DataFrame:
    """``best``, ``worst`` and ``mid`` rank and ``ties`` (size of the tie) of every row within its case."""
    order = F.desc(score) if descending else F.asc(score)
    out = df.withColumn("best", F.rank().over(Window.partitionBy(*case).orderBy(order))).withColumn("ties", F.count("*").over(Window.partitionBy(*case, score)))
    return out.withColumn("worst", F.col("best") + F.col("ties") - 1).withColumn("mid", (F.col("best") + F.col("worst")) / 2.0)


def winner_ranks(df: DataFrame, case: list[str], score: str, winner: Column, descending: bool = True) -> DataFrame:
    """The rank of each case's winner without sorting: how many score better and how many the same.

    ``winner`` is true for a case's winning row. The winner's score reaches the other rows by a
    window over the case, then two conditional counts give the ranks. Cases without their
    winner among the rows are left out."""
    own = F.max(F.when(winner, F.col(score))).over(Window.partitionBy(*case))
    x = df.withColumn("_own", own)
    better = F.col(score) > F.col("_own") if descending else F.col(score) < F.col("_own")
    out = x.groupBy(*case).agg(F.count("*").alias("pool_size"), (F.count_if(better) + 1).alias("best"), F.count_if(F.col(score) == F.col("_own")).alias("ties"), F.max("_own").alias("_o"))
    return case_record(out.filter("_o is not null").drop("_o"))


def case_record(df: DataFrame) -> DataFrame:
    """``pool_size``, ``best`` and ``ties`` to the whole evaluation record of a case."""
    out = df.withColumn("worst", F.col("best") + F.col("ties") - 1).withColumn("mid", (F.col("best") + F.col("worst")) / 2.0)
    out = out.withColumn("reciprocal_rank", 1.0 / F.col("mid")).withColumn("percentile_rank", F.when(F.col("pool_size") <= 1, 1.0).otherwise(1.0 - (F.col("mid") - 1) / (F.col("pool_size") - 1)))
    for k in CUTS:
        out = out.withColumn(f"at_{k}", F.col("mid") <= k)
    return out


def summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Hit shares in percent, mean reciprocal rank and percentile, median rank, mean tie and pool size."""
    hits = [F.round(100 * F.avg(F.col(f"at_{k}").cast("double")), 6).alias(f"w_at_{k}") for k in CUTS]
    return records.groupBy(*by).agg(
        F.count("*").alias("n_cases"), *hits, F.round(F.avg("reciprocal_rank"), 9).alias("mrr"), F.round(F.avg("percentile_rank"), 9).alias("mean_percentile"),
        F.median("mid").alias("median_rank"), F.round(F.avg("ties"), 6).alias("mean_ties"), F.round(F.avg("pool_size"), 6).alias("mean_pool"),
    )


def _with_stats(df: DataFrame, case: list[str], stats: dict[str, Column], spread: bool) -> DataFrame:
    """``df`` with aggregates over each case as columns: by one window, or, where a case may hold
    a large share of all rows (``spread``), aggregated map-side and joined back."""
    if spread:
        return df.join(df.groupBy(*case).agg(*[e.alias(k) for k, e in stats.items()]), case)
    w = Window.partitionBy(*case)
    return df.withColumns({k: e.over(w) for k, e in stats.items()})


def min_max(df: DataFrame, case: list[str], columns: list[str], spread: bool = False) -> DataFrame:
    """Each column scaled to 0..1 within its case as ``<c>_mm``; a constant column is 0."""
    out = _with_stats(df, case, {k: e for x in columns for k, e in ((f"_lo_{x}", F.min(x)), (f"_hi_{x}", F.max(x)))}, spread)
    lo, hi = (lambda x: F.col(f"_lo_{x}")), (lambda x: F.col(f"_hi_{x}"))
    scaled = {f"{x}_mm": F.when(hi(x) > lo(x), (F.col(x) - lo(x)) / (hi(x) - lo(x))).otherwise(0.0) for x in columns}
    return out.withColumns(scaled).drop(*[f"{k}_{x}" for x in columns for k in ("_lo", "_hi")])


def weighted_sum(df: DataFrame, case: list[str], columns: list[str], name: str = "wsm", spread: bool = False) -> DataFrame:
    """The mean of the min-max scaled columns."""
    out = min_max(df, case, columns, spread)
    return out.withColumn(name, sum((F.col(f"{x}_mm") for x in columns), F.lit(0.0)) / len(columns)).drop(*[f"{x}_mm" for x in columns])


def _normed(df: DataFrame, case: list[str], columns: list[str], spread: bool = False) -> DataFrame:
    """Vector-normalised columns ``<c>_v`` (0 where the norm is 0), their norm, greatest and least.

    Dividing by a norm keeps the order, so all statistics come from one pass over the case."""
    stats = {k: e for x in columns for k, e in ((f"{x}_n", F.sqrt(F.sum(F.col(x) * F.col(x)))), (f"{x}_hi", F.max(x)), (f"{x}_lo", F.min(x)))}
    if not spread:  # a window takes plain aggregates only
        stats |= {f"{x}_n": F.sum(F.col(x) * F.col(x)) for x in columns}
    out = _with_stats(df, case, stats, spread)
    if not spread:
        out = out.withColumns({f"{x}_n": F.sqrt(f"{x}_n") for x in columns})
    by = lambda x, c: F.when(F.col(f"{x}_n") > 0, F.col(c) / F.col(f"{x}_n")).otherwise(0.0)
    return out.withColumns({k: by(x, c) for x in columns for k, c in ((f"{x}_v", x), (f"{x}_hi", f"{x}_hi"), (f"{x}_lo", f"{x}_lo"))})


def _helpers(columns: list[str]) -> list[str]:
    return [f"{x}_{s}" for x in columns for s in ("n", "v", "hi", "lo")]


def closeness(plus2: Column, minus2: Column) -> Column:
    """d- / (d+ + d-) of squared distances; 0.5 where both are 0."""
    p, m = F.sqrt(plus2), F.sqrt(minus2)
    return F.when(p + m > 0, m / (p + m)).otherwise(0.5)


def topsis(df: DataFrame, case: list[str], weights: dict[str, float], costs: tuple[str, ...] = (), name: str = "topsis", spread: bool = False) -> DataFrame:
    """TOPSIS closeness within each case; columns in ``costs`` are better when less."""
    columns = list(weights)
    out = _normed(df, case, columns, spread)
    plus = minus = F.lit(0.0)
    for x, w in weights.items():
        best, worst = (f"{x}_lo", f"{x}_hi") if x in costs else (f"{x}_hi", f"{x}_lo")
        plus = plus + F.pow(w * (F.col(f"{x}_v") - F.col(best)), F.lit(2))
        minus = minus + F.pow(w * (F.col(f"{x}_v") - F.col(worst)), F.lit(2))
    return out.withColumn(name, closeness(plus, minus)).drop(*_helpers(columns))


def vikor(df: DataFrame, case: list[str], weights: dict[str, float], v: float = 0.5, name: str = "vikor", spread: bool = False) -> DataFrame:
    """VIKOR's Q within each case, less is better; degenerate spans count 0."""
    columns = list(weights)
    scaled = min_max(df, case, columns, spread)  # the regret is what is missing to the best; none where all are the same
    span = _with_stats(scaled, case, {f"_top_{x}": F.max(f"{x}_mm") for x in columns}, spread)
    regrets = [F.when(F.col(f"_top_{x}") > 0, w * (1 - F.col(f"{x}_mm"))).otherwise(0.0) for x, w in weights.items()]
    out = span.withColumn("_s", sum(regrets, F.lit(0.0))).withColumn("_r", F.greatest(*regrets) if len(regrets) > 1 else regrets[0])
    out = min_max(out.drop(*[f"_top_{x}" for x in columns], *[f"{x}_mm" for x in columns]), case, ["_s", "_r"], spread)
    return out.withColumn(name, v * F.col("_s_mm") + (1 - v) * F.col("_r_mm")).drop("_s", "_r", "_s_mm", "_r_mm")


@dataclass(frozen=True)
class Group:
    """A conceptual group of criteria; ``active`` maps a criterion to a column of the case that says whether it applies."""

    name: str
    columns: tuple[str, ...]
    active: dict[str, str] | None = None


def grouped_distances(df: DataFrame, case: list[str], groups: list[Group], spread: bool = False) -> DataFrame:
    """Per group its squared distances to the ideal and anti-ideal, ``<g>_plus`` and ``<g>_minus``
    (divided by the square of its usable criteria), and ``<g>_on``: whether it has any.

    A criterion is usable in a case if it applies and its norm is not 0. Every model or
    scenario over these groups is then a projection: the windows are computed once."""
    columns = list(dict.fromkeys(x for g in groups for x in g.columns))
    out = _normed(df, case, columns, spread)
    for g in groups:
        usable = {x: (F.col(f"{x}_n") > 0) & (F.col(g.active[x]) if g.active and x in g.active else F.lit(True)) for x in g.columns}
        m = sum((u.cast("int") for u in usable.values()), F.lit(0))
        plus = sum((F.when(u, F.pow(F.col(f"{x}_v") - F.col(f"{x}_hi"), F.lit(2))).otherwise(0.0) for x, u in usable.items()), F.lit(0.0))
        minus = sum((F.when(u, F.pow(F.col(f"{x}_v") - F.col(f"{x}_lo"), F.lit(2))).otherwise(0.0) for x, u in usable.items()), F.lit(0.0))
        out = out.withColumn(f"{g.name}_on", m > 0).withColumn(f"{g.name}_plus", F.when(m > 0, plus / (m * m)).otherwise(0.0)).withColumn(f"{g.name}_minus", F.when(m > 0, minus / (m * m)).otherwise(0.0))
    return out.drop(*_helpers(columns))


def combined(df: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """TOPSIS over groups from ``grouped_distances``: weights are renormalised over the groups
    that are on, and enter squared."""
    total = sum((F.when(F.col(f"{g}_on"), w).otherwise(0.0) for g, w in weights.items()), F.lit(0.0))
    plus = minus = F.lit(0.0)
    for g, w in weights.items():
        share = F.when(F.col(f"{g}_on") & (total > 0), w / total).otherwise(0.0)
        plus = plus + share * share * F.col(f"{g}_plus")
        minus = minus + share * share * F.col(f"{g}_minus")
    return df.withColumn(name, closeness(plus, minus))


def random_expectation(records: DataFrame, by: list[str]) -> DataFrame:
    """What a random order would reach on the same pools: hits min(1, k / n) and the mean reciprocal rank H_n / n.

    Pools are grouped by size first, so a harmonic number is computed once per size."""
    sizes = records.groupBy(*by, "pool_size").agg(F.count("*").alias("_m"))
    n = F.col("pool_size").cast("double")
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("pool_size").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    rated = sizes.withColumn("_h", harmonic / n)
    hits = [F.round(100 * F.sum(F.col("_m") * F.least(F.lit(1.0), k / n)) / F.sum("_m"), 6).alias(f"random_at_{k}") for k in CUTS]
    return rated.groupBy(*by).agg(F.sum("_m").alias("n_cases"), *hits, F.round(F.sum(F.col("_m") * F.col("_h")) / F.sum("_m"), 9).alias("random_mrr"))


def movement(a: DataFrame, b: DataFrame, case: list[str]) -> DataFrame:
    """How ranks move from ``a`` to ``b`` over the cases in both."""
    d = (F.col("b_mid") - F.col("a_mid")).alias("d")
    x = a.select(*case, F.col("mid").alias("a_mid"), F.col("reciprocal_rank").alias("a_rr")).join(b.select(*case, F.col("mid").alias("b_mid"), F.col("reciprocal_rank").alias("b_rr")), case).select(d, "a_rr", "b_rr")
    share = lambda rule: F.round(100.0 * F.count_if(rule) / F.count("*"), 6)
    return x.agg(
        F.count("*").alias("n_cases"), F.round(F.avg("d"), 6).alias("mean_move"), F.median("d").alias("median_move"), F.round(F.avg(F.abs("d")), 6).alias("mean_abs_move"),
        share(F.col("d") < 0).alias("pct_up"), share(F.col("d") == 0).alias("pct_same"), share(F.col("d") > 0).alias("pct_down"), F.round(F.avg("b_rr") - F.avg("a_rr"), 9).alias("delta_mrr"),
    )


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's and Spearman's correlation per group; Spearman's on mean ranks of ties. Where a
    side is constant it is 1 if both are, else 0."""
    r = tied_ranks(df, by, x).withColumnRenamed("mid", "_rx").drop("best", "worst", "ties")
    r = tied_ranks(r, by, y).withColumnRenamed("mid", "_ry").drop("best", "worst", "ties")

    def safe(a: str, b: str) -> Column:
        va, vb = F.stddev_pop(a), F.stddev_pop(b)
        return F.when((va > 0) & (vb > 0), F.corr(a, b)).when((va > 0) | (vb > 0), 0.0).otherwise(1.0)

    return r.groupBy(*by).agg(F.count("*").alias("n"), F.round(safe(x, y), 9).alias("pearson"), F.round(safe("_rx", "_ry"), 9).alias("spearman"))


def bootstrap(records: DataFrame, by: list[str], resamples: int = 300, seed: int = 42) -> DataFrame:
    """Percentile intervals of hits at ten and mean reciprocal rank over ``resamples`` resamples.

    Records of one rank are alike, so they are first counted per (``by``, ``mid``); drawing the
    cases anew, with replacement, is then one multinomial draw over these counts, exactly. What
    a task holds of a group is its distinct ranks, at most twice its largest pool, not its cases."""
    ranks = records.groupBy(*by, "mid").agg(F.count("*").alias("_m"), F.max("reciprocal_rank").alias("_rr"), F.max(F.col("at_10").cast("int")).alias("_hit"))

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mid")
        m, rr, hit = (pdf[x].to_numpy(dtype=float) for x in ("_m", "_rr", "_hit"))
        n, rng = int(m.sum()), np.random.default_rng([seed, zlib.crc32("|".join(str(pdf[x].iloc[0]) for x in by).encode())])
        got = np.array([(100 * w @ hit / n, w @ rr / n) for w in (rng.multinomial(n, m / n) for _ in range(resamples))])
        lo, hi = np.quantile(got, [0.025, 0.975], axis=0)
        return pd.DataFrame([[*(pdf[x].iloc[0] for x in by), resamples, lo[0], hi[0], lo[1], hi[1]]], columns=[*by, "resamples", "hit_lo", "hit_hi", "mrr_lo", "mrr_hi"])

    kinds = ", ".join(f"`{x}` {records.schema[x].dataType.simpleString()}" for x in by)
    return ranks.groupBy(*by).applyInPandas(drawn, f"{kinds}, resamples bigint, hit_lo double, hit_hi double, mrr_lo double, mrr_hi double")


def overlap_at(a: DataFrame, b: DataFrame, case: list[str], item: str, score: str, k: int) -> DataFrame:
    """The share of each case's top ``k`` items by ``a`` that are in its top ``k`` by ``b`` (ties by item)."""
    def top(df: DataFrame) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*case).orderBy(F.desc(score), item))).filter(F.col("_r") <= k).select(*case, item)

    one, two = top(a), top(b)
    both = one.join(two, [*case, item]).groupBy(*case).agg(F.count("*").alias("n_both"))
    return one.groupBy(*case).agg(F.count("*").alias("n")).join(both, case, "left").select(*case, F.round(F.coalesce("n_both", F.lit(0)) / F.col("n"), 9).alias("overlap"))
