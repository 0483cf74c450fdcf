"""Scoring of structured extractions against gold: sets, quotes, claims, weights."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_f1(gold: Column, found: Column) -> Column:
    """F1 of two arrays as sets: 1 if both are empty, 0 if one is."""
    g, p = F.array_distinct(gold), F.array_distinct(found)
    both = F.size(F.array_intersect(g, p))
    return F.when((F.size(g) == 0) & (F.size(p) == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * both, F.size(g) + F.size(p)), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard's index of two arrays as sets: 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def grounded(text: Column, quote: Column) -> Column:
    """Whether a quote stands in a text, but for case and blanks. An empty quote does not."""
    def flat(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    return F.coalesce((F.length(flat(quote)) > 0) & F.contains(flat(text), flat(quote)), F.lit(False))


def pairwise_consistency(df: DataFrame, case: str, variant: str, items: str) -> DataFrame:
    """Mean Jaccard of every two variants of a case; 0 for cases of one variant."""
    a = df.select(case, F.col(variant).alias("_a"), F.col(items).alias("_x"))
    b = df.select(case, F.col(variant).alias("_b"), F.col(items).alias("_y"))
    pairs = a.join(b, case).filter("_a < _b").groupBy(case).agg(F.avg(jaccard(F.col("_x"), F.col("_y"))).alias("_m"))
    return df.groupBy(case).agg(F.count("*").alias("n_variants")).join(pairs, case, "left").select(case, "n_variants", F.coalesce("_m", F.lit(0.0)).alias("consistency"))


def drop_sentences(text: Column, mark: str) -> Column:
    """``text`` without the sentences that contain ``mark``."""
    return F.array_join(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: ~F.contains(s, F.lit(mark))), " ")


def bounded_weights(weights: list[Column], deltas: list[Column], low: float = 0.10, high: float = 0.45, rounds: int = 20) -> Column:
    """Weights moved by ``deltas``, kept within bounds and on the simplex, as an array.

    Each round clips and spreads what is missing over the weights that can still move, as an
    expression over the array: a bounded fold, no UDF."""
    w0 = F.array(*[w + d for w, d in zip(weights, deltas)])

    def step(acc: Column, _: Column) -> Column:
        clipped = F.transform(acc, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))
        total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
        missing = 1.0 - total
        free = F.aggregate(clipped, F.lit(0), lambda a, x: a + F.when(((missing > 0) & (x < high)) | ((missing < 0) & (x > low)), 1).otherwise(0))
        return F.transform(clipped, lambda x: x + F.when((free > 0) & (((missing > 0) & (x < high)) | ((missing < 0) & (x > low))), missing / free).otherwise(0.0))

    return F.transform(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), w0, step), lambda x: F.round(x, 6))


def match_claims(claims: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Greedy one-to-one matches of predicted to gold claims within a packet.

    ``claims``: ``packet, side ('gold' or 'found'), idx, quote, claim, aspect``. Similarity is
    .65 of the quotes' likeness, .30 of the claims', .05 for one aspect; likeness is the
    greater of token Jaccard and sequence ratio. Pairs of the greatest similarity are taken
    first, ties by gold and then found index. A packet is one text's claims, so a group is
    bounded by that text."""
    def like(a: str, b: str) -> float:
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        j = len(x & y) / len(x | y) if x | y else 1.0
        return max(j, difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower(), autojunk=False).ratio())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        gold, found = pdf[pdf["side"] == "gold"].to_dict("records"), pdf[pdf["side"] == "found"].to_dict("records")
        pairs = []
        for g in gold:
            for p in found:
                s = min(1.0, 0.65 * like(g["quote"], p["quote"]) + 0.30 * like(g["claim"], p["claim"]) + 0.05 * (g["aspect"] == p["aspect"]))
                if s >= threshold:
                    pairs.append((-s, g["idx"], p["idx"]))
        used_g, used_p, out = set(), set(), []
        for s, g, p in sorted(pairs):
            if g not in used_g and p not in used_p:
                used_g.add(g)
                used_p.add(p)
                out.append((pdf["packet"].iloc[0], g, p, round(-s, 6)))
        return pd.DataFrame(out, columns=["packet", "gold_idx", "found_idx", "similarity"])

    kind = claims.schema["packet"].dataType.simpleString()
    return claims.groupBy("packet").applyInPandas(one, f"packet {kind}, gold_idx long, found_idx long, similarity double")


def precision_recall(counts: DataFrame, matched: str, gold: str, found: str) -> DataFrame:
    """Adds precision, recall and F1; a packet without gold and found claims scores 1."""
    m, g, p = F.col(matched), F.col(gold), F.col(found)
    empty = (g == 0) & (p == 0)
    precision = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(m.cast("double"), p), F.lit(0.0)))
    recall = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(m.cast("double"), g), F.lit(0.0)))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)
