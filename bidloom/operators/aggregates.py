"""Aggregates beyond the built-in ones, all with partial aggregation before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimous(c: Column) -> Column:
    """The value that all non-null rows of a group share, else null. Needs no distinct set:
    the least and the greatest value are equal."""
    return F.when(F.min(c) == F.max(c), F.max(c))


def disagrees(c: Column) -> Column:
    """Whether a group holds two different non-null values."""
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def joined_set(c: Column, mark: str = " | ") -> Column:
    """The distinct values in order, joined."""
    return F.array_join(F.sort_array(F.collect_set(c)), mark)


def share(part: Column, whole: Column) -> Column:
    """``part / whole``; null where ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole)


def concentration(df: DataFrame, group: list[str], member: str, weight: Column | None = None) -> DataFrame:
    """Herfindahl index of each group over its members: the sum of squared shares.

    Members are pre-aggregated, so a hot group is summed from partial counts."""
    per = df.groupBy(*group, member).agg((F.count("*") if weight is None else F.sum(weight)).cast("double").alias("_w"))
    return per.groupBy(*group).agg((F.sum(F.col("_w") * F.col("_w")) / F.nullif(F.pow(F.sum("_w"), F.lit(2)), F.lit(0.0))).alias("hhi"), F.count(member).alias("n_members"))


def counts_of_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys have 1, 2, ... rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("n_keys"))


def conflicts(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per key: rows, and per field whether its rows disagree; ``in_conflict`` if any does."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[disagrees(F.col(f)).alias(f"{f}_differs") for f in fields])
    any_ = F.lit(False)
    for f in fields:
        any_ = any_ | F.col(f"{f}_differs")
    return out.withColumn("in_conflict", any_)


def variability(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per field: the keys of several rows, those whose rows disagree, and their share, in one pass."""
    per = conflicts(df, keys, fields).filter("n_rows > 1")
    one = per.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"{f}_differs")).alias(f"v{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("n_varying")) for i, f in enumerate(fields)])
    return one.select("n", F.inline(rows)).select("field", F.col("n").alias("n_repeated_keys"), "n_varying", F.round(F.try_divide(F.col("n_varying").cast("double"), "n"), 6).alias("share_varying"))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Ordered cumulative predicates: rows that pass each stage and all before, their share of
    all rows and of the stage before. One scan."""
    passed, columns = F.lit(True), []
    for i, (_, rule) in enumerate(stages):
        passed = passed & F.coalesce(rule, F.lit(False))
        columns.append(F.count_if(passed).alias(f"s{i}"))
    one = df.agg(F.count("*").alias("n"), *columns)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("n_left")) for i, (name, _) in enumerate(stages)])
    long = one.select("n", F.inline(rows))
    before = F.lag("n_left").over(Window.orderBy("step"))  # as many rows as stages
    return long.select("step", "stage", "n_left", F.round(F.try_divide(F.col("n_left").cast("double"), "n"), 6).alias("share_of_all"), F.round(F.try_divide(F.col("n_left").cast("double"), F.coalesce(before, "n")), 6).alias("share_of_previous"))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list, aggregate: Column) -> DataFrame:
    """A pivot with stated values, so that no pass is needed to find them."""
    return df.groupBy(*rows).pivot(column, values).agg(aggregate)


def repeated_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows repeat another exactly, as an aggregate over grouped rows."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("n_repeats"))
