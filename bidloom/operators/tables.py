"""Schemas and keys: what a table must have, and tables of uneven columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table does not hold what an operator needs."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, if it has all ``columns``."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ContractError(f"missing columns: {', '.join(absent)}")
    return df


def require_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` itself, if its columns are ``columns`` in that order."""
    if df.columns != list(columns):
        raise ContractError("columns differ from the schema in name or order")
    return df


def resolve_column(df: DataFrame, names: list[str]) -> str:
    """The first of several possible names that ``df`` has, whatever its case."""
    lower = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    raise ContractError(f"none of {', '.join(names)} is a column")


def select_with_missing(df: DataFrame, columns: list[str], **constants: object) -> DataFrame:
    """``columns`` in order as strings, null where ``df`` lacks one, and constant columns."""
    have = set(df.columns)
    return df.select(*[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in columns], *[F.lit(v).alias(k) for k, v in constants.items()])


def schema_table(df: DataFrame) -> DataFrame:
    """The columns of ``df`` with their position and type."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, if no two rows share ``keys``. Runs one aggregate that stops at the first repeat."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ContractError(f"{', '.join(keys)} is no key")
    return df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; columns are matched by name and null where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def nullable_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ledger(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One scan, many aggregates, as rows ``metric, value``."""
    one = df.agg(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(metrics.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"m{i}").alias("value")) for i, k in enumerate(metrics)])
    return one.select(F.inline(rows))


def coverage(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, values and their share, in one scan whatever the number of columns."""
    names = columns or df.columns
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    filled = [F.count(F.nullif(F.trim(c), F.lit("")) if c in text else F.col(c)).alias(f"c{i}") for i, c in enumerate(names)]
    one = df.agg(F.count("*").alias("n"), *filled)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_values")) for i, c in enumerate(names)])
    return one.select("n", F.inline(rows)).select("column_name", F.col("n").alias("n_rows"), "n_values", F.round(F.try_divide("n_values", "n"), 6).alias("share"))
