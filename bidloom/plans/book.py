"""A book of queries: each with its DataFrame form and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bidloom.sources.tables import read_table


class Tables:
    """The tables of one dataset as attributes, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


class Book:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.ORACLE[f.__name__] = sql
            return f

        return add
