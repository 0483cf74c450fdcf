"""Incremental counts over arriving files; the same plan serves a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """The Parquet files of a folder as a stream, a bounded number per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(df: DataFrame, at: str, by: list[str], window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window and ``by``. On a stream, rows up to ``late`` behind the latest are counted and state older is dropped."""
    x = df.withWatermark(at, late) if df.isStreaming else df
    return x.groupBy(F.window(at, window).alias("_w"), *by).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("window_start"), *by, "n")
