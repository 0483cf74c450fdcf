"""Files: delimited text, Parquet, JSON lines, and reports."""

from __future__ import annotations

import csv
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom.operators.tables import ContractError

DELIMITERS = "\t,;|"
SAMPLE_LINES = 200
CORRUPT = "_corrupt_record"


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of a file by a bounded sample of its first lines; a tab where none shows."""
    lines = [r.value for r in spark.read.text(path).limit(SAMPLE_LINES).collect()]
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=DELIMITERS).delimiter
    except csv.Error:
        return "\t"


def read_header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The column names in a file's first line, without a byte order mark."""
    first = spark.read.text(path).first()
    return next(csv.reader([first.value.lstrip("﻿")], delimiter=sep)) if first else []


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A delimited file with every column a string. Short rows are padded with null; a row
    with too many fields stands in ``_corrupt_record`` as it is, to be looked at or to make the
    read fail (``reject_corrupt``). ``columns`` demands these names in this order."""
    sep = sep or sniff_delimiter(spark, path)
    header = read_header(spark, path, sep)
    if columns is not None and header != list(columns):
        raise ContractError("the header differs from the schema in name or order")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in header), T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.csv(path, schema=schema, sep=sep, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, encoding="UTF-8")
    bare = F.regexp_replace(CORRUPT, '"([^"]|"")*"', "")  # fields are counted by the delimiters outside quotes
    many = (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep) + 1 > len(header)
    return rows.withColumn(CORRUPT, F.when(many, F.col(CORRUPT)))


def reject_corrupt(df: DataFrame) -> DataFrame:
    """``df`` without the corrupt column, failing while it runs if a row has too many fields."""
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit("a row has too many fields: "), F.substring(CORRUPT, 1, 200))).cast("boolean")).otherwise(True)).drop(CORRUPT)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON lines or delimited text, by the suffix."""
    suffix = Path(path).suffix.lower()
    if suffix in (".parquet", ".orc"):
        return spark.read.format(suffix[1:]).load(path)
    if suffix in (".json", ".jsonl", ".ndjson"):
        return spark.read.json(path)
    return read_delimited(spark, path).drop(CORRUPT)


def latest_records(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of an append-only log the last record of each key (greatest ``order``)."""
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(o) for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def read_log(spark: SparkSession, path: str, key: list[str], schema: str) -> DataFrame:
    """A JSON-lines log resumed: each key's last record in file order. Lines that do not parse are left out."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("_at"))
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "_at").filter(" and ".join(f"r.{k} is not null" for k in key)).select("r.*", "_at")
    return latest_records(parsed, key, ["_at"]).drop("_at")


def inferred_types(spark: SparkSession, paths: dict[str, str], sep: str = ",") -> DataFrame:
    """Per column the inferred type in each of several files, and whether they agree."""
    rows = [(label, f.name, f.dataType.simpleString()) for label, p in paths.items() for f in spark.read.csv(p, header=True, inferSchema=True, sep=sep).schema]
    wide = spark.createDataFrame(rows, "label string, column_name string, kind string").groupBy("column_name").pivot("label", list(paths)).agg(F.first("kind"))
    same = F.size(F.array_distinct(F.array_compact(F.array(*[F.col(p) for p in paths])))) == 1
    return wide.withColumn("agree", same)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Zstandard Parquet, replacing what is there."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A report as CSV files with headers, replacing what is there; in order over the files where ``order`` is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_or_degrade(df: DataFrame, path: str) -> str:
    """Parquet where every type can be written so, else CSV with what cannot as text; the format it became."""
    plain = {f.name for f in df.schema if f.dataType.typeName() in ("daytimeinterval", "yearmonthinterval", "interval", "void", "variant")}
    if not plain:
        write_parquet(df, path)
        return "parquet"
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    write_csv(df.select(*[(F.to_json(c) if c in nested else F.col(c).cast("string")).alias(c) if c in plain | nested else F.col(c) for c in df.columns]), path)
    return "csv"


def append_log(df: DataFrame, path: str) -> None:
    """Adds the rows to a log of JSON lines; what it holds is never rewritten."""
    df.write.mode("append").json(path)


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def report_text(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    """A Markdown report of small tables. A table of more than ``most`` rows is no summary: it is refused, not cut."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ContractError(f"{name} has more than {most} rows")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows), ""]
    return "\n".join(out)


def write_report(path: str, title: str, sections: dict[str, DataFrame], facts: dict | None = None, most: int = 1000) -> None:
    """``report_text`` as a file of the driver, with its facts as JSON beside it."""
    Path(path).write_text(report_text(title, sections, most), encoding="utf-8")
    if facts is not None:
        Path(path).with_suffix(".json").write_text(json.dumps(facts, indent=2, sort_keys=True, default=str), encoding="utf-8")
