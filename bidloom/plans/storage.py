"""Queries of sources and sinks: what is written is read back and compared, and logs are resumed."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.operators import tables as T
from bidloom.plans import ranking as K
from bidloom.plans.book import Book, Tables
from bidloom.sources import files
from bidloom.sources.tables import own_folder
from bidloom.streaming.incremental import windowed_counts

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col


def _place(t: Tables, suffix: str) -> str:
    return f"{own_folder(t.spark)}/{uuid.uuid4().hex}{suffix}"


@BOOK.query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def src_01_delimited(t: Tables) -> DataFrame:
    """Customers written as delimited text and read again, every column a string."""
    path = _place(t, ".txt")
    t.customer.select("c_custkey", "c_name", "c_mktsegment").write.csv(path, sep=";", header=True, quote='"', escape='"')
    return files.reject_corrupt(files.read_delimited(t.spark, path, ";", ["c_custkey", "c_name", "c_mktsegment"]))


@BOOK.query("SELECT record_id, feed_name, value_euro_max FROM cn_notice")
def src_05_by_suffix(t: Tables) -> DataFrame:
    path = _place(t, ".orc")
    t.cn_notice.select("record_id", "feed_name", "value_euro_max").write.orc(path)
    return files.read_any(t.spark, path)


@BOOK.query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def src_10_latest(t: Tables) -> DataFrame:
    """The last record of each key of a log."""
    return files.latest_records(t.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@BOOK.query("SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders")
def snk_01_parquet(t: Tables) -> DataFrame:
    """Orders written as partitioned Zstandard Parquet and read again."""
    path = _place(t, ".parquet")
    files.write_parquet(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"), path, ["o_orderstatus"])
    return files.read_any(t.spark, path)


_SEPARATORS = {"tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


@BOOK.query("SELECT unnest(['tab', 'comma', 'semicolon', 'pipe']) AS name, unnest([chr(9), ',', ';', '|']) AS delimiter")
def src_02_sniffed(t: Tables) -> DataFrame:
    """One table written with each delimiter, which a look at the first lines finds again."""
    found = []
    for name, sep in _SEPARATORS.items():
        path = _place(t, ".txt")
        t.nation.select("n_nationkey", "n_name", "n_regionkey").write.csv(path, sep=sep, header=True)
        found.append((name, files.sniff_delimiter(t.spark, path)))
    return t.spark.createDataFrame(found, "name string, delimiter string")


@BOOK.query("SELECT unnest(['same', 'reordered', 'short']) AS name, unnest([true, true, false]) AS same_columns, unnest([true, false, false]) AS same_order")
def src_03_headers(t: Tables) -> DataFrame:
    """Headers held against a schema: the same names, and in the same order."""
    want, found = ["n_nationkey", "n_name", "n_regionkey"], []
    for name, columns in (("same", want), ("reordered", want[::-1]), ("short", want[:2])):
        path = _place(t, ".txt")
        t.nation.select(*columns).write.csv(path, sep=";", header=True)
        header = files.read_header(t.spark, path, ";")
        found.append((name, sorted(header) == sorted(want), header == want))
    return t.spark.createDataFrame(found, "name string, same_columns boolean, same_order boolean")


@BOOK.query("SELECT unnest(['o_orderkey', 'o_totalprice', 'o_orderstatus', 'o_shippriority']) AS column_name, unnest(['int', 'double', 'string', NULL]) AS early, unnest(['int', 'double', 'string', 'int']) AS late, unnest([true, true, true, false]) AS agree")
def src_08_inferred_types(t: Tables) -> DataFrame:
    """The types inferred from two files of one table, of which one has a column more."""
    paths = {"early": _place(t, ".csv"), "late": _place(t, ".csv")}
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    t.orders.filter(F.year("o_orderdate") < 1998).select(*columns).write.csv(paths["early"], header=True)
    t.orders.filter(F.year("o_orderdate") >= 1998).select(*columns, F.lit(1).alias("o_shippriority")).write.csv(paths["late"], header=True)
    wide = files.inferred_types(t.spark, paths)
    return wide.withColumn("agree", c("agree") & c("early").isNotNull() & c("late").isNotNull()).withColumn("agree", F.coalesce("agree", F.lit(False)))


@BOOK.query("SELECT item_id, benchmark_name, case_id, item_text FROM eval_items")
def src_09_benchmark(t: Tables) -> DataFrame:
    """A benchmark as CSV with a JSON column and line breaks in quotes, read back typed."""
    path = _place(t, ".csv")
    packed = F.to_json(F.struct("case_id", "item_text"))
    t.eval_items.select("item_id", "benchmark_name", packed.alias("payload")).write.csv(path, header=True, quote='"', escape='"')
    rows = files.reject_corrupt(files.read_delimited(t.spark, path, ",", ["item_id", "benchmark_name", "payload"]))
    return rows.select(c("item_id").cast("long"), "benchmark_name", F.from_json("payload", "case_id string, item_text string").alias("p")).select("item_id", "benchmark_name", "p.case_id", "p.item_text")


@BOOK.query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def snk_02_query_result(t: Tables) -> DataFrame:
    """A query's result written as Parquet and read again."""
    path = _place(t, ".parquet")
    files.write_parquet(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most")), path)
    return files.read_any(t.spark, path)


@BOOK.query("SELECT c_mktsegment, count(*)::BIGINT AS n, min(c_name) AS first_name FROM customer GROUP BY 1")
def snk_03_csv_report(t: Tables) -> DataFrame:
    path = _place(t, ".csv")
    files.write_csv(t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_name").alias("first_name")), path, ["c_mktsegment"])
    rows = files.reject_corrupt(files.read_delimited(t.spark, path, ",", ["c_mktsegment", "n", "first_name"]))
    return rows.withColumn("n", c("n").cast("long"))


@BOOK.query("SELECT unnest(['plain', 'interval']) AS name, unnest(['parquet', 'csv']) AS written_as, (SELECT count(*) FROM nation) AS n_rows")
def snk_04_degraded(t: Tables) -> DataFrame:
    """Parquet where the types allow it, else CSV."""
    found = []
    for name, df in (("plain", t.nation), ("interval", t.nation.withColumn("age", F.expr("interval 2 days")))):
        path = _place(t, "")
        kind = files.write_or_degrade(df, path)
        back = t.spark.read.parquet(path) if kind == "parquet" else t.spark.read.csv(path, header=True)
        found.append((name, kind, back.count()))
    return t.spark.createDataFrame(found, "name string, written_as string, n_rows bigint")


@BOOK.query("SELECT r_name, count(*)::BIGINT AS n_nations, true AS kept FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def snk_05_report(t: Tables) -> DataFrame:
    """A Markdown report, written as text beside its digest, read again and checked by it."""
    df = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n_nations"))
    path, text = _place(t, ".md"), files.report_text("Nations", {"by region": df})
    t.spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest())], "text string, digest string").write.json(path)
    back = t.spark.read.json(path)
    rows = back.select(F.explode(F.split("text", "\n")).alias("line"), (F.sha2("text", 256) == c("digest")).alias("kept")).filter("line rlike '^\\\\| [A-Z]'")
    cells = F.split(F.trim(F.regexp_replace("line", r"^\| | \|$", "")), r" \| ")
    return rows.select(cells[0].alias("r_name"), cells[1].cast("long").alias("n_nations"), "kept").filter("n_nations is not null")


@BOOK.query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'sent' END AS state FROM (SELECT DISTINCT o_orderkey FROM orders)")
def snk_06_appended(t: Tables) -> DataFrame:
    """A log written in two appends; reading it keeps each key's last state."""
    path = _place(t, ".jsonl")
    files.append_log(t.orders.select("o_orderkey", F.lit("sent").alias("state"), F.lit(1).alias("batch")), path)
    files.append_log(t.orders.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("done").alias("state"), F.lit(2).alias("batch")), path)
    return files.latest_records(files.read_any(t.spark, path), ["o_orderkey"], ["batch"]).select("o_orderkey", "state")


@BOOK.query("SELECT unnest(['can_2017', 'cn_2017', 'supplier_dim', 'documents']) AS table_name, unnest([0, 1, 0, 2]) AS n_missing, unnest([true, false, true, false]) AS passed")
def aud_01_preflight(t: Tables) -> DataFrame:
    """Whether tables are there and have the columns that are asked of them."""
    asked = {"can_2017": ["id_notice_can", "win_name"], "cn_2017": ["id_notice_cn", "no_such_field"], "supplier_dim": ["supplier_entity_id"], "documents": ["text", "no_field", "none"]}
    found = []
    for name, columns in asked.items():
        df = getattr(t, name)
        missing = [x for x in columns if x not in df.columns]
        try:
            passed = bool(T.require_columns(df, columns))
        except T.ContractError:
            passed = False
        found.append((name, len(missing), passed))
    return t.spark.createDataFrame(found, "table_name string, n_missing int, passed boolean")


@BOOK.query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str_01_windows(t: Tables) -> DataFrame:
    return windowed_counts(t.events, "ts", ["event_type"])


@BOOK.query(K._AW + K._CTX + K._FOUR + " UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) AS n_rows, count({x}) AS n_values, round(count({x}) / count(*), 6) AS share FROM f" for x in K.BASE))
def fs_06_dictionary(t: Tables) -> DataFrame:
    """Coverage of the features, in one scan."""
    return T.coverage(K.context_features(t), K.BASE)


@BOOK.query("SELECT source, count(*) AS n, sum(n_chars) AS n_chars, count(DISTINCT publisher_id) AS n_publishers FROM documents GROUP BY 1")
def src_04_documents(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.count_distinct("publisher_id").alias("n_publishers"))


_GOLD = "(SELECT case_id, max(item_text) FILTER (WHERE benchmark_name = 'e3_intent') AS g, max(item_text) FILTER (WHERE benchmark_name = 'e4_evidence') AS p FROM eval_items GROUP BY 1)"


@BOOK.query(f"SELECT g IS NOT NULL AS has_gold, count(*) AS n_cases, round(avg((g = p)::INT), 6) AS exact, round(avg(len(g)), 4) AS mean_length FROM {_GOLD} GROUP BY 1")
def llm_03_case_metrics(t: Tables) -> DataFrame:
    """Exact agreement of two sides per case, averaged by group; a missing side is no agreement."""
    sides = t.eval_items.groupBy("case_id").agg(*[F.max(F.when(c("benchmark_name") == b, c("item_text"))).alias(n) for b, n in (("e3_intent", "g"), ("e4_evidence", "p"))])
    return sides.groupBy(c("g").isNotNull().alias("has_gold")).agg(F.count("*").alias("n_cases"), F.round(F.avg((c("g") == c("p")).cast("double")), 6).alias("exact"), F.round(F.avg(F.length("g")), 4).alias("mean_length"))


@BOOK.query("WITH w AS (SELECT o_custkey AS k, o_orderpriority AS x, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_custkey) AS w FROM orders GROUP BY 1, 2) SELECT k, round(sum(abs(w - 0.2)), 9) AS l1 FROM w GROUP BY 1")
def llm_06_weight_distance(t: Tables) -> DataFrame:
    """L1 distance of each customer's mix from equal weights, over the classes it has."""
    per = t.orders.groupBy(c("o_custkey").alias("k"), "o_orderpriority").agg(F.count("*").alias("n"))
    share = c("n") / F.sum("n").over(Window.partitionBy("k"))
    return per.withColumn("w", share).groupBy("k").agg(F.round(F.sum(F.abs(c("w") - 0.2)), 9).alias("l1"))
