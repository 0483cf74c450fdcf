import json
from datetime import datetime

import pytest

from bidloom.operators.tables import ContractError
from bidloom.sources import files
from bidloom.streaming.incremental import arriving, windowed_counts


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿K;NAME;LAST\n1;"x;\ny";z\n2;"say ""hi""";\n3;short\n', encoding="utf-8")
    assert files.sniff_delimiter(spark, str(p)) == ";" and files.read_header(spark, str(p), ";") == ["K", "NAME", "LAST"]
    rows = files.reject_corrupt(files.read_delimited(spark, str(p), ";", ["K", "NAME", "LAST"])).orderBy("K").collect()
    assert [tuple(r) for r in rows] == [("1", "x;\ny", "z"), ("2", 'say "hi"', None), ("3", "short", None)]
    with pytest.raises(ContractError):
        files.read_delimited(spark, str(p), ";", ["NAME", "K", "LAST"])
    long = tmp_path / "long.csv"
    for row in ("1,2,3", "1,,3", "1,,", '"x,y",,""'):
        long.write_text(f"a,b\n1,2\n{row}\n")
        with pytest.raises(Exception, match="too many fields"):
            files.reject_corrupt(files.read_delimited(spark, str(long), ",")).collect()
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert files.sniff_delimiter(spark, str(empty)) == "\t" and files.read_header(spark, str(empty), "\t") == []


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"x', 2.5)], "k long, s string, d double")
    for _ in range(2):  # replaces what is there
        files.write_parquet(df, str(tmp_path / "x.parquet"))
    assert sorted(files.read_any(spark, str(tmp_path / "x.parquet")).collect()) == sorted(df.collect())
    files.write_parquet(df, str(tmp_path / "parts.parquet"), ["k"])
    assert files.read_any(spark, str(tmp_path / "parts.parquet")).filter("k = 2").count() == 1
    files.write_csv(df, str(tmp_path / "r"), ["k"])
    back = spark.read.csv(str(tmp_path / "r"), header=True, quote='"', escape='"').collect()
    assert [r.s for r in back] == ["a,b", 'q"x']
    (tmp_path / "r.csv").write_text("".join(x.read_text() if i == 0 else "".join(x.read_text().splitlines(True)[1:]) for i, x in enumerate(sorted((tmp_path / "r").glob("*.csv")))))
    kinds = {r.column_name: r.agree for r in files.inferred_types(spark, {"one": str(tmp_path / "r.csv"), "two": str(tmp_path / "r.csv")}).collect()}
    assert kinds == {"k": True, "s": True, "d": True}
    assert len(files.sha256(str(tmp_path / "r.csv"))) == 64
    files.write_report(str(tmp_path / "r.md"), "T", {"rows": df}, {"n": 2})
    with pytest.raises(ContractError):
        files.write_report(str(tmp_path / "s.md"), "T", {"rows": df}, most=1)
    assert files.write_or_degrade(df, str(tmp_path / "d1")) == "parquet"
    assert files.write_or_degrade(df.selectExpr("k", "interval 1 day as i", "array(s) as a"), str(tmp_path / "d2")) == "csv" and spark.read.csv(str(tmp_path / "d2"), header=True).count() == 2
    assert "| 1 | a,b |  |" in (tmp_path / "r.md").read_text() and json.loads((tmp_path / "r.json").read_text()) == {"n": 2}


def test_log_resumes_with_the_last_record(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"k": "a", "v": 1}\n{"k": "b", "v": 2}\nbroken\n{"k": "a", "v": 3}\n')
    assert sorted((r.k, r.v) for r in files.read_log(spark, str(p), ["k"], "k string, v long").collect()) == [("a", 3), ("b", 2)]
    assert sorted(files.read_any(spark, str(p)).columns)[-2:] == ["k", "v"]


def test_a_stream_counts_like_a_table(spark, tmp_path):
    rows = [(datetime(2017, 1, 1, h % 24), "ab"[h % 2]) for h in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windowed_counts(df, "ts", ["kind"]).collect()))
    stream = windowed_counts(arriving(spark, str(tmp_path / "in"), df.schema, 1), "ts", ["kind"])
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from counted").collect())) == want
