import csv
import io
from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from bidloom.sources.delimited import FieldError, award_date, failed_lines, load_lines, loaded_rows, notice_number, parse_record


@given(st.lists(st.text(alphabet='ab;,|"\n\t é', max_size=8), min_size=2, max_size=5), st.sampled_from(",;|\t"))
def test_round_trip(fields, d):
    out = io.StringIO()
    csv.writer(out, delimiter=d, lineterminator="").writerow(fields)
    assert parse_record(out.getvalue(), d, len(fields)) == fields


@pytest.mark.parametrize("raw, reason", [('a,"b', "quoting"), ('a,"b"c', "quoting"), ('a,b"c', "quoting"), ('a,19" x', "quoting"), ("a", "column_count"), ("", "column_count"), ("a,b,c", "column_count"), ("a\nb,c", "column_count")])
def test_reasons(raw, reason):
    with pytest.raises(FieldError) as e:
        parse_record(raw, ",", 2)
    assert e.value.args[0] == reason


@pytest.mark.parametrize(
    "text, day",
    [("23-DEC-14", date(2014, 12, 23)), ("22/12/16", date(2016, 12, 22)), ("2016-1-2", date(2016, 1, 2)), ("22/12/2016", date(2016, 12, 22)), ("20161222", date(2016, 12, 22)), ("22-12-2016", date(2016, 12, 22)), ("01/01/75", date(1975, 1, 1)), ("", None)],
)
def test_dates(text, day):
    assert award_date(text) == day


@pytest.mark.parametrize("text", ["31-NOV-15", "12/31/15", "2015-13-02", "20151341", "tba", "15", "00-JAN-15", "12-XYZ-15", "٢٢/١٢/١٦", " 22/12/16"])
def test_bad_dates(text):
    with pytest.raises(FieldError):
        award_date(text)


@pytest.mark.parametrize("text", ["20150081", "2.01512E+11", "2O1500802404", "201500 337542", "191500452589", "٢٠١٥٠٠٠٠٠٠٠٠"])
def test_bad_ids(text):
    with pytest.raises(FieldError):
        notice_number(text, "2015")


def test_load(spark):
    columns = ("ID_NOTICE_CAN", "TITLE", "DT_AWARD")
    head = "ID_NOTICE_CAN{0}TITLE{0}DT_AWARD"
    rows = [
        (1, "a", 1, "﻿" + head.format(";")), (2, "a", 2, '201500000001;"x;\ny";23-DEC-14'), (3, "a", 3, "201500000002;x;31-FEB-15"), (4, "a", 4, None),
        (5, "b", 1, head.format("|")), (6, "b", 2, "x|y|z"), (7, "b", None, "201500000003|" + "l" * 300_000 + "|"), (7, "b", None, "201500000003|b|"), (8, "c", 2, "201500000004\tx\t20150102"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "line_id long, source_file string, line_no long, raw_line string, reason string")
    out = load_lines(df, columns=columns)
    assert {tuple(r) for r in failed_lines(out).collect()} == {(3, "bad_date"), (4, "column_count"), (6, "bad_id")}
    good = loaded_rows(out, columns).collect()
    assert sorted(r.line_id for r in good) == [2, 7, 7, 8]
    assert next(r for r in good if r.line_id == 2).title == "x;\ny"
    assert load_lines(df.limit(0), columns=columns).count() == 0


def test_records_are_assembled_from_physical_lines(spark):
    """Records broken over lines and over chunks, beside broken quotes, that cost no other record."""
    import csv
    import io
    import random

    from bidloom.sources.delimited import assemble_lines

    rng, columns = random.Random(4), ("a", "b", "c")
    rows, want, no = [], [], 0
    for name, d in (("x.csv", ","), ("y.csv", ";")):
        no = 1
        rows.append((name, 1, d.join(columns)))
        want.append((name, 1, 1))
        for k in range(60):
            fields = [str(k), rng.choice(["plain", 'say "no"', "one\ntwo", f"deep\n{d}\n\nend", ""]), "z"]
            if k % 11 == 5:
                no += 1
                rows.append((name, no, f'{k}{d}"left open{d}z'))
                want.append((name, no, 1))
            out = io.StringIO()
            csv.writer(out, delimiter=d, lineterminator="").writerow(fields)
            parts = out.getvalue().split("\n")
            want.append((name, no + 1, len(parts)))
            rows += [(name, no + 1 + i, x) for i, x in enumerate(parts)]
            no += len(parts)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "source_file string, line_no long, raw_line string, n_lines int")
    for chunk in (40, 10_000):
        got = sorted((r.source_file, r.line_no, r.n_lines) for r in assemble_lines(df, columns, chunk).collect())
        assert got == sorted(want)
    assert assemble_lines(df.limit(0), columns).count() == 0
