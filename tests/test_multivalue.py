import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from bidloom.operators.multivalue import Packed, split_fields, tokenize, tokenize_weights

PACKED = Packed("f", "labels")


@pytest.mark.parametrize(
    "text, kind, slots",
    [
        (None, "codes", []),
        ("", "codes", []),
        ("   ", "labels", []),
        ("72865000\n60856000", "codes", ["72865000", "60856000"]),
        ('["90414000", "45845000"]', "codes", ["90414000", "45845000"]),
        ("33317000-7---42252000-2---", "codes", ["33317000-7", "42252000-2"]),
        ("42388000 / 38606000---34233000", "codes", ["42388000", "38606000", "34233000"]),
        ("44874000 71468000", "codes", ["44874000", "71468000"]),
        ("00120645-2017------2017-00560358", "codes", ["00120645-2017", "", "2017-00560358"]),
        ('"Price --- all lots"---"Quality of the ""green"" fleet"; ; A', "labels", ["Price --- all lots", 'Quality of the "green" fleet', "", "A"]),
        ("Prix (HT, net), délai", "labels", ["Prix (HT, net)", "délai"]),
        ('"left open, b', "labels", ['"left open', "b"]),
        ("(a; b", "labels", ["(a", "b"]),
        ("Preis/Leistung", "labels", ["Preis/Leistung"]),
        ("a\r\nb", "labels", ["a", "b"]),
    ],
)
def test_tokenize(text, kind, slots):
    assert tokenize(text, kind) == slots


@pytest.mark.parametrize(
    "text, n, slots",
    [
        ("35,5;65,5", 2, ["35,5", "65,5"]),
        ("100,5", 1, ["100,5"]),
        ("75,25", 2, ["75", "25"]),
        ("10,5,65,5", 2, ["10,5", "65,5"]),
        ("10,5,65,20", 4, ["10", "5", "65", "20"]),
        ("55,10; 20---10|5", 5, ["55", "10", "20", "10", "5"]),
        ('"0.10", "0.90"', 2, ["0.10", "0.90"]),
        ('"35,5","64,5"', 5, ["35,5", "64,5"]),
        ("10,,55", 2, ["10", "", "55"]),
        ("10%, 5,5%", 2, ["10%", "5,5%"]),
        ("50,5", 3, ["50,5"]),
    ],
)
def test_weights(text, n, slots):
    assert tokenize_weights(text, n) == slots


@given(st.lists(st.text(alphabet='ab;,|"- ', min_size=1).filter(lambda x: x.strip() == x and x), min_size=1, max_size=6))
def test_quoted_values_come_back(values):
    text = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [x for x in tokenize(text)] == values


def test_very_long_text():
    values = [str(random.Random(i).randrange(10**8)) for i in range(50_000)]
    assert tokenize("---".join(values), "codes") == values


def test_split_fields(spark):
    df = spark.createDataFrame([(1, "a;b", "x"), (1, "a;b", "y"), (2, None, "z"), (None, "c", "z"), (3, "", "z")], "source_row_id long, f string, pos string")
    rows = {tuple(r) for r in split_fields(df, "source_row_id", [PACKED], "t").collect()}
    assert rows == {("t", 1, "f", 1, "a", 2), ("t", 1, "f", 2, "b", 2), ("t", None, "f", 1, "c", 1)}
    assert split_fields(df, "source_row_id", [PACKED], "t", 2).count() == 4
    assert split_fields(df.limit(0), "source_row_id", [PACKED], "t").count() == 0
