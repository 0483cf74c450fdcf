from datetime import date

import pytest
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


CASES = [
    (C.clean_text, ["  a ", "", "   ", None, "b"], ["a", None, None, None, "b"]),
    (C.normalize_entity, ["Société  X-1", "--", None, "ABC"], ["soci t x 1", None, None, "abc"]),
    (C.normalize_identifier, ["de 123-4", "..", None], ["DE1234", None, None]),
    (C.parse_bool, ["Y", "no", " true ", "1", "F", "maybe", "", None], [True, False, True, True, False, None, None, None]),
    (C.parse_number, ["12", " 5.5 ", "1e3", "12d", "nan", "1,5", "", None, ".5"], [12.0, 5.5, 1000.0, None, None, None, None, None, 0.5]),
    (C.parse_number_lenient, ["1,5", " 5 %", "1 000", "x"], [1.5, 5.0, 1000.0, None]),
    (C.parse_date, ["23-DEC-14", "22/12/16", "2016-1-2", "22/12/2016", "20161222", "22-12-2016", "01/01/75", "31/02/16", "garbage", "", None], [date(2014, 12, 23), date(2016, 12, 22), date(2016, 1, 2), date(2016, 12, 22), date(2016, 12, 22), date(2016, 12, 22), date(1975, 1, 1), None, None, None, None]),
    (lambda c: F.year(C.parse_date_legacy(c)), ["22/12/16", "23-DEC-14"], [16, None]),
    (lambda c: C.repair_year(C.parse_date_legacy(c)), ["22/12/16"], [date(2016, 12, 22)]),
    (C.cpv_valid, ["45000000-7", "45 000 000", "4500", None], [None, "45000000", None, None]),
    (lambda c: C.cpv_prefix(c, 4), ["45000000-7", "450"], ["4500", None]),
    (C.nuts_code, [" de 21h", "D", "FR", "FR10", None], ["DE21H", None, None, "FR10", None]),
    (C.iso2, ["de", "DEU", "", None], ["DE", None, None, None]),
    (C.list_tokens, ["a---b---c", "a", "", None], [3, 1, 0, 0]),
    (lambda c: C.recency(c.cast("int")), ["0", "3", "-1", None], [1.0, 0.25, None, None]),
]


@pytest.mark.parametrize("f, texts, want", CASES)
def test_functions(spark, f, texts, want):
    assert values(spark, f, texts) == want


def test_keys_and_hygiene(spark):
    rows = [
        ("DE", "DE12345", "Foo GmbH", "Ort"), ("DE", "vat-no", "Foo GmbH", "Ort"), (None, "DE12345", "Foo GmbH", "Ort"), (None, None, None, None), ("DE", "a---b", "x", None),
        ("DE", "12", "x", None), ("DEU", "12345", "x", None), ("DE", "de", "x", None), ("DE", "123456", "x---y", None), (" ", None, "x", "Ort"),
    ]
    df = spark.createDataFrame(rows, "c string, i string, n string, t string")
    parts = [F.col(x) for x in "nict"]
    got = df.select(C.supplier_key(*map(F.col, "cint")), C.buyer_key(*map(F.col, "cin")), C.id_hygiene(F.col("i"), F.col("c"), C.group_or_list(F.lit(None).cast("boolean"), *parts)), C.supplier_key_method(*map(F.col, "cint"))).collect()
    assert [r[0] for r in got[:5]] == ["nid_country||DE||DE12345", "nid_country||DE||VATNO", "name_town||ort||foo gmbh", None, "nid_country||DE||AB"]
    assert [r[2] for r in got] == [
        "candidate_valid_anchor", "generic_placeholder", "missing_country_context", "missing", "multi_value_identifier", "suspicious_short", "invalid_country_context", "country_code_placeholder", "group_or_list_record", "missing",
    ]
    assert got[0][1] == "BID||DE||DE12345" and got[3][3] == "unresolved" and got[9][3] == "normalized_name_town"
    more = spark.createDataFrame([("de", "0000000", "Foo & Bar"), ("DE", "NONE", "-"), ("DEU", "12345", "x"), ("DE", "12-345", None)], "c string, i string, n string")
    assert [r[0] for r in more.select(C.buyer_key(*map(F.col, "cin"))).collect()] == ["BN||DE||FOOBAR", None, None, "BID||DE||12345"]
