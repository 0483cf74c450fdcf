import itertools

import pytest
from pyspark.sql import functions as F

from bidloom.llm.matching import country_code, id_key, match_awards, town_key
from bidloom.llm.names import Name, Vocabulary, block_keys, cost, is_list, parse, split_name
from bidloom.llm.variants import parsed_names, variant_classes, variant_pairs

WORDS = {w: 100 for w in "strassenbau medizintechnik elektrotechnik construcciones servicios integrales stadt stadtwerke universitat hospital universitario katarzyna medical supplies bau".split()}
V = Vocabulary(WORDS)


def parts(name):
    return parse(split_name(name), V)


SAME = [
    ("Gokesarike Straßenbau GmbH", "GOKESARIKE STRASSENBAU G.M.B.H."),
    ("Gokesarike Straßenbau GmbH", "Goksearike Str.bau Gesellschaft m.b.H."),
    ("Gokesarike Straßenbau GmbH", "Gokesari. Straßenbau GmbH"),
    ("Gokesarike Straßenbau GmbH", "Straßenbau Gokesarike GmbH / Kadorf"),
    ("Gokesarike Straßenbau GmbH", "Gokesarike, GmbH (Straßenbau)"),
    ("Nanomovire Medizintechnik AG", "Nanomovire Med.-Technik Aktiengesellschaft"),
    ("Sebrimetike Construcciones S.L.", "Srbrimetike Construc. S. L."),
    ("Viva & Selebe GmbH", "Viva und Selebe GmbH"),
    ("Viva & Selebe GmbH", "VIVA & SELEBE GMBH"),
    ("Katarzyna Rafisegoko", "Rafisegoko, K."),
    ("Katarzyna Rafisegoko", "Fa. Katarzyna Raafisegoko"),
    ("Mebrido Medical Supplies plc", "Mebrido Medical Supplies Public Limited Company"),
    ("Ville de Pipivaboga", "Mairie Pipivaboga"),
    ("Stadtwerke Nidefapede GmbH", "SW Nidefapede"),
    ("Universität Navidopatri", "Uni Navidopatri"),
]
DIFFERENT = [
    ("Pikipafito Straßenbau GmbH", "Pikipafito Elektrotechnik GmbH"),
    ("Stadt Nidefapede", "Stadtwerke Nidefapede GmbH"),
    ("Viva & Selebe GmbH", "Viva & Pina GmbH"),
    ("Gokesarike Straßenbau GmbH", "Lirasafefa Straßenbau GmbH"),
    ("Universität Navidopatri", "Stadt Navidopatri"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    x, y = parts(a), parts(b)
    assert x == y or (set(block_keys(x)) & set(block_keys(y)) and cost(y, x, V) is not None)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert cost(parts(a), parts(b), V) is None and cost(parts(b), parts(a), V) is None


def test_odd_names():
    assert is_list("A GmbH---B AG") and not is_list("A & B")
    for name in ("", " ", "---", "&", "GmbH", "de", "12345", "x" * 100_000):
        n = parts(name)
        assert Name.of(n.key()) == n and isinstance(block_keys(n), list)


def test_classes_against_all_pairs(spark):
    names = [(a, 20) for a, _ in SAME] + [(b, 3) for _, b in SAME] + [(x, 5) for pair in DIFFERENT for x in pair]
    names = list({n: (n, c) for n, c in names}.values()) + [(f"Filler{chr(97 + i)}mo {w.capitalize()} AG", 1) for i in range(15) for w in WORDS] + [("A---B", 4), (None, 2), ("", 1)]
    df = spark.createDataFrame([(*n, "x") for n in names], "name string, n long, class_id string")
    classes = variant_classes(df)
    got = {r.name: r.class_id for r in classes.collect()}
    assert "A---B" not in got and None not in got and len(got) == len(names) - 2
    for a, b in SAME:
        assert got[a] == got[b], (a, b)
    for a, b in DIFFERENT:
        assert got[a] != got[b], (a, b)
    pairs = {(r.name_a, r.name_b) for r in variant_pairs(classes).collect()}
    want = {(a, b) for a, b in itertools.permutations(got, 2) if got[a] == got[b] and a.encode() < b.encode()}
    assert pairs == want
    links = {r.name: (r.class_id, r.n_links) for r in variant_classes(df, count_links=True).collect()}
    assert {k: v[0] for k, v in links.items()} == got
    alone = [k for k in got if list(got.values()).count(got[k]) == 1]
    assert all(links[k][1] == 0 for k in alone) and links[SAME[1][1]][1] >= 1
    assert variant_classes(df.limit(0)).count() == 0


def test_attributes(spark):
    texts = [("GB", "DE 928 279 049"), ("fr ", "249.286.083"), ("DEU", "000000000"), ("Germany", "N/A"), ("España", "121212121"), ("DE---FR", "1212312"), ("", ""), (None, None)]
    got = spark.createDataFrame(texts, "c string, i string").select(country_code(F.col("c")).alias("c"), id_key(F.col("i")).alias("i")).collect()
    assert [r.c for r in got] == ["uk", "fr", "de", "de", "es", None, None, None]
    assert [r.i for r in got] == ["928279049", "249286083", None, None, None, "1212312", None, None]
    assert [town_key(x) for x in ("93324 Galidorf", "Zegostätten CEDEX", "R1court", "-", "TOWN", None)] == ["galidorf", "zegostatten", "ricourt", None, None, None]


def test_established_words_do_not_depend_on_size(spark):
    """A table and the table repeated with other proper names establish the same words."""
    trades = ["Strassenbau", "Medizintechnik", "Elektrotechnik"]

    def names(k):
        return [(f"{a}{b}{e} {trades[(i + j) % 3]} GmbH", 1) for e in ("sa", "ke", "ti", "mo", "ru", "li")[:k] for i, a in enumerate("Gokesa Lirasa Pikipa Tratizi Nanomo".split()) for j, b in enumerate("rike fefa fito foza".split())]

    found = []
    for k in (1, 3, 6):
        df = spark.createDataFrame(names(k), "name string, n long")
        found.append(set(parsed_names(df, "x string", lambda n: ("",))[1].counts))
    assert found[0] == found[1] == found[2] == {"gmbh", *(t.lower() for t in trades)}


def test_cascade(spark):
    can = [
        (1, "Gokesarike Straßenbau GmbH", "DE 123 456 789", "DE", "Kadorf"), (1, "Gokesarike Straßenbau GmbH", "DE 123 456 789", "DE", "Kadorf"), (2, "Goksearike Straßenbau", None, "DEU", "10115 Kadorf"),
        (3, "Gokesarike Straßenbau GmbH", None, "AT", "Briach"), (4, "Twin Elektrotechnik AG", None, "DE", None), (5, "A---Gokesarike Straßenbau GmbH", "DE123456789", "DE", "Kadorf"), (6, None, None, None, None),
        (7, "", "", "", ""), (8, "Twin Elektrotechnik AG", None, "DE", "Beberg"),
    ]
    sup = [("s1", "gokesarike strassenbau gmbh", "DE", "Kadorf", "123456789"), ("s2", "Twin Elektrotechnik AG", "DE", "Aberg", None), ("s3", "Twin Elektrotechnik AG", "DE", "Beberg", None), ("s4", None, None, None, None)]
    c = spark.createDataFrame([(*r, "x") for r in can], "source_row_id long, win_name string, win_nationalid string, win_country_code string, win_town string, rule string")
    s = spark.createDataFrame([(*r, "x") for r in sup], "supplier_entity_id string, canonical_name string, supplier_country string, supplier_town string, validated_national_id string, n string")
    matched, report = match_awards(c, s)
    got = sorted((r.source_row_id, r.supplier_entity_id) for r in matched.collect())
    assert got == [(1, "s1"), (1, "s1"), (2, "s1"), (8, "s3")]
    assert all(0 < r.confidence < 1 for r in matched.collect())
    stats = report.collect()
    assert [r.confidence for r in stats] == sorted((r.confidence for r in stats), reverse=True)
    assert sum(r.n_tied for r in stats if r.rule == "exact+country") == 1  # row 4: two suppliers of one name, no town to tell
    assert match_awards(c.limit(0), s)[0].count() == 0 and match_awards(c, s.limit(0))[0].count() == 0


def test_cascade_keys(spark):
    """Spellings that meet in one kind of key only: rn for m, established words only, one word of several."""
    supplier = [
        ("s1", "Tigitrifomi Forniture SPA", "IT", "Aville", None), ("s2", "Bagemopoga Travaux Publics SARL", "FR", "Bville", None), ("s3", "Strassenbau Medical Supplies GmbH", "DE", "Cdorf", None),
        ("s4", "Sitraf & Brtriga BV", "NL", "Ddam", None), ("s5", "Daze & Kolrio AG", "DE", "Edorf", None), ("s6", "Hospital Medical AG", "DE", "Fdorf", "987654321"),
    ]
    award = [
        (1, "Tigitriforni Forniture SPA", None, "IT", "Aville"), (2, "Bagernopoga Travaux Publics SARL", None, "FR", "Bville"), (3, "Strassenbau Medical Suplies Stadt GmbH", None, "DE", "Cdorf"),
        (4, "Sotraf & Bratriga BV", None, "NL", "Ddam"), (5, "Fina & Kolero AG", None, "DE", "Edorf"), (6, "Hospital Medical Mobel AG", "987654321", "DE", "Gross Adorf"),
    ]
    words = [(f"{w} Filler{chr(97 + i)}mo", "x") for i in range(15) for w in ("Strassenbau", "Medical", "Supplies", "Stadt", "Hospital", "Mobel")]
    award += [(100 + i, name, None, "PL", f"Nowhere{i}") for i, (name, _) in enumerate(words)]
    c = spark.createDataFrame(award, "source_row_id long, win_name string, win_nationalid string, win_country_code string, win_town string")
    s = spark.createDataFrame(supplier, "supplier_entity_id string, canonical_name string, supplier_country string, supplier_town string, validated_national_id string")
    got = {r.source_row_id: (r.supplier_entity_id, r.rule) for r in match_awards(c, s)[0].collect()}
    assert got == {1: ("s1", "fuzzy+town"), 2: ("s2", "fuzzy+town"), 3: ("s3", "fuzzy+town"), 4: ("s4", "root+town"), 6: ("s6", "ident+name")}
