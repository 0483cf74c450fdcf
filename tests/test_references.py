from datetime import datetime

from pyspark.sql import functions as F

from bidloom.functions.notice_ids import canonical_notice, notice_numbers
from bidloom.operators.references import living_parents, orphan_counts, orphans, references


def test_notations(spark):
    df = spark.createDataFrame([("201700000001",), ("2017-00000001",), ("00000001-2017",), (" CN201700000001.",), ("x TED:NOTICE:00000001-2017:TEXT",), ("12345",), ("2017000000011",), (None,)], "x string")
    got = [r[0] for r in df.select(canonical_notice(F.col("x"))).collect()]
    assert got == ["201700000001"] * 5 + [None] * 3
    many = spark.createDataFrame([("201700000001---2017-00000001 / 00000002-2017",), ("",), (None,)], "x string")
    assert [r[0] for r in many.select(notice_numbers(F.col("x"))).collect()] == [["201700000001", "201700000002"], [], []]


def test_orphans(spark):
    t = [datetime(2017, m, 1) for m in range(1, 6)]
    child = spark.createDataFrame([(1, ["a", "a", "b"], t[0]), (2, ["c"], t[1]), (3, None, t[1]), (4, ["d", None], None), (4, ["d"], None)], "id long, k array<string>, at timestamp")
    refs = references(child, "t", "id", F.col("k"), "at")
    assert refs.count() == 5
    parents = spark.createDataFrame([("a", t[0]), ("a", t[1]), ("b", t[2]), ("c", None), (None, t[1])], "k string, loaded timestamp")
    gone = spark.createDataFrame([("a", t[1]), ("b", t[1]), ("c", t[0]), ("z", t[0])], "k string, gone timestamp")
    alive = living_parents(parents, F.col("k"), "loaded", gone, F.col("k"), "gone")
    assert [r.key for r in alive.collect()] == ["b"]
    lost = orphans(refs, alive)
    assert sorted((r.ref_row_id, r.key) for r in lost.collect()) == [(1, "a"), (2, "c"), (4, "d"), (4, "d")]
    assert orphans(refs, alive.limit(0)).count() == 5
    assert orphans(refs.limit(0), alive).count() == 0
    counts = {(r.ref_month): (r.n_orphan_refs, r.n_rows, r.n_orphan_keys) for r in orphan_counts(lost).collect()}
    assert counts == {"2017-01": (1, 1, 1), "2017-02": (1, 1, 1), None: (2, 1, 1)}
