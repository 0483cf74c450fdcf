from datetime import date

import __spark_entry__ as entry


def test_pairs_of_all_pools(spark, tmp_path):
    """A target case meets the suppliers of all four pools, not only those of its narrowest context."""
    parts = [(1, "T", "B1", 1), (2, "T", "B1", 2), (3, "T", "B2", 1)]
    orders = [(k, 7, date(1999, 1, k), "1-URGENT") for k in range(1, 5)] + [(9, 7, date(2000, 2, 1), "1-URGENT")]
    awarded = [(1, 1, 11), (2, 1, 11), (3, 2, 12), (4, 3, 13), (9, 1, 13)]
    lines = [(o, 1, p, s, 100.0, 0.0, 1.0, "N", "O") for o, p, s in awarded]
    for name, rows, schema in (
        ("part", parts, "p_partkey long, p_type string, p_brand string, p_size int"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_quantity double, l_returnflag string, l_linestatus string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.case_id, r.pool): (r.n_pairs, r.n_awards) for r in entry.queries()["jon_11_case_pool"](spark, str(tmp_path)).collect()}
    assert got == {("9||1", "C2_MIN1"): (3, 4), ("9||1", "C3_MIN1"): (2, 3), ("9||1", "C4_MIN1"): (1, 2), ("9||1", "C2_MIN2"): (1, 2)}
