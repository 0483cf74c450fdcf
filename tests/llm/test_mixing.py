import pytest
from pyspark.sql import functions as F

from bidloom.llm.mixing import TOKENIZER, count_tokens, mix_sources

TARGETS = [("Big-Source", 0.5, 1), ("mid source", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 4), (None, 0.5, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i} " + "word " * (i % 7), "big_source") for i in range(4000)]
    rows += [(10_000 + i, f"other text {i} " + "word " * (i % 5), " MID SOURCE ") for i in range(1500)]
    rows += [(20_000 + i, f"rare text {i}", "Tiny") for i in range(100)]
    rows += [(30_000, None, "tiny"), (30_001, "", "tiny"), (None, "x", "tiny"), (30_002, "x", None), (30_003, "x", "unlisted")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_tokens int").cache()


def test_shares_and_caps(spark, docs):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    drawn, report = mix_sources(docs, targets)
    rows = drawn.collect()
    assert {r.source for r in rows} == {"big_source", "mid_source", "tiny"}
    caps = {"big_source": 1, "mid_source": 2, "tiny": 4}
    assert all(1 <= r.repeats <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    got = {r.source: r for r in report.collect()}
    assert got["absent"].tokens_drawn == 0 and got["absent"].share_reached == 0
    for s, want in (("big_source", 0.5 / 0.9), ("mid_source", 0.3 / 0.9), ("tiny", 0.1 / 0.9)):
        assert abs(got[s].share_reached - want) < 0.005
        assert got[s].tokens_drawn == sum(r.n_tokens * r.repeats for r in rows if r.source == s)
    again = {(r.doc_id, r.repeats) for r in mix_sources(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}


def test_inclusion_follows_weights(spark, docs):
    targets = spark.createDataFrame([("big_source", 1.0, 1)], "source string, target_share double, max_repeats int")
    one = docs.filter("source = 'big_source'")
    total = one.count() * 5
    drawn, _ = mix_sources(one, targets, total_tokens=total, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    even = drawn.filter("doc_id % 2 = 0").count() / drawn.count()
    assert 0.7 < even < 0.8


def test_exact_copies_share_a_weight(spark):
    rows = [(i, "the same text" if i < 1000 else f"own text {i}", "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn, _ = mix_sources(df, targets, total_tokens=1500, share_copies=True)
    assert drawn.filter("doc_id < 1000").count() <= 3


def test_ties_repeats_and_empty(spark, docs):
    targets = spark.createDataFrame([("s", 1.0, 3), ("s", 0.5, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame([(1, "a b", "s")] * 5, "doc_id long, text string, source string")
    drawn, report = mix_sources(df, targets)
    assert drawn.count() == 5 and {r.repeats for r in drawn.collect()} == {3} and report.count() == 1
    drawn, report = mix_sources(docs.limit(0), targets)
    assert drawn.count() == 0 and report.collect()[0].share_reached == 0
    assert mix_sources(df, targets.limit(0))[1].count() == 0


def test_tokens_decode_to_the_text(spark):
    import base64

    import tiktoken

    from bidloom.llm.mixing import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb").read().splitlines())}
    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "Über 12 Städte, l'été <|endoftext|>  \n\n x" * 50
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, "text", [F.col("doc_id")]).collect()}
    assert e.decode(e.encode_ordinary(text)) == text and got == {1: len(e.encode_ordinary(text)), 2: 0}
