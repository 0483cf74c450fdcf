"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.sources.tables import cut

#: Where the vocabulary is found, unless ``bidloom.tokenizer`` of the session says otherwise.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of that public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4096
#: So many rows at most are sorted to settle the border of a sample.
SETTLE = 20_000


def count_tokens(docs: DataFrame, text: str, keep: list[Column], tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``keep`` and ``n_tokens``: the length of ``text`` in tokens of a public tokenizer (a
    tiktoken rank file, read once on the driver and broadcast; null text has 0 tokens)."""
    with open(tokenizer, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # the fixed size of a vocabulary
    kept = docs.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines()) if a}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*batch.schema.names[1:], "n_tokens"])

    return kept.mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """A source's name without case, outer blanks and the choice between blank, - and _."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weight: Column | None = None, share_copies: bool = False, seed: int = 1, tokenizer: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The drawn documents with their repeats, and the share reached per source.

    First result: ``doc_id, source, n_tokens, repeats`` (repeats >= 1). Second: one row per
    row of ``targets`` (``source, target_share, max_repeats``) with the documents and tokens
    there are and drawn, ``share_reached`` and ``most_repeats``.

    ``total_tokens`` is the size wanted; by default the largest at which every source that
    has documents can reach its share within its ``max_repeats``. A source without documents
    gets nothing and the others keep their proportions; a source that cannot reach its share
    of a larger ``total_tokens`` gives all it may. A document of weight w is wanted c*w times
    (c is solved per source for the tokens wanted), never more than max_repeats; with
    ``share_copies`` exact copies of a text share one document's weight. Whole copies are
    certain; the rest is the inclusion probability of a fixed-size Pareto sample: the
    documents with the smallest ratio of random odds to inclusion odds, as many as make up
    the tokens still wanted. The size is fixed in tokens, so a source misses its share by
    less than one document.

    Names are compared as ``source_name``. Documents of other or null sources, with a null id
    or without a token are never drawn; negative, null and not finite weights count 0, 1 and
    0. Repeated rows of a document count each; ties of the random number go by id. Targets
    that repeat a source count once, the largest share; empty tables give empty results;
    other columns are ignored.

    No source is ever sorted or gathered in one task: per-source sums and histograms are
    map-side aggregates of fixed size, and the border of a sample is found by refining its
    bin until at most ``SETTLE`` rows are left to sort.
    """
    spark = docs.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("int").alias("max_repeats")).filter("source is not null and target_share > 0")
    wanted = wanted.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    goals = {r.source: r for r in wanted.collect()}  # one row per target
    own = F.lit(1.0) if weight is None else F.when(F.isnan(weight) | (weight == float("inf")) | (weight < 0), 0.0).otherwise(F.coalesce(weight.cast("double"), F.lit(1.0)))
    keep = [F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), own.alias("w"), *([F.md5(F.coalesce(F.col(text), F.lit(""))).alias("h")] if share_copies else [])]
    listed = docs.filter(F.col(doc_id).isNotNull() & source_name(F.col(source)).isin(list(goals) or [""]))
    sized = count_tokens(listed, text, keep, tokenizer or spark.conf.get("bidloom.tokenizer", TOKENIZER))
    if share_copies:
        sized = cut(sized)
        copies = sized.groupBy("source", "h").agg(F.count("*").alias("m")).filter("m > 1")
        sized = sized.join(copies, ["source", "h"], "left").withColumn("w", F.col("w") / F.coalesce("m", F.lit(1))).drop("m")
    sized = cut(sized.drop("h").filter("n_tokens > 0 and w > 0"))
    # per source and bin of the weight's logarithm: documents, tokens, weighted tokens
    bins = sized.groupBy("source", F.round(F.log2("w") * 16).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.sum(F.col("w") * F.col("n_tokens")).alias("wt"))
    have: dict[str, list] = {}
    for r in bins.toLocalIterator():
        have.setdefault(r.source, []).append(r)
    shares = {s: goals[s].target_share for s in have}
    whole = sum(shares.values())
    capacity = {s: sum(r.t for r in have[s]) * goals[s].max_repeats for s in have}
    if total_tokens is None:
        total_tokens = min((capacity[s] * whole / shares[s] for s in have), default=0.0)
    scale = {s: _factor(have[s], min(total_tokens * shares[s] / whole, capacity[s]), goals[s].max_repeats) for s in have}
    plan = spark.createDataFrame([(s, c, goals[s].max_repeats) for s, c in scale.items()], "source string, c double, cap int")
    lam = F.least(F.col("c") * F.col("w"), F.col("cap").cast("double"))
    drawn = sized.join(F.broadcast(plan), "source").withColumn("lam", lam).select("doc_id", "source", "n_tokens", F.floor("lam").cast("int").alias("base"), (F.col("lam") - F.floor("lam")).alias("pi"))
    u = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # q / (1 + q) of the Pareto ratio q = (u / (1 - u)) / (pi / (1 - pi)), in (0, 1) and of the same order
    drawn = cut(drawn.withColumn("q", F.when(F.col("pi") > 0, u * (1 - F.col("pi")) / (u * (1 - F.col("pi")) + (1 - u) * F.col("pi")))))
    sizes = {r.source: r.x for r in drawn.groupBy("source").agg(F.sum(F.col("pi") * F.col("n_tokens")).alias("x")).collect()}
    chosen = _smallest(drawn, sizes)
    drawn = chosen.withColumn("repeats", F.col("base") + F.col("picked").cast("int")).filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    there = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens_available"))
    got = drawn.groupBy("source").agg(F.count("*").alias("docs_drawn"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_drawn"), F.max("repeats").alias("most_repeats"))
    everything = got.agg(F.sum("tokens_drawn")).scalar()
    zero = {k: 0 for k in ("n_docs", "tokens_available", "docs_drawn", "tokens_drawn", "most_repeats")}
    report = wanted.join(there, "source", "left").join(got, "source", "left").fillna(zero)
    report = report.select("source", "target_share", "max_repeats", "n_docs", "tokens_available", "docs_drawn", "tokens_drawn", "most_repeats", F.coalesce(F.try_divide(F.col("tokens_drawn"), everything), F.lit(0.0)).alias("share_reached"))
    return drawn, report


def _factor(bins: list, want: float, cap: int) -> float:
    """c such that the sum of min(c * w, cap) * tokens is ``want``."""
    def gives(c: float) -> float:
        return sum(min(c * r.wt, cap * r.t) for r in bins)

    lo, hi = 0.0, 1.0
    while gives(hi) < want * (1 - 1e-12) and hi < 1e18:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gives(mid) < want else (lo, mid)
    return hi if math.isfinite(hi) else 0.0


def _smallest(drawn: DataFrame, sizes: dict[str, float]) -> DataFrame:
    """``drawn`` with ``picked``: whether a document is among those of smallest ``q`` of its source
    that come nearest to ``sizes[source]`` tokens together."""
    lo = {s: 0.0 for s in sizes}
    width = {s: 1.0 for s in sizes}
    below = {s: 0 for s in sizes}
    open_: dict[str, float] = {}
    live = {s for s in sizes if sizes[s] > 0}
    spark = drawn.sparkSession

    def border() -> DataFrame:
        return spark.createDataFrame([(s, lo[s], width[s]) for s in live] or [("", 0.0, 1.0)], "source string, lo double, width double")

    for _ in range(12):
        if not live:
            break
        inside = drawn.filter("q is not null").join(F.broadcast(border()), "source").filter("q >= lo and q < lo + width")
        bin_ = F.least(F.floor((F.col("q") - F.col("lo")) / F.col("width") * BINS), F.lit(BINS - 1)).cast("int")
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        for r in inside.groupBy("source", bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).toLocalIterator():  # sources x BINS rows at most
            counts.setdefault(r.source, {})[r.bin] = (r.n, r.t)
        for s in list(live):
            run = below[s]
            for b in sorted(counts.get(s, {})):
                n, tokens = counts[s][b]
                if run + tokens >= sizes[s]:
                    lo[s], width[s], below[s] = lo[s] + width[s] * b / BINS, width[s] / BINS, run
                    if n <= SETTLE or width[s] < 1e-15:
                        live.discard(s)
                        open_[s] = sizes[s] - run
                    break
                run += tokens
            else:
                lo[s], width[s] = lo[s] + width[s], 0.0  # fewer tokens than wanted: all are taken
                live.discard(s)
                open_[s] = 0
    edges = spark.createDataFrame([(s, lo[s], lo[s] + width[s]) for s in open_] or [("", 0.0, 0.0)], "source string, lo double, hi double")
    marked = drawn.join(F.broadcast(edges), "source", "left")
    sure = marked.filter("coalesce(not (q >= lo and q < hi), true)").withColumn("picked", F.coalesce(F.col("q") < F.col("lo"), F.lit(False)))
    out = sure.drop("lo", "hi")
    for s, tokens in open_.items():
        rest = marked.filter((F.col("source") == s) & (F.col("q") >= F.col("lo")) & (F.col("q") < F.col("hi"))).drop("lo", "hi")
        run = F.sum("n_tokens").over(Window.orderBy("q", F.col("doc_id")).rowsBetween(Window.unboundedPreceding, 0))  # at most SETTLE rows
        out = out.unionByName(rest.withColumn("picked", run - F.col("n_tokens") / 2 <= tokens))
    return out
