"""Variant spellings of names: noisy-channel attribution to the most probable canonical form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from bidloom.llm.names import COST, LINKS, Name, Vocabulary, block_keys, channel, parse, split_name
from bidloom.sources.tables import cut, discard

#: A word is established if this share of the distinct names hold it, and in so many of these a rarer word stands beside it.
SHARE, MOST = 0.001, 0.8
#: Strings that list several names.
LIST = r"---|[\n;|]"


def parsed_names(names: DataFrame, schema: str, parts: Callable[[Name], tuple], name: str = "name") -> tuple[DataFrame, Vocabulary]:
    """``names`` (distinct ``name``, ``n``) with the columns of ``schema``, which ``parts`` makes
    of each parsed name, and the vocabulary they were parsed with. Null names and lists of
    several names are left out.

    A word is established by one rule at every size: at least ``SHARE`` of the names hold it
    and in at least ``MOST`` of these a rarer word (the proper name) stands beside it. So a
    table and the same table repeated with other proper names have the same established
    words. The words are counted over all names; those that ``SHARE`` lets through are at most
    (words per name) / SHARE, whatever the number of names, so they are collected.
    """
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [split_name(x) for x in batch.column(0).to_pylist()]
            own = [list({w for w, short, _ in s if len(w) > 1 and not short and w not in LINKS}) for s in split]
            tokens = [" ".join(w + "." * dotted + "/" * behind for w, dotted, behind in s) for s in split]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.string()), pa.array(own, pa.list_(pa.string()))], names=[*batch.schema.names, "tokens", "words"])

    split = cut(names.filter(F.col(name).isNotNull() & ~F.col(name).rlike(LIST)).select(name, "n").mapInArrow(words, f"`{name}` string, n bigint, tokens string, words array<string>"))
    counts = split.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r.w: r.n for r in counts.filter(F.col("n") >= split.select(F.count("*") * SHARE).scalar()).collect()}

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for own in batch.column(0).to_pylist():
                known = [counts.get(w, 0) for w in own]
                least = min(known, default=0)
                for w, k in zip(own, known):
                    if k > least:
                        found[w] = found.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["w", "n"])

    led = split.select("words").mapInArrow(beside, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    vocabulary = Vocabulary({r.w: counts[r.w] for r in led if r.n >= MOST * counts[r.w]})
    made = _parse_datatype_string(schema)
    fields, types = made.names, [to_arrow_type(f.dataType) for f in made]

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parts(parse([(t.rstrip("./"), "." in t, t[-1] == "/") for t in x.split()], vocabulary)) for x in batch.column(2).to_pylist()]
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))], names=[name, "n", *fields])

    return split.select(name, "n", "tokens").mapInArrow(forms, f"`{name}` string, n bigint, {schema}"), vocabulary


#: Rounds in which the channel's probabilities are estimated from the attachments.
ROUNDS = 3


def variant_classes(names: DataFrame, count_links: bool = False) -> DataFrame:
    """``name, class_id``: the spellings in ``names`` (``name``, ``n``: how often each occurs),
    each with its class; one class per entity named. With ``count_links`` also ``n_links``:
    the forms its form is attached to or that are attached to it.

    Spellings that parse alike are one form. A form's candidates are the more frequent forms
    with which it shares a blocking key (ties of frequency go by text). Its posterior for
    each is the candidate's log frequency (the prior) plus the log probability of the
    channel's steps from the candidate to what is written (typos, abbreviations, reordering,
    added or lost words); it is attached to the greatest, or to none if none is possible.
    The steps' probabilities are estimated from all attachments, ``ROUNDS`` times, beginning
    with ``COST``. ``class_id`` is the form at the end of its chain of attachments.

    Null names and strings that list several names get no row; an empty string or one
    without a letter is a name of its own; repeated names should come aggregated (they count
    once each otherwise). Every candidate that shares a key is scored, without a cap. Keys
    hold the proper name, not established words, so a block holds the spellings of a few
    entities and forms are joined, never gathered; a hot entity's rows have been aggregated
    to its distinct spellings before. An empty table gives an empty result.
    """
    parsed, vocabulary = parsed_names(names, "form string", lambda parts: (parts.key(),))
    parsed = cut(parsed)
    forms = parsed.groupBy("form").agg(F.sum("n").alias("n"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], []
            for k, form in enumerate(batch.column(0).to_pylist()):
                some = block_keys(Name.of(form))
                out += some
                take += [k] * len(some)
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *rows.columns], names=["key", "form", "n"])

    blocks = cut(forms.mapInArrow(keys, "key string, form string, n bigint").select(F.xxhash64("key").alias("key"), "form", "n"))
    other = blocks.select("key", F.col("form").alias("of"), F.col("n").alias("of_n"))
    higher = (F.col("of_n") > F.col("n")) | ((F.col("of_n") == F.col("n")) & (F.col("of") > F.col("form")))
    pairs = blocks.join(other.hint("merge"), "key").filter(higher).select("form", "of", "of_n").distinct()
    steps = list(COST)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Name] = {}
        for batch in batches:
            if len(seen) > 100_000:
                seen.clear()
            take, found = [], []
            for k, (v, c) in enumerate(zip(*(x.to_pylist() for x in batch.columns[:2]))):
                for f in (v, c):
                    if f not in seen:
                        seen[f] = Name.of(f)
                x = channel(seen[v], seen[c], vocabulary)
                if x is not None:
                    take.append(k)
                    found.append([steps.index(y) for y in x])
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.list_(pa.int32()))], names=["form", "of", "of_n", "steps"])

    possible = cut(pairs.mapInArrow(written, "form string, of string, of_n bigint, steps array<int>"))
    costs = [COST[x] for x in steps]
    for left in range(ROUNDS, -1, -1):
        each = F.array(*[F.lit(float(x)) for x in costs])
        score = F.log("of_n") - F.aggregate("steps", F.lit(0.0), lambda a, x: a + F.element_at(each, x + 1))
        links = possible.groupBy("form").agg(F.max(F.struct(score.alias("score"), "of", "steps")).alias("b")).select("form", "b.of", "b.steps")
        if not left:
            break
        counts = {r.x: r.n for r in links.select(F.explode("steps").alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()}  # one row per kind of step
        total = sum(counts.values()) + len(steps)
        costs = [-math.log((counts.get(k, 0) + 1) / total) for k in range(len(steps))]
    links = cut(links.select("form", "of"))
    out = parsed.join(_ends(links).hint("merge"), "form", "left")
    if count_links:
        n = links.select(F.explode(F.array("form", "of")).alias("form")).groupBy("form").agg(F.count("*").alias("n_links"))
        return out.join(n.hint("merge"), "form", "left").select("name", F.coalesce("of", "form").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select("name", F.coalesce("of", "form").alias("class_id"))


def _ends(links: DataFrame) -> DataFrame:
    """Each form's last in its chain: the chains are followed twice as far each round, so
    rounds grow with the logarithm of the longest."""
    held = None
    while True:
        onward = links.select(F.col("form").alias("of"), F.col("of").alias("further"))
        moved = cut(links.join(onward.hint("merge"), "of", "left").select("form", F.coalesce("further", "of").alias("of"), F.col("further").isNotNull().alias("moved")))
        if held is not None:
            discard(held)
        held, links = moved, moved.select("form", "of")
        if moved.filter("moved").isEmpty():
            return links


def variant_pairs(classes: DataFrame) -> DataFrame:
    """``name_a, name_b``: every two spellings of one class, name_a first in byte order. A class
    holds the distinct spellings of one entity; its pairs are made by a join on the class."""
    a = classes.select("class_id", F.col("name").alias("name_a"))
    b = classes.select("class_id", F.col("name").alias("name_b"))
    return a.join(b, "class_id").filter("name_a < name_b").select("name_a", "name_b")
