"""Matching entities across sources without keys: a cascade of exact joins on weaker and weaker attributes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.names import Name, block_keys, deletions
from bidloom.llm.text import fold, mend
from bidloom.llm.variants import LIST, parsed_names
from bidloom.sources.tables import cut, discard

#: Notations of countries, and words beside a town's name.
COUNTRIES = {
    "gb": "uk", "gbr": "uk", "deu": "de", "ger": "de", "fra": "fr", "ita": "it", "esp": "es", "pol": "pl", "nld": "nl", "prt": "pt", "aut": "at", "bel": "be", "dnk": "dk", "swe": "se",
    "germany": "de", "deutschland": "de", "france": "fr", "italy": "it", "italia": "it", "spain": "es", "espana": "es", "poland": "pl", "polska": "pl", "netherlands": "nl", "portugal": "pt",
    "austria": "at", "osterreich": "at", "belgium": "be", "belgique": "be", "united kingdom": "uk", "great britain": "uk", "greece": "gr", "el": "gr",
}
BESIDE_TOWN = set("nord sud est ouest ost west north south east centre center centro centrum zentrum cedex kreis".split())
NO_TOWN = {"na", "nn", "town", "city", "ort", "unknown", "keineangabe", "seedocuments"}


def country_code(c: Column) -> Column:
    """The two-letter code of a country in any notation; null for anything else."""
    c = F.translate(F.trim(F.lower(c)), "ñöéèëçáà", "noeeecaa")
    known = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.coalesce(F.element_at(known, c), F.when(c.rlike("^[a-z]{2}$"), c))


def id_key(c: Column) -> Column:
    """The digits of an identifier, whatever its country prefix and punctuation; null for fillers."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(digits) >= 7) & ~digits.rlike(r"^(.)\1*(.)(\1|\2)*$"), digits)


def town_key(text: str | None) -> str | None:
    """A town's letters, without postal codes, districts and accents."""
    if not text:
        return None
    out = []
    for w in re.findall(r"[^\W_]+", fold(mend(text))):
        if w.isdigit() or w in BESIDE_TOWN:
            continue
        out.append(w.replace("0", "o").replace("1", "i").replace("5", "s"))
    key = "".join(out)
    return key if len(key) >= 2 and key not in NO_TOWN else None


#: The keys that rules can ask for, of which one in common is enough, with the bit of each.
KINDS = {"fuzzy": 1, "root": 2}
#: The bit of keys made of a long or only word, a pair or all words; of two names that meet in others the rest is compared.
NAME = 4


def name_keys(proper: str, common: str, side: int) -> dict[str, int]:
    """The keys under which a name may meet its spellings, with the bits of the ``KINDS`` they serve.

    They are those of ``block_keys``. Only the truncations are one-sided: each ``side`` gives
    its whole words to be found among the other's beginnings, so that two whole words that
    merely begin alike do not meet."""
    n = Name(tuple(proper.split()), tuple(common.split()), ())
    short = initials(n.common)
    every, fuzzy, root = {k for k in block_keys(n) if k[0] in "2d"}, set(), set()
    whole = {f"{k}|{short}" for k in block_keys(n) if k[0] == "c"}
    for w in n.rare:
        alone = {k for k in block_keys(Name((w,), (), ())) if k[0] == "d"} | {"d" + x for x in deletions(w.rstrip(".")) if len(x) >= 4}
        w = w.rstrip(".")
        if len(w) >= 4 and (len(n.rare) == 1 or len(w) >= 9):
            every |= alone
            if len(w) >= 5:
                every.add(f"{side}<{w}")
                every.update(f"{3 - side}<{w[:k]}" for k in range(max(5, len(w) // 2), len(w)))
        if len(w) >= 5:
            fuzzy.update((f"={w}", f"{side}<{w}"))
        if len(w) >= 6:
            root |= alone
    bits: dict[str, int] = {}
    for found, bit in ((every, sum(KINDS.values()) | NAME), (whole, KINDS["fuzzy"] | NAME), (fuzzy, KINDS["fuzzy"]), (root, KINDS["root"])):
        for k in found:
            bits[k] = bits.get(k, 0) | bit
    return bits


def initials(words: tuple[str, ...]) -> str:
    return "".join(sorted({w[0] for w in words}))


@dataclass(frozen=True)
class Rule:
    """``keys``: the attributes on which both sides must agree (``fuzzy`` and ``root``: the names must be linked so). Of what is no key but known on both sides: ``towns`` is how many
    letters the towns may differ in (None: any), ``country_apart`` whether the countries may differ. ``alike`` asks for similar names beside the keys."""

    name: str
    keys: tuple[str, ...]
    towns: int | None = 2
    country_apart: bool = False
    alike: bool = False


#: From strong to weak.
RULES = (
    Rule("ident+name", ("ident",), towns=None, country_apart=True, alike=True),
    Rule("exact+town", ("exact", "town"), country_apart=True),
    Rule("exact+country", ("exact", "country")),
    Rule("initials+town", ("initials", "town"), country_apart=True),
    Rule("initials+country", ("initials", "country")),
    Rule("fuzzy+town", ("fuzzy", "short", "town"), country_apart=True),
    Rule("fuzzy+country", ("fuzzy", "short", "country")),
    Rule("root+town", ("root", "town"), country_apart=True),
    Rule("ident", ("ident",)),
    Rule("proper+country", ("proper", "country")),
    Rule("exact", ("exact",)),
    Rule("initials", ("initials",)),
)


def match_entities(left: DataFrame, right: DataFrame, left_id: str, right_id: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Matches of ``left`` to ``right``, both with the columns of ``attributes``.

    First result: ``left_id, right_id, rule, confidence``: at most one record of ``right`` for
    each of ``left``. Rules are tried from strong to weak. Each is one exact join on its
    attributes of the records still open with ``right``; what it resolves is anti-joined away
    before the next. Of several records of ``right`` that a rule gives, the one is taken that
    agrees with most of identifier, country and town; where that leaves several, the record
    stays open for the next rule and is counted as tied. Names are linked (``fuzzy``,
    ``root``) once for the names still open, one row per pair of names, so a rule on them is
    a join through that table.

    Second result: per rule ``n_matched``, ``n_tied``, its labelled records, how many of them
    it got right, and its confidence. A record is labelled by its identifier where exactly
    one record of ``right`` has it: such records pass through the rules on names, which never
    look at it, until one resolves them (they are then matched by the rule that would match
    them anyway). The rule of identifier and name is labelled by the rule of exact name and
    town, that of identifiers alone by the towns. Precision is smoothed as if one more had
    been right and one wrong, and then made not to rise from a stronger rule to a weaker one
    (pooling adjacent rules that violate that, weighted by their labelled records).

    A null attribute never agrees; a record without any stays unmatched. Identifiers that
    are known and differ by more than two characters rule a pair out, unless the towns are
    known and (nearly) agree. ``left`` has one row per distinct record, ``n`` saying how
    often it occurs; ``right_id`` must be unique. Empty tables give empty results.
    """
    spark = left.sparkSession
    open_ = left.select(F.col(left_id).alias("l_id"), "n", *PASSED, "form", "name").withColumn("truth", F.lit(None).cast(right.schema[right_id].dataType)).withColumn("done", F.lit(False))
    found: list[DataFrame] = []
    links: DataFrame | None = None
    held: DataFrame | None = None
    for k, rule in enumerate(rules):
        kind = next((x for x in rule.keys if x in KINDS), None)
        plain = [x for x in rule.keys if x not in KINDS]
        a = open_.filter(reduce(lambda p, q: p & q, [F.col(x).isNotNull() for x in plain]))
        b = right.select(F.col(right_id).alias("r_id"), *[F.col(x).alias("r_" + x) for x in dict.fromkeys([*COMPARED, *plain, *(["form"] if kind else []), *(["name"] if rule.alike else [])])])
        same = [F.col(x) == F.col("r_" + x) for x in plain]
        if kind:
            if links is None:
                links = cut(_links(left.join(open_.select("form"), "form", "left_semi"), right))
            a = a.join(links.filter(F.col("kinds").bitwiseAND(KINDS[kind]) != 0).hint("merge"), "form")
            same.append(F.col("to_form") == F.col("r_form"))
        pairs = a.join(b.hint("merge"), reduce(lambda p, q: p & q, same))
        towns = F.levenshtein("town", "r_town") <= 2
        fits = _fits(rule)
        score = F.coalesce((F.col("ident") == F.col("r_ident")).cast("int"), F.lit(0)) + F.coalesce((F.col("country") == F.col("r_country")).cast("int"), F.lit(0)) + F.coalesce(2 * towns.cast("int"), F.lit(0))
        best = F.when(fits, F.struct(score.alias("s"), F.col("r_id").alias("r")))
        last = F.when(fits, F.struct((-score).alias("s"), F.col("r_id").alias("r")))
        # per open record the best of its pairs; by the way, who alone has its identifier
        one = pairs.groupBy("l_id").agg(
            F.first("n").alias("n"), F.first("truth").alias("truth"), F.first("done").alias("done"), F.max(best).alias("hi"), F.min(last).alias("lo"), F.min("r_id").alias("any_lo"), F.max("r_id").alias("any_hi"), F.max(towns.cast("int")).alias("near")
        )
        unique = F.col("hi.r") == F.col("lo.r")
        only = F.when(F.col("any_lo") == F.col("any_hi"), F.col("any_lo")) if k == 0 else F.lit(None).cast(right.schema[right_id].dataType)
        one = cut(one.select("l_id", F.lit(k).alias("rule_no"), "n", "truth", "done", F.when(unique, F.col("hi.r")).alias("r_id"), (F.col("hi").isNotNull() & ~unique).alias("tied"), only.alias("only"), "near"))
        found.append(one)
        if k == 0:
            # those with a label stay for the rules on names, as labels; the others it resolved are done with
            new = one.select("l_id", F.col("only").alias("_only"), F.col("r_id").isNotNull().alias("_done")).filter("_only is not null or _done")
            open_ = open_.join(new.hint("merge"), "l_id", "left").filter("_done is null or not _done or _only is not null")
            open_ = open_.withColumn("truth", F.col("_only")).withColumn("done", F.coalesce("_done", F.lit(False))).drop("_only", "_done", "name")
        elif k + 1 < len(rules):
            open_ = open_.join(one.filter("r_id is not null").select("l_id").hint("merge"), "l_id", "left_anti")
        if k + 1 < len(rules):
            before, held = held, cut(open_)
            open_ = held
            if before is not None:
                discard(before)
    every = reduce(DataFrame.unionByName, found)
    report, confidence = _report(spark, every, rules)
    matched = every.filter("r_id is not null and not done").withColumn("rule", F.element_at(F.array(*[F.lit(x.name) for x in rules]), F.col("rule_no") + 1))
    matched = matched.withColumn("confidence", F.element_at(F.array(*[F.lit(c) for c in confidence]), F.col("rule_no") + 1))
    return matched.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id), "rule", "confidence"), report


#: What an open record carries from rule to rule, and what of it is compared beside a rule's keys.
PASSED = ("ident", "country", "town", "exact", "initials", "proper", "short")
COMPARED = ("ident", "country", "town")


def _report(spark, every: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[float]]:
    ident = [k for k, r in enumerate(rules) if "ident" in r.keys]
    named = F.col("truth").isNotNull() & F.col("r_id").isNotNull()
    agrees = F.col("truth") == F.col("r_id")
    labelled = F.when(F.col("rule_no").isin(ident), F.col("near").isNotNull()).otherwise(named)
    right = F.when(F.col("rule_no").isin(ident), F.col("near") == 1).otherwise(agrees)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rows = every.groupBy("rule_no").agg(
        count(F.col("r_id").isNotNull() & ~F.col("done")).alias("n_matched"), count(F.col("tied") & ~F.col("done")).alias("n_tied"), count(labelled).alias("n_labelled"), count(labelled & right).alias("n_agree"),
        count(named & F.col("done")).alias("first_labelled"), count(named & F.col("done") & agrees).alias("first_agree"),
    ).collect()  # one row per rule
    by = {r.rule_no: r.asDict() for r in rows}
    zero = {"n_matched": 0, "n_tied": 0, "n_labelled": 0, "n_agree": 0, "first_labelled": 0, "first_agree": 0}
    stats = [zero | by.get(k, {}) for k in range(len(rules))]
    if rules[0].alike and len(rules) > 1:  # labelled by the strongest rule on names
        stats[0] |= {"n_labelled": stats[1]["first_labelled"], "n_agree": stats[1]["first_agree"]}
    pools: list[list[float]] = []  # right, all, rules
    for s in stats:
        pools.append([s["n_agree"] + 1.0, s["n_labelled"] + 2.0, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] < pools[-1][0] / pools[-1][1]:
            a, b = pools.pop(), pools.pop()
            pools.append([x + y for x, y in zip(a, b)])
    confidence = [p[0] / p[1] for p in pools for _ in range(int(p[2]))]
    table = [(r.name, int(s["n_matched"]), int(s["n_tied"]), int(s["n_labelled"]), int(s["n_agree"]), c) for r, s, c in zip(rules, stats, confidence)]
    return spark.createDataFrame(table, "rule string, n_matched bigint, n_tied bigint, n_labelled bigint, n_agree bigint, confidence double"), confidence


def _fits(rule: Rule) -> Column:
    """What else a pair must fulfil: nothing known on both sides may contradict the rule."""
    near = F.levenshtein("town", "r_town") <= 2
    ok = F.lit(True)
    if "town" not in rule.keys and rule.towns is not None:
        ok = ok & F.coalesce(F.levenshtein("town", "r_town") <= rule.towns, F.lit(True))
    if "country" not in rule.keys and not rule.country_apart:
        ok = ok & F.coalesce(F.col("country") == F.col("r_country"), F.lit(True))
    if "ident" not in rule.keys:
        ok = ok & (F.coalesce(F.levenshtein("ident", "r_ident") <= 2, F.lit(True)) | F.coalesce(near, F.lit(False)))
    return ok & _alike() if rule.alike else ok


def _alike() -> Column:
    """Whether two names of one identifier are similar: the proper names are within two
    edits or one begins the other, or, the other words having the same initials, a word of
    either has its counterpart so, or no more than one of the established words is dropped on a side."""
    words: list[tuple[Column, Column]] = []
    for m in ("", "r_"):
        parts = F.split(F.replace(F.col(f"{m}name"), F.lit("."), F.lit("")), r"\|")
        words.append(tuple(F.filter(F.split(p, " "), lambda w: w != "") for p in (parts[0], parts[1])))
    close = lambda x, y: (F.levenshtein(x, y) <= 2) | F.startswith(x, y) | F.startswith(y, x)
    (lp, lc), (rp, rc) = words
    l, r = F.array_join(lp, " "), F.array_join(rp, " ")
    short = [F.array_sort(F.array_distinct(F.transform(x, lambda w: F.substring(w, 1, 1)))) for x in (lc, rc)]
    known = (l != "") & (r != "")
    partly = F.exists(lp, lambda x: F.exists(rp, lambda y: (F.length(x) >= 5) & (F.length(y) >= 5) & ((x == y) | (F.greatest(F.length(x), F.length(y)) >= 9) & close(x, y))))
    common = (l == "") & (r == "") & F.arrays_overlap(lc, rc) & (F.size(F.array_except(lc, rc)) <= 1) & (F.size(F.array_except(rc, lc)) <= 1)
    return F.coalesce(known & close(l, r) | (short[0] == short[1]) & (known & partly | common), F.lit(False))


def _links(left: DataFrame, right: DataFrame) -> DataFrame:
    """``form, to_form, kinds``: the pairs of names of ``left`` and ``right`` that have a key in
    common, with the kinds of these keys. Names are joined, each once, not records. Where
    none of the keys is of ``NAME``, every proper word of one must have its like in the other."""
    l, r = left.select("form", "name").distinct(), right.select("form", "name").distinct().toDF("to_form", "to_name")
    kinds = F.col("bits").bitwiseAND(F.col("r_bits"))
    keys = _keyed(l, 1).join(_keyed(r, 2).toDF("to_form", "key", "r_bits").hint("merge"), "key").select("form", "to_form", kinds.alias("kinds"))
    pairs = cut(keys.filter(F.col("kinds").bitwiseAND(sum(KINDS.values())) != 0).groupBy("form", "to_form").agg(F.bit_or("kinds").alias("kinds")))
    sure = F.col("kinds").bitwiseAND(NAME) != 0
    words = [F.split(F.replace(F.substring_index(c, "|", 1), F.lit("."), F.lit("")), " ") for c in ("name", "to_name")]
    like = lambda x, y: (F.levenshtein(x, y) <= F.when(F.greatest(F.length(x), F.length(y)) >= 6, 2).otherwise(1)) | F.startswith(x, y) | F.startswith(y, x)
    held = lambda p, q: F.forall(p, lambda x: F.exists(q, lambda y: like(x, y)))
    rest = pairs.filter(~sure).join(l.hint("merge"), "form").join(r.hint("merge"), "to_form").filter(held(*words) | held(*words[::-1]))
    return pairs.filter(sure).unionByName(rest.select("form", "to_form", "kinds"))


def _keyed(forms: DataFrame, side: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, keys, bits = [], [], []
            for row, spelt in enumerate(batch.column(1).to_pylist()):
                some = name_keys(*spelt.split("|"), side)
                take += [row] * len(some)
                keys += some
                bits += some.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(keys, pa.string()), pa.array(bits, pa.int32())], names=["form", "key", "bits"])

    return forms.mapInArrow(run, "form bigint, key string, bits int").select("form", F.xxhash64("key").alias("key"), "bits")


def attributes(df: DataFrame, named: DataFrame, towns: DataFrame) -> DataFrame:
    """``df`` (``name, ident, country, town``) with the attributes on which the rules join."""
    out = df.join(named.select("name", "proper", "common").hint("merge"), "name").join(towns.hint("merge"), "town", "left").drop("name", "town").withColumnRenamed("place", "town")
    bare = lambda c: F.replace(F.col(c), F.lit("."), F.lit(""))
    words = F.split("proper", " ")
    rest = F.filter(words, lambda w: (F.instr(F.col("town"), F.replace(w, F.lit("."), F.lit(""))) == 0) | (F.length(F.replace(w, F.lit("."), F.lit(""))) < 4))
    # the town in a name is no part of it
    out = out.withColumn("proper", F.when(F.col("town").isNotNull() & (F.size(words) > 1) & (F.size(rest) > 0), F.array_join(rest, " ")).otherwise(F.col("proper")))
    short = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("common", " "), lambda w: F.substring(w, 1, 1)))), "")
    some = F.col("proper") != ""
    out = out.select("*", short.alias("short"), F.concat("proper", F.lit("|"), "common").alias("name"), F.xxhash64("proper", "common").alias("form"), F.when(some | (F.col("common") != ""), F.xxhash64(bare("proper"), bare("common"))).alias("exact"))
    return out.withColumn("initials", F.when(some, F.xxhash64(bare("proper"), F.col("short")))).withColumn("proper", F.when(some, F.xxhash64(bare("proper")))).drop("common")


def town_keys(towns: DataFrame) -> DataFrame:
    """``town, place``: the key of each distinct town."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([town_key(x) for x in batch.column(0).to_pylist()], pa.string())], names=["town", "place"])

    return towns.filter("town is not null").distinct().mapInArrow(run, "town string, place string")


def match_awards(can: DataFrame, suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Award rows with a single winner matched to suppliers: ``source_row_id,
    supplier_entity_id, rule, confidence``, and the report per rule.

    Each distinct name and town is read once, and the rows' distinct combinations of what was
    read are matched and joined back, so a hot winner costs one match. Rows with a null name
    or several winners match nothing.
    """
    held = ["name", "ident", "country", "town"]
    read = lambda df, *c: df.select(df.columns[0], F.col(c[0]).cast("string").alias("name"), id_key(F.col(c[1]).cast("string")).alias("ident"), country_code(F.col(c[2]).cast("string")).alias("country"), F.col(c[3]).cast("string").alias("town"), F.coalesce(F.instr(c[2], "---") > 0, F.lit(False)).alias("several"))
    one = lambda df: df.filter(F.col("name").isNotNull() & ~F.col("name").rlike(LIST) & ~F.col("several")).drop("several")
    rows = one(read(can.select("source_row_id", "win_name", "win_nationalid", "win_country_code", "win_town"), "win_name", "win_nationalid", "win_country_code", "win_town"))
    rows = rows.withColumn("combo", F.xxhash64(*[F.coalesce(c, F.lit("\0")) for c in held]))
    dim = one(read(suppliers.select("supplier_entity_id", "canonical_name", "validated_national_id", "supplier_country", "supplier_town"), "canonical_name", "validated_national_id", "supplier_country", "supplier_town"))
    combos = cut(rows.groupBy("combo", *held).agg(F.count("*").alias("n")))
    spelled = combos.groupBy("name").agg(F.sum("n").alias("n")).unionByName(dim.groupBy("name").agg(F.count("*").alias("n"))).groupBy("name").agg(F.sum("n").alias("n"))
    named, _ = parsed_names(spelled, "proper string, common string", lambda x: (" ".join(x.rare), " ".join(x.common)))
    named = cut(named.drop("n"))
    towns = cut(town_keys(combos.select("town").unionByName(dim.select("town"))))
    what = [*PASSED, "form", "name"]
    left = cut(attributes(combos, named, towns).withColumn("record", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("form", "ident", "country", "town")])))
    right = cut(attributes(dim, named, towns))
    records = cut(left.groupBy("record", *what).agg(F.sum("n").alias("n")))
    matched, report = match_entities(records, right, "record", "supplier_entity_id")
    matched = left.select("combo", "record").join(matched.hint("merge"), "record").drop("record")
    return rows.select("source_row_id", "combo").join(matched.hint("merge"), "combo").drop("combo"), report
