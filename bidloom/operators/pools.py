"""Cases against the whole pools of their contexts, without a row for each pair.

A pair of a case and a supplier of its context is needed only for what is asked of the case: sums over
its pool, or how many suppliers score better than the winner. So the suppliers of a context are sent
once to each task that holds cases of it, as arrays, and every pair is computed there and then
summed up. What is shuffled and kept is the history's aggregates and the cases.

The features are those of ``casefit.case_matrix``. Each depends on a part of the case's signature only
(its codes, its regions, its date ...), so its values are made once per such part and task."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bidloom.operators import casefit as N

#: How many pairs a task is given at least and into how many parts a context is split at most (each gets its suppliers); bytes that a task keeps of each kind of vectors; rows of a result that are packed at a time.
PAIRS, PARTS, KEPT, ROWS = 5_000_000, 3, 48_000_000, 20_000
_SETS = [f for f, _, _ in N.LEVELS]


def _key(tag: str, value: Column) -> Column:
    return F.xxhash64(F.lit(tag), value)


def _sets() -> list[Column]:
    """Per level the keys of an award's or a case's values."""
    keyed = lambda f: lambda x: _key(f, x)
    return [F.transform(F.array_distinct(F.transform(N._long(c, n), N._cut(n))), keyed(f)) for f, c, n in N.LEVELS]


def places(history: DataFrame) -> DataFrame:
    """One row per context and supplier; ``at`` numbers a context's suppliers in the order of ``s``, from 0."""
    context = history.groupBy("c2", "s").agg(F.count("*").alias("n"), F.count_distinct("b").alias("nb"), F.unix_date(F.max("d")).alias("last"), F.median("pw").alias("h_pw"))
    return context.withColumn("at", F.row_number().over(Window.partitionBy("c2").orderBy("s")) - 1)


def suppliers(history: DataFrame) -> DataFrame:
    """``places`` with all that features need of a supplier."""
    context, history = places(history), history.repartition("s")  # what follows is grouped and joined where it lies
    totals = history.groupBy("s").agg(F.count("*").alias("all_n"), *[f for x in N.REGIME for f in (F.count_if(x).alias(f"{x}_1"), F.count_if(~F.col(x)).alias(f"{x}_0"))])
    one = lambda tag, c: F.when(F.col(c).isNotNull(), F.array(_key(tag, F.col(c)))).otherwise(F.array().cast("array<bigint>"))
    each = history.select("s", F.explode(F.concat(*_sets(), one("country", "country"), one("crit", "crit"))).alias("key")).groupBy("s", "key").agg(F.count("*").cast("int").alias("n"))
    tokens = each.groupBy("s").agg(F.collect_list(F.struct("key", "n")).alias("_t")).select("s", F.col("_t.key").alias("t_key"), F.col("_t.n").alias("t_n"))
    known = history.filter("b is not null").groupBy("s", _key("b", F.col("b")).alias("key")).agg(F.count("*").cast("int").alias("n"), F.unix_date(F.max("d")).alias("last"))
    buyers = known.groupBy("s").agg(F.collect_list(F.struct("key", "n", "last")).alias("_b")).select("s", F.col("_b.key").alias("b_key"), F.col("_b.n").alias("b_n"), F.col("_b.last").alias("b_last"))
    return context.join(totals.join(tokens, "s", "left").join(buyers, "s", "left"), "s")


def parted(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Into how many parts a context is split (``_k``): as many as cores that its share of all pairs would keep
    busy, as each part takes a copy of the suppliers. Contexts are two-digit categories, so that is 100 rows at most."""
    counted = history.groupBy("c2").agg(F.count_distinct("s").cast("double").alias("_n")).join(targets.groupBy("c2").agg(F.count("*").alias("_m")), "c2").withColumn("_w", F.col("_n") * F.col("_m"))
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy()) * history.sparkSession.sparkContext.defaultParallelism
    return counted.select("c2", F.least(F.lit(PARTS), F.ceil(F.col("_w") / PAIRS), F.ceil(share)).cast("int").alias("_k"))


def over_pools(history: DataFrame, targets: DataFrame, make: Callable[[Pool], Callable[[dict], list[tuple]]], schema: str, winners_only: bool = False, names: bool = False) -> DataFrame:
    """Rows of ``schema`` for every case of ``targets`` (as ``with_signature`` gives them) whose context has suppliers.

    ``make`` gets a ``Pool`` and returns what makes the rows of all cases of one signature: it gets the
    signature's parts with ``case_id`` (list) and ``win`` (list: the winners' places in the pool, or None).
    ``winners_only`` leaves out cases whose winner is not in the pool; ``names`` brings the suppliers' names."""
    side = suppliers(history)
    parts = F.broadcast(parted(history, targets))
    own = places(history).select("c2", F.col("s").alias("winner"), F.col("at").alias("win"))
    flags = [F.col(x).cast("int").alias(x) for x in N.REGIME]
    keys = [F.when(F.col(c).isNotNull(), _key(c, F.col(c))).alias(c) for c in ("country", "crit", "b")]
    extra = [c for c in targets.columns if c not in ("case_id", "sig", "winner", *N.TARGET)]
    cases = targets.join(own, ["c2", "winner"], "inner" if winners_only else "left").join(parts, "c2")
    cases = cases.select("c2", F.pmod("sig", F.col("_k")).alias("_p"), "case_id", "sig", "win", F.unix_date("d").alias("d"), "pw", *keys, *flags, *[e.alias(f) for f, e in zip(_SETS, _sets())], *extra)
    side = side.join(parts, "c2").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k").cast("bigint") - 1))).drop("_k", *([] if names else ["s"]))
    tasks = max(48, 8 * history.sparkSession.sparkContext.defaultParallelism)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        done: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            one = make(Pool(right))
            for case in signatures(left):
                rows += one(case)
                if len(rows) >= ROWS:
                    done.append(packed(rows))
                    rows = []
        return pa.concat_tables([*done, packed(rows)])

    def packed(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    split = [x.withColumnRenamed("c2", "_c").repartition(tasks, "_c", "_p").groupBy("_c", "_p") for x in (cases, side)]
    return split[0].cogroup(split[1]).applyInArrow(run, schema)


def signatures(left: pa.Table) -> Iterator[dict]:
    """Each signature with the cases that have it, those of like codes one after another."""
    t = left.combine_chunks()
    codes = t[_SETS[0]].combine_chunks()
    lengths = codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    first = np.zeros(len(lengths), dtype=np.int64)
    some = lengths > 0
    first[some] = codes.values.to_numpy(zero_copy_only=False)[codes.offsets.to_numpy()[:-1][some]]
    sig = t["sig"].to_numpy()
    order = np.lexsort((sig, lengths, first))
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(sig[order]) != 0)), len(order))
    cols = [c for c in t.column_names if c not in ("case_id", "win")]
    step = 2000  # signatures turned into Python values at a time
    for k in range(0, len(bounds) - 1, step):
        ends = bounds[k : k + step + 1]
        part = t.take(pa.array(order[ends[0] : ends[-1]]))
        heads = part.take(pa.array(ends[:-1] - ends[0])).select(cols).to_pydict()
        ids, wins = part["case_id"].to_pylist(), part["win"].to_pylist()
        for i in range(len(ends) - 1):
            a, b = ends[i] - ends[0], ends[i + 1] - ends[0]
            yield {c: heads[c][i] for c in cols} | {"case_id": ids[a:b], "win": wins[a:b]}


class _Index:
    """From a key to the places of the suppliers that have it, with their values."""

    def __init__(self, keys: pa.ChunkedArray, *values: pa.ChunkedArray) -> None:
        keys = keys.combine_chunks()
        at = np.repeat(np.arange(len(keys)), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = keys.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(flat, kind="stable")
        self.at, self.values = at[order], [v.combine_chunks().flatten().to_numpy(zero_copy_only=False)[order] for v in values]
        found, starts = np.unique(flat[order], return_index=True)
        self.where = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(flat)])))

    def get(self, key: int | None) -> slice:
        a, b = self.where.get(key, (0, 0))
        return slice(a, b)


class _Kept(OrderedDict):
    """Vectors by what they depend on; the oldest go when they take more than ``KEPT`` bytes."""

    def __init__(self, bytes_each: int) -> None:
        super().__init__()
        self.most = max(1, KEPT // max(1, bytes_each))

    def of(self, key, make: Callable):
        if key in self:
            self.move_to_end(key)
        else:
            while len(self) >= self.most:
                self.popitem(last=False)
            self[key] = make()
        return self[key]


class Feature:
    """A feature over a pool: where it is not 0 (``at``; None: anywhere) and its values there."""

    def __init__(self, n: int, on: bool, values: np.ndarray, at: np.ndarray | None = None) -> None:
        self.n, self.on, self.values, self.at = n, on, values, at

    def dense(self) -> np.ndarray:
        if self.at is None:
            return self.values
        out = np.zeros(self.n)
        out[self.at] = self.values
        return out

    def total(self) -> float:
        return float(self.values.sum())

    def value_at(self, place: int) -> float:
        """One supplier's value."""
        if self.at is None:
            return float(self.values[place])
        return float(self.values[self.at == place].sum())

    def values_at(self, places: np.ndarray) -> np.ndarray:
        """Some suppliers' values."""
        if self.at is None:
            return self.values[places]
        if not len(self.at):
            return np.zeros(len(places))
        k = np.minimum(np.searchsorted(self.at, places), len(self.at) - 1)  # ``at`` is in order
        return np.where(self.at[k] == places, self.values[k], 0.0)

    def compact(self) -> tuple[np.ndarray, np.ndarray, float, float] | None:
        """Squared distances of the vector-normalised values to the greatest and to the least, and those of all others' zeros; None if it doesn't apply or its norm is 0."""
        norm = np.sqrt((self.values * self.values).sum())
        if not self.on or not norm > 0:
            return None
        whole = len(self.values) == self.n
        hi, lo = self.values.max(), self.values.min()
        if not whole:
            hi, lo = max(hi, 0.0), min(lo, 0.0)
        v, hi, lo = self.values / norm, hi / norm, lo / norm
        return (v - hi) ** 2, (v - lo) ** 2, hi * hi, lo * lo

    def distances(self) -> tuple[np.ndarray, np.ndarray] | None:
        """``compact`` for every supplier."""
        if (d := self.compact()) is None or self.at is None:
            return d and d[:2]
        out = np.full(self.n, d[2]), np.full(self.n, d[3])
        out[0][self.at], out[1][self.at] = d[:2]
        return out


class Pool:
    """The suppliers of a context as arrays, in the order of their names."""

    def __init__(self, t: pa.Table) -> None:
        t = t.sort_by("at")
        num = lambda c: t[c].to_numpy().astype(float)
        self.n = n = t.num_rows
        self.names = t["s"].to_pylist() if "s" in t.column_names else None
        self.awards, self.last, self.h_pw = num("n"), num("last"), num("h_pw")
        self.flags = {x: (num(f"{x}_1"), num(f"{x}_0")) for x in N.REGIME}
        self.tokens = _Index(t["t_key"], t["t_n"])
        self.support = np.log1p(self.tokens.values[0])
        self.buyers = _Index(t["b_key"], t["b_n"], t["b_last"])
        self.with_buyer = np.bincount(self.buyers.at, self.buyers.values[0], minlength=n)
        self.always = {"cpv2_experience": Feature(n, True, np.log1p(self.awards)), "buyer_breadth": Feature(n, True, np.log1p(num("nb"))), "context_specialization": Feature(n, True, self.awards / num("all_n"))}
        self.kept: dict[tuple[str, int], _Kept] = {}

    def once(self, kind: str, key, make: Callable, vectors: int = 1):
        """What ``make`` gives, kept by ``key``."""
        return self.kept.setdefault((kind, vectors), _Kept(8 * self.n * vectors)).of(key, make)

    def _set(self, keys: list[int]) -> Feature:
        found = [self.tokens.get(k) for k in keys]
        if len(found) == 1:
            return Feature(self.n, True, self.support[found[0]], self.tokens.at[found[0]])
        if not found:
            return Feature(self.n, False, np.empty(0), np.empty(0, dtype=int))
        at, back = np.unique(np.concatenate([self.tokens.at[f] for f in found]), return_inverse=True)
        return Feature(self.n, True, np.bincount(back, np.concatenate([self.support[f] for f in found]) / len(keys), minlength=len(at)), at)

    def _one(self, key: int | None) -> Feature:
        f = self.tokens.get(key)
        return Feature(self.n, key is not None, self.support[f], self.tokens.at[f])

    def _regime(self, flags: tuple) -> Feature:
        out, known = np.zeros(self.n), sum(x is not None for x in flags)
        for x, f in zip(flags, N.REGIME):
            if x is not None:
                yes, no = self.flags[f]
                out += np.divide(yes if x else no, yes + no, out=np.zeros(self.n), where=yes + no > 0)
        return Feature(self.n, known > 0, out / known if known else out)

    def feature(self, name: str, case: dict) -> Feature:
        """One feature of every supplier for a case."""
        n = self.n
        if name in self.always:
            return self.always[name]
        if name in _SETS:
            keys = case[name] or []
            return self.once(name, tuple(keys), lambda: self._set(keys))
        if name == "public_activity_recency":
            return self.once(name, case["d"], lambda: Feature(n, True, 1.0 / (1 + case["d"] - self.last)))
        if name == "country_fit":
            return self.once(name, case["country"], lambda: self._one(case["country"]))
        if name == "crit_code_fit":
            return self.once(name, case["crit"], lambda: self._one(case["crit"]))
        if name == "regime_match_share":
            flags = tuple(case[x] for x in N.REGIME)
            return self.once(name, flags, lambda: self._regime(flags))
        if name == "price_weight_similarity":
            pw = case["pw"]
            return self.once(name, pw, lambda: Feature(n, pw is not None, np.zeros(n) if pw is None else np.nan_to_num(1 - np.minimum(np.abs(self.h_pw - pw) / 100, 1.0), nan=0.0)))
        f = self.buyers.get(case["b"])
        at, on = self.buyers.at[f], case["b"] is not None
        if name == "prior_buyer_count":
            return Feature(n, on, np.log1p(self.buyers.values[0][f]), at)
        if name == "buyer_relationship_share":
            return Feature(n, on, self.buyers.values[0][f] / self.with_buyer[at], at)
        gap = case["d"] - self.buyers.values[1][f]
        return Feature(n, on, np.where(gap >= 0, 1.0 / np.maximum(1 + gap, 1), 0.0), at)

    def any_of(self, found: Iterable[tuple[Feature, np.ndarray]]) -> int:
        """How many suppliers any of the features is found at; a feature comes with a flag for each of its values."""
        places = [np.flatnonzero(flags) if f.at is None else f.at[flags] for f, flags in found if flags.any()]
        return len(np.unique(np.concatenate(places))) if places else 0

    def group(self, name: str, case: dict) -> tuple[np.ndarray, np.ndarray] | None:
        """A group's squared distances to the ideal and anti-ideal, over the square of its usable criteria; None if it has none."""
        if name == "buyer":
            return self._group(name, case) if case["b"] in self.buyers.where else None
        return self.once(name, self._part(name, case), lambda: self._group(name, case), 2)

    def _part(self, name: str, case: dict) -> tuple:
        """What of a case a group depends on."""
        parts = {"original": ("d",), "activity": ("d",), "category": _SETS[:3], "geography": ("country", *_SETS[3:]), "regime": N.REGIME, "criteria": ("crit", "pw"), "buyer": ("b", "d")}[name]
        return tuple(tuple(case[x]) if isinstance(case[x], list) else case[x] for x in parts)

    def buyer(self, case: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The buyer's group without a value for each supplier: the places of those that the buyer knows, their
        squared distances (two rows), and the two of all others; None if it has none."""
        if case["b"] not in self.buyers.where:
            return None
        used = [d for d in (self.feature(f, case).compact() for f in N.GROUPS["buyer"]) if d is not None]
        if not used:
            return None
        total = [(sum(d[i] for d in used[1:]) + used[0][i] if len(used) > 1 else used[0][i]) / len(used) ** 2 for i in range(4)]
        return self.buyers.at[self.buyers.get(case["b"])], np.stack(total[:2]), np.array(total[2:])

    def alone(self, name: str, case: dict) -> tuple[np.ndarray, np.ndarray | None, float] | None:
        """A group's own closeness to nine decimals: scores, whose they are (places; None: everyone's), and
        the score of all others; None if the group has no usable criterion."""
        if name == "buyer":
            if (d := self.buyer(case)) is None:
                return None
            at, own, rest = d
            return closeness(own[0], own[1]), at, float(closeness(rest[:1], rest[1:])[0])

        def make():
            d = self._group(name, case)
            return None if d is None else closeness(*d)

        scores = self.once(f"alone {name}", self._part(name, case), make)
        return None if scores is None else (scores, None, 0.0)

    def _group(self, name: str, case: dict) -> tuple[np.ndarray, np.ndarray] | None:
        used = [d for d in (self.feature(f, case).distances() for f in N.GROUPS[name]) if d is not None]
        if not used:
            return None
        plus, minus = (sum(d[i] for d in used[1:]) + used[0][i] if len(used) > 1 else used[0][i] for i in (0, 1))
        return plus / len(used) ** 2, minus / len(used) ** 2


def closeness(plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Closeness by squared distances, to nine decimals."""
    p, m = np.sqrt(plus), np.sqrt(minus)
    total = p + m
    return np.round(np.divide(m, total, out=np.full_like(m, 0.5), where=total > 0), 9)


class Scorer:
    """The models' closeness of every supplier of a pool."""

    def __init__(self, pool: Pool, models: dict[str, dict[str, float]]) -> None:
        self.pool, self.models = pool, list(models.values())
        self.groups = list(dict.fromkeys(g for w in self.models for g in w))
        self.rows, self.held = np.empty((2 * len(self.groups), pool.n)), [None] * len(self.groups)
        self.out, self.above = np.empty((0, 4096)), np.empty((0, 4096), dtype=bool)
        # models of one group are ranked by its own scores, which all cases of the same part of a signature share
        self.single = {i: next(iter(w)) for i, w in enumerate(self.models) if len(w) == 1}
        self.mixed = [i for i in range(len(self.models)) if i not in self.single]
        self.mixed_groups = list(dict.fromkeys(g for i in self.mixed for g in self.models[i] if g != "buyer"))

    def _shares(self, models: list[dict[str, float]], on: list[str]) -> np.ndarray:
        shares = np.zeros((len(models), len(on)))
        for i, w in enumerate(models):
            total = sum(w.get(g, 0.0) for g in on)
            shares[i] = [w.get(g, 0.0) / total if total > 0 else 0.0 for g in on]
        return shares * shares

    def distances(self, case: dict, groups: list[str] | None = None) -> tuple[np.ndarray, list[str]]:
        """Rows of plus and minus of the groups that are on, one after the other, and these groups."""
        on, k = [], 0
        for g in self.groups if groups is None else groups:
            if (d := self.pool.group(g, case)) is not None:
                if self.held[k] is not d:  # else they are in the rows since the last case
                    self.rows[2 * k], self.rows[2 * k + 1] = self.held[k] = d
                on.append(g)
                k += 1
        return self.rows[: 2 * k], on

    def scores(self, case: dict) -> np.ndarray:
        """Every model's score of every supplier, to nine decimals."""
        x, on = self.distances(case)
        w = self._shares(self.models, on)
        return closeness(w @ x[0::2], w @ x[1::2])

    def ranks(self, case: dict) -> list[tuple]:
        """Per winner and model: how many suppliers score better, and how many the same, to nine decimals."""
        wins = sorted(set(case["win"]))
        best, ties = np.empty((2, len(wins), len(self.models)), dtype=np.int64)
        for i, g in self.single.items():
            best[:, i], ties[:, i] = self._single(g, case, wins)
        if self.mixed:
            best[:, self.mixed], ties[:, self.mixed] = self._mixed(case, wins)
        out = {s: (b, t) for s, b, t in zip(wins, best.tolist(), ties.tolist())}
        return [(c, self.pool.n, *out[s]) for c, s in zip(case["case_id"], case["win"])]

    def _single(self, group: str, case: dict, wins: list[int]) -> tuple[list[int], list[int]]:
        n, found = self.pool.n, self.pool.alone(group, case)
        if found is None:
            return [1] * len(wins), [n] * len(wins)
        scores, at, rest = found
        best, ties, others = [], [], n - len(scores)
        for s in wins:
            k = s if at is None else int(np.searchsorted(at, s))
            own = scores[k] if k < len(scores) and (at is None or at[k] == s) else rest
            best.append(1 + int(np.count_nonzero(scores > own)) + others * (rest > own))
            ties.append(int(np.count_nonzero(scores == own)) + others * (rest == own))
        return best, ties

    def _mixed(self, case: dict, wins: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Closeness exceeds t where (1 - t)^2 minus^2 exceeds t^2 plus^2: two linear tests of the groups' distances, no scores.

        All suppliers that the buyer doesn't know have the same distances in its group, so that group has no
        row: a test is held against what it adds for these, and the few others are counted anew."""
        models = [self.models[i] for i in self.mixed]
        x, on = self.distances(case, self.mixed_groups)
        known = self.pool.buyer(case) if any("buyer" in w for w in models) else None
        at, there, rest = known or (np.empty(0, dtype=int), np.empty((2, 0)), np.zeros(2))
        w = self._shares(models, [*on, "buyer"]) if known else np.hstack([self._shares(models, on), np.zeros((len(models), 1))])
        n, m = self.pool.n, len(models)
        tests, owns, alike = [], [], []
        for s in wins:
            k = int(np.searchsorted(at, s))
            b = there[:, k] if k < len(at) and at[k] == s else rest
            p2, m2 = w @ np.append(x[0::2, s], b[0]), w @ np.append(x[1::2, s], b[1])
            total = np.sqrt(p2) + np.sqrt(m2)
            own = np.round(np.divide(np.sqrt(m2), total, out=np.full(m, 0.5), where=total > 0), 9)
            owns.append(own)
            alike.append(total <= 0)  # the winner is best and worst in all: so is every other
            for t in (own + 0.5e-9, own - 0.5e-9):
                t = np.clip(t, 0.0, 1.0)
                test = np.empty((m, x.shape[0] + 2))
                test[:, 0::2], test[:, 1::2] = -w * (t * t)[:, None], w * ((1 - t) ** 2)[:, None]
                tests.append(test)
        tests = np.concatenate(tests)
        tests, buyer = np.ascontiguousarray(tests[:, :-2]), tests[:, -2:]
        others = buyer @ rest
        passed = np.zeros(len(tests), dtype=np.int64)
        if len(self.out) < len(tests):
            self.out, self.above = np.empty((len(tests), 4096)), np.empty((len(tests), 4096), dtype=bool)
        for a in range(0, n, 4096):
            size = min(4096, n - a)
            out, above = self.out[: len(tests), :size], self.above[: len(tests), :size]
            np.greater(np.matmul(tests, x[:, a : a + size], out=out), -others[:, None], out=above)
            passed += [np.count_nonzero(row) for row in above]
        if len(at):
            v = tests @ x[:, at]
            passed += np.count_nonzero(v > -(buyer @ there), axis=1) - np.count_nonzero(v > -others[:, None], axis=1)
        passed = passed.reshape(len(wins), 2, m)
        better, least = passed[:, 0], np.where(np.array(owns) <= 0, n, passed[:, 1])  # nobody scores less than 0
        better, least = np.where(alike, 0, better), np.where(alike, n, least)
        return better + 1, least - better


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best; of equals the first."""
    if k >= len(scores):
        return np.arange(len(scores))
    bound = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > bound)
    return np.concatenate([above, np.flatnonzero(scores == bound)[: k - len(above)]])


def mid_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at the mean of theirs."""
    order = np.argsort(x)
    ends = np.append(np.flatnonzero(np.diff(x[order])) + 1, len(x))
    starts = np.append(0, ends[:-1])
    out = np.empty(len(x))
    out[order] = np.repeat((starts + ends + 1) / 2.0, ends - starts)
    return out


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's; where a side is constant 1 if both are, else 0."""
    one, two = a.min() < a.max(), b.min() < b.max()
    if not (one and two):
        return 0.0 if one or two else 1.0
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))
