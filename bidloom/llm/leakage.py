"""Evaluation texts that leak into a corpus: a prefix-filtered set join with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.text import near, words
from bidloom.sources.tables import cut

#: Bits of the filter of the items' shingles that the scan of the corpus asks (8 MB, whatever the number of items).
FILTER_BITS = 1 << 26


class _Hashes(dict):
    """The hash of each word asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


def shingle_hashes(texts: list[list[str]], size: int, held: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all shingles of ``size`` words of the texts: the text, the place in it and the hash."""
    if len(held) > 500_000:
        held.clear()
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.array([held[w] for t in texts for w in t], dtype=np.uint64)
    begun = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else lengths
    text = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(flat)) - np.repeat(begun, lengths)
    whole = np.flatnonzero(place + size <= np.repeat(lengths, lengths))
    h = np.zeros(len(whole), dtype=np.uint64)
    for k in range(size):
        h = (h ^ flat[whole + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return text[whole], place[whole], h


def _rows(numbers: list[int]) -> list[int]:
    """Row numbers that are unique in a table written once: the task's partition and a count."""
    return [(TaskContext.get().partitionId() << 40) + n for n in numbers]


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", window: int = 15, mismatches: int = 2, shingle: int = 4,
) -> DataFrame:
    """``doc_id, item_id, n_words, n_changed``: the items of which a document holds at least
    ``window`` consecutive words, at most ``mismatches`` of any ``window`` replaced or misspelt.

    ``n_words`` is the length of the longest such passage, ``n_changed`` the words changed in
    it. A passage neither begins nor ends with a replaced word (a misspelt one may), as such
    words belong to no quotation. Case, accents, punctuation, tags, spacing and hyphens do
    not matter. Null or empty texts and null ids match nothing; items of fewer than
    ``window`` words give no case; a repeated doc_id gives its rows once per pair; repeated
    items count each under their id; empty tables give an empty result; other columns are
    ignored. Whole texts are read, of any length.

    With ``mismatches`` changed words a window of W words keeps at least
    ``o = W - k + 1 - k * mismatches`` of its ``W - k + 1`` shingles of k words. Sorted by
    rarity in the corpus, its ``W - k + 2 - o`` rarest are its prefix, one of which must occur.

    Items and corpus both stay tables. The corpus is scanned once: each document's shingles
    are hashed and asked of a filter of fixed size that holds the items' shingles, and only
    what passes is kept, with the words where enough pass within one window for a passage.
    The kept shingles' document frequencies give the order, the prefixes are joined to the
    kept shingles by hash, bounds on length and position cut the diagonals found, and the
    rest are verified word by word. A shingle held by a large part of the corpus is the last
    to enter a prefix; joins on it or on a hot item have one side of distinct keys.
    """
    keep = window - shingle + 1 - shingle * mismatches
    if keep < 1:
        raise ValueError("no shingle need survive: take shorter shingles or fewer mismatches")
    item_type, doc_type = items.schema[item_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    read = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    asked = cut(read.mapInArrow(_read_items(window), f"item bigint, item_id {item_type}, words array<string>"))
    own = cut(asked.select("item", "words").mapInArrow(_item_shingles(shingle), "item bigint, p int, h bigint"))
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    held = cut(held.mapInArrow(_scan(_filter(own), window, shingle, keep), f"doc bigint, doc_id {doc_type}, n int, hashes array<bigint>, places array<int>, words array<string>"))
    frequency = held.select(F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    ranked = own.join(frequency.hint("merge"), "h", "left").groupBy("item").agg(F.collect_list(F.struct("p", F.coalesce("df", F.lit(0)).alias("df"), "h")).alias("each"))  # one item's text
    prefix = ranked.mapInArrow(_prefixes(window, shingle, keep), "item bigint, p int, h bigint, n_item int")
    hits = held.filter("words is not null").select("doc", "n", F.inline(F.arrays_zip(F.col("hashes").alias("h"), F.col("places").alias("q"))))
    found = hits.join(prefix.hint("merge"), "h").select("doc", "item", "n", "n_item", (F.col("q") - F.col("p")).alias("shift"))
    overlap = F.least("n_item", F.col("n") - F.col("shift")) - F.greatest(F.lit(0), -F.col("shift"))
    found = found.filter(overlap >= window).groupBy("doc", "item").agg(F.collect_set("shift").alias("shifts"))  # places of one document against one item
    pairs = found.join(held.select("doc", "doc_id", "words").hint("merge"), "doc").join(asked.select("item", "item_id", F.col("words").alias("item_words")).hint("merge"), "item")
    checked = pairs.select("doc_id", "item_id", "words", "item_words", "shifts").mapInArrow(_verify(window, mismatches), f"doc_id {doc_type}, item_id {item_type}, n_words int, n_kept int")
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_kept")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_words").alias("n_words"), (-F.col("b.n_kept")).alias("n_changed"))


def _read_items(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            read = [words(t) for t in batch.column(1).to_pylist()]
            some = [k for k, w in enumerate(read) if len(w) >= window]
            yield pa.RecordBatch.from_arrays([pa.array(_rows([at + k for k in some]), pa.int64()), batch.column(0).take(pa.array(some, pa.int64())), pa.array([read[k] for k in some], pa.list_(pa.string()))], names=["item", "item_id", "words"])
            at += batch.num_rows

    return run


def _item_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Hashes()
        for batch in batches:
            text, place, h = shingle_hashes(batch.column(1).to_pylist(), size, held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], names=["item", "p", "h"])

    return run


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(FILTER_BITS - 1), h >> np.uint64(64 - FILTER_BITS.bit_length() + 1)


def _filter(own: DataFrame):
    """The bits of the items' shingles, of fixed size, as a broadcast variable."""
    low, high = F.col("h").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("h", 64 - FILTER_BITS.bit_length() + 1)
    set_ = own.select(F.explode(F.array(low, high)).alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    words_ = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    got = set_.toArrow()  # at most FILTER_BITS / 32 rows
    words_[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return own.sparkSession.sparkContext.broadcast(words_)


def _scan(bits, window: int, size: int, keep: int):
    """Documents with any shingle in the filter: which and where, and the words if ``keep`` of
    those that begin in one window pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, table = _Hashes(), 0, bits.value
        inside = lambda b: (table[b >> np.uint64(5)] >> (b & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                read = [words(t) for t in part.column(1).to_pylist()]
                text, place, h = shingle_hashes(read, size, held)
                low, high = _bits(h)
                hit = np.flatnonzero(inside(low))
                hit = hit[inside(high[hit])]
                text, place, h = text[hit], place[hit], h[hit]
                # the keep-th next hit lies in the same document and window: enough for a passage
                close = np.zeros(len(text), dtype=bool)
                if len(text) >= keep:
                    last = len(text) - keep + 1
                    close[:last] = (text[keep - 1 :] == text[:last]) & (place[keep - 1 :] - place[:last] <= window - size)
                rows, first = np.unique(text, return_index=True)
                enough = set(text[close].tolist())
                ends = np.append(first, len(text))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_rows([at + int(r) for r in rows]), pa.int64()), part.column(0).take(pa.array(rows)), pa.array([len(read[r]) for r in rows], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place.astype(np.int32))),
                        pa.array([read[r] if int(r) in enough else None for r in rows], pa.list_(pa.string())),
                    ],
                    names=["doc", "doc_id", "n", "hashes", "places", "words"],
                )
                at += part.num_rows

    return run


def _prefixes(window: int, size: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, ps, hs, lengths = [], [], [], []
            for row, each in enumerate(batch.column(1).to_pylist()):
                each = sorted((x["p"], x["df"], x["h"]) for x in each)
                chosen: set[int] = set()
                inside = window - size + 1
                for a in range(len(each) - inside + 1):
                    chosen.update(p for _, _, p in sorted((df, h, p) for p, df, h in each[a : a + inside])[: inside - keep + 1])
                for p in sorted(chosen):
                    take.append(row)
                    ps.append(p)
                    hs.append(each[p][2])
                    lengths.append(len(each) + size - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(ps, pa.int32()), pa.array(hs, pa.int64()), pa.array(lengths, pa.int32())], names=["item", "p", "h", "n_item"])

    return run


def _verify(window: int, mismatches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, lengths, kept = [], [], []
            for row, (doc, item, shifts) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                got = max((x for s in shifts if (x := _longest(item, doc, s, window, mismatches))), default=None)
                if got:
                    take.append(row)
                    lengths.append(got[0])
                    kept.append(got[1])
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lengths, pa.int32()), pa.array(kept, pa.int32())], names=["doc_id", "item_id", "n_words", "n_kept"])

    return run


def _longest(item: list[str], doc: list[str], shift: int, window: int, mismatches: int) -> tuple[int, int] | None:
    """Length and minus the changed words of the longest passage of ``item`` on the diagonal
    ``doc position - item position = shift``."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < window:
        return None
    same = [item[p] == doc[p + shift] for p in range(lo, hi)]
    wrong = [0]
    for s in same:
        wrong.append(wrong[-1] + (not s))

    def ends(k: int) -> bool:
        return same[k] or near(item[lo + k], doc[lo + k + shift])

    good = [a for a in range(hi - lo - window + 1) if wrong[a + window] - wrong[a] <= mismatches and ends(a) and ends(a + window - 1)]
    if not good:
        return None
    best, a, z = (0, 0), good[0], good[0] + window
    for g in [*good[1:], None]:
        if g is not None and g <= z:
            z = g + window
            continue
        best = max(best, (z - a, -(wrong[z] - wrong[a])))
        if g is not None:
            a, z = g, g + window
    return best
