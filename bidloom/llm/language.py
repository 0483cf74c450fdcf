"""The language of documents and of the segments of mixed ones, by a string kernel.

The kernel is the blended spectrum in its presence form: the number of character n-grams
(n = 1..4, hashed) that two sentences share, over the root of the product of their numbers
of n-grams. Landmark sentences give a Nyström map; one-versus-rest kernel ridge regression
on it gives a score per language. Being linear in the n-grams, all that is folded into one
matrix (n-gram buckets x languages), and scoring a batch is a product with it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.llm.text import fold, plain

#: The languages and the names under which a label may give them (ISO 639-1,
#: 639-2, English and own names; a region after - or _ does not matter).
LANGUAGES = ("en", "de", "fr", "es", "it", "pl", "nl", "pt", "da", "sv")
NAMES = {
    "en": "en eng english anglais englisch",
    "de": "de ger deu german deutsch allemand",
    "fr": "fr fre fra french français francais französisch",
    "es": "es spa spanish español espanol castellano esp",
    "it": "it ita italian italiano",
    "pl": "pl pol polish polski",
    "nl": "nl dut nld dutch nederlands flemish vlaams",
    "pt": "pt por portuguese português portugues",
    "da": "da dan danish dansk",
    "sv": "sv swe swedish svenska",
}
NOTATION = {name: code for code, names in NAMES.items() for name in names.split()}
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
MULTIPLIER = np.uint32(0x9E3779B1)

PARAGRAPH = re.compile(r"\s*\n\s*\n\s*")
GAP = re.compile(r"[.!?…][\"'»”)\]]*(\s+)|\s*\n\s*")
#: Abbreviations after which no sentence ends; initials such as "S.A." likewise.
ABBREVIATION = re.compile(r"(?:^|[\s(&])(?:(?:[^\W\d_]\.)+|co\.|sp\.|nr\.|no\.|dr\.|ing\.|st\.|ref\.|tel\.|art\.|inh\.|fa\.)$", re.I)
REFERENCE = set("cpv ref nuts ted id lot nr no art".split())
MARK = re.compile(r"[\d@]|://|www\.")
MARKED = re.compile(r"(?<!\S)[^\s\d@]*+[\d@]\S*|https?://\S+|www\.\S+")
WORD = re.compile(r"[^\W\d_]+")


def language_code(label: str | None) -> str | None:
    """The language a label names, in any notation; None where it names none of the known."""
    if not label:
        return None
    label = label.strip().lower()
    return NOTATION.get(label) or NOTATION.get(re.split(r"[-_ (]", label, maxsplit=1)[0])


def sentences(text: str) -> list[str]:
    """The sentences and heading lines of a text, in order."""
    text = plain(text)
    cased = text != text.lower()
    out: list[str] = []
    for block in PARAGRAPH.split(text):
        begun = 0
        for m in GAP.finditer(block):
            after = block[m.end() : m.end() + 1]
            if not after or cased and after.islower():
                continue
            if m.group(1) and (block[m.start() - 1 : m.start()] != "." and ABBREVIATION.search(block, max(0, m.start() - 12), m.start() + 1)):
                continue
            out.append(block[begun : m.end()].strip())
            begun = m.end()
        out.append(block[begun:].strip())
    return [s for s in out if s]


def letters(sentence: str) -> str:
    """What of a sentence can show its language: its words, lower case, without numbers and references."""
    text = sentence.lower()
    return " ".join([w for w in WORD.findall(MARKED.sub(" ", text) if MARK.search(text) else text) if w not in REFERENCE])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram buckets of each text, one after the other, and where each text's begin.

    An empty text has none."""
    joined = "".join(f"\n {t} " if t else "\n" for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    breaks = codes == 10
    kind = np.uint32 if len(texts) < 1 << 15 else np.uint64  # a text's number and a bucket in one integer
    owner = (np.cumsum(breaks) - 1).astype(kind) << kind(17)
    parts = []
    for n in ORDERS:
        if len(codes) <= n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint32)
        inside = np.ones(len(h), dtype=bool)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * MULTIPLIER
            h ^= h >> np.uint32(15)
            inside &= ~breaks[k : len(codes) - n + 1 + k]
        parts.append(owner[: len(h)][inside] | (h[inside] & np.uint32(BUCKETS - 1)).astype(kind))
    keys = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    ids = (keys & kind(BUCKETS - 1)).astype(np.int64)
    starts = np.searchsorted(keys >> kind(17), np.arange(len(texts), dtype=kind))
    return ids, np.append(starts, len(ids))


def _sums(table: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the sum of the table's rows of its n-grams."""
    out = np.zeros((len(starts) - 1, table.shape[1]), dtype=np.float64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(table.take(ids, axis=0), starts[some], axis=0)
    return out


@dataclass
class Model:
    """The folded classifier: ``table`` (n-gram buckets x languages), the sharpness of its scores on the
    path over the sentences, and the temperature that makes probabilities of them."""

    table: np.ndarray
    languages: tuple[str, ...]
    sharpness: float = 8.0
    temperature: float = 1.0

    def scores(self, texts: list[str], chunk: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """Scores per text and language, and the n-grams of each text."""
        out, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= chunk):
                size += len(texts[end])
                end += 1
            ids, starts = grams(texts[at:end])
            n = np.diff(starts)
            out[at:end] = _sums(self.table, ids, starts) / np.sqrt(np.maximum(n, 1))[:, None]
            sizes[at:end] = n
            at = end
        return out, sizes


def fit(texts: list[str], labels: list[str], landmarks: int = 512, ridge: float = 0.1, rounds: int = 3, seed: int = 7) -> Model:
    """Kernel ridge regression on sentences whose labels may be wrong.

    Each round drops the sentences whose label the last model contradicts, draws
    ``landmarks`` landmark sentences evenly from the languages, and fits again. The last round
    but one leaves every eighth sentence out; on these the temperature is set.
    """
    y = np.array([LANGUAGES.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    # little at a time: the driver is small
    parts = [(i.astype(np.int32), np.diff(s)) for i, s in (grams(texts[k : k + 4000]) for k in range(0, len(texts), 4000))]
    ids = np.concatenate([np.zeros(0, dtype=np.int32), *(i for i, _ in parts)])
    n = np.concatenate([np.zeros(0, dtype=np.int64), *(s for _, s in parts)])
    starts = np.append(0, np.cumsum(n))
    del parts
    keep = n >= 20
    model = Model(np.zeros((BUCKETS, len(LANGUAGES)), dtype=np.float32), LANGUAGES)
    if not keep.any():
        return model
    for r in range(rounds):
        chosen = []
        for k in range(len(LANGUAGES)):
            own = np.flatnonzero(keep & (y == k) & ~((np.arange(len(y)) % 8 == 0) & (r == rounds - 2)))
            chosen += list(rng.choice(own, min(len(own), landmarks // len(LANGUAGES)), replace=False)) if len(own) else []
        # only the landmarks' own n-grams can be shared with them: rows for these, and one of zeros for all others
        held = np.unique(np.concatenate([ids[starts[i] : starts[i + 1]] for i in chosen]))
        row = np.full(BUCKETS, len(held), dtype=np.int32)
        row[held] = np.arange(len(held))
        marks = np.zeros((len(held) + 1, len(chosen)), dtype=np.float32)
        for j, i in enumerate(chosen):
            marks[row[ids[starts[i] : starts[i + 1]]], j] = 1 / np.sqrt(n[i])
        aside = np.arange(len(y)) % 8 == 0 if r == rounds - 2 else np.zeros(len(y), dtype=bool)
        use = np.flatnonzero(keep & ~aside)
        if not len(use):
            return model
        kernel = np.empty((len(use), len(chosen)), dtype=np.float32)
        for k, i in enumerate(use):
            kernel[k] = marks[row[ids[starts[i] : starts[i + 1]]]].sum(axis=0) / np.sqrt(n[i])
        place = {i: k for k, i in enumerate(use)}
        among = kernel[[place[i] for i in chosen]]
        values, vectors = np.linalg.eigh((among + among.T) / 2)
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        phi = kernel @ root
        target = np.where(y[use][:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0 / (len(LANGUAGES) - 1))
        size = np.bincount(y[use], minlength=len(LANGUAGES)).clip(1)
        weight = (len(use) / (len(LANGUAGES) * size))[y[use]][:, None]
        solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (weight * target))
        model.table = np.zeros((BUCKETS, len(LANGUAGES)), dtype=np.float32)
        model.table[held] = marks[:-1] @ (root @ solved)
        if r < rounds - 1:
            scores, sizes = model.scores(texts)
            guess = scores.argmax(axis=1)
            if aside.any():
                model.temperature = _temperature(scores[aside], sizes[aside], y[aside], model.sharpness)
            keep = (n >= 20) & (guess == y)
    return model


def _temperature(scores: np.ndarray, sizes: np.ndarray, y: np.ndarray, sharpness: float) -> float:
    """The factor on the sharpness under which held-out labels are most likely, where as many of
    these labels are taken to be wrong, whatever the text, as the model contradicts."""
    wrong = min(max(float(np.mean(scores.argmax(axis=1) != y)), 1e-4), 0.5)

    def likely(t: float) -> float:
        p = np.exp(posteriors(scores, sizes, sharpness * t)[np.arange(len(y)), y])
        return float(np.log((1 - wrong) * p + wrong / len(LANGUAGES)).mean())

    return float(max(2.0 ** np.linspace(-3, 3, 25), key=likely))


def train(docs: DataFrame, sample: int = 3000, per_document: int = 40, per_language: int = 2500, longest: int = 2000, doc_id: str = "doc_id", text: str = "text", label: str = "lang", **kw) -> Model:
    """A model fitted on a bounded sample of labelled sentences, drawn by hash from anywhere in
    the texts: of the ``sample`` documents with a known label whose hashed id is smallest, at
    most ``per_document`` sentences each (pieces of ``longest`` characters, where one is
    longer), and of all these at most ``per_language`` per label.

    These four are the bounds; everything scored later is the whole corpus. The labels are
    those delivered, wrong ones among them.
    """
    first = F.lower(F.trim(F.regexp_extract(F.col("l"), r"^\s*([^-_ (]+)", 1)))
    drawn = (
        docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.lit("language")).alias("h"), F.col(text).alias("t"), F.col(label).alias("l"))
        .filter((F.col("t") != "") & first.isin(list(NOTATION)))
        .orderBy("h").limit(sample).select("t", "l")
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, l in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = [x[k : k + longest] for s in sentences(t) for x in [letters(s)] for k in range(0, len(x), longest)]
                ranked = sorted((zlib.crc32(f"{k} {x}".encode()), x) for k, x in enumerate(pieces) if len(x) >= 20)
                found += [(h, x, language_code(l)) for h, x in ranked[:per_document]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 3, (pa.int64(), pa.string(), pa.string()))], names=["h", "x", "l"])

    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "x"))  # of sample x per_document rows at most
    rows = drawn.mapInArrow(split, "h bigint, x string, l string").withColumn("k", rank).filter(F.col("k") <= per_language).orderBy("h", "x").collect()
    # many texts have lost their accents: every sentence with any is learnt without them too
    bare = [(fold(r.x), r.l) for r in rows if not r.x.isascii()]
    return fit([r.x for r in rows] + [x for x, _ in bare], [r.l for r in rows] + [l for _, l in bare], **kw)


def posteriors(scores: np.ndarray, sizes: np.ndarray, sharpness: float, enough: int = 40) -> np.ndarray:
    """Log probabilities per sentence and language; a sentence of few n-grams says little, one of none nothing."""
    logits = scores * (np.minimum(sizes / enough, 1.0) * sharpness)[:, None]
    return logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)


def decode(logits: np.ndarray, switch: float = 2.5) -> np.ndarray:
    """The likeliest language of each sentence of one document: a Viterbi path over the
    sentences, on which a change of language costs ``switch``."""
    likeliest = logits.argmax(axis=1)
    if (likeliest == likeliest[0]).all():  # each is the best and no change is needed
        return likeliest
    best, back = logits[0].copy(), []
    for row in logits[1:]:
        stay, move = best, best.max() - switch
        came = np.where(stay >= move, np.arange(len(best)), best.argmax())
        back.append(came)
        best = np.maximum(stay, move) + row
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return np.array(path[::-1])


def languages(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "lang", switch: float = 2.5) -> DataFrame:
    """``doc_id, seg_no, lang_found, confidence, label_ok, n_sentences``: the language of each
    document (``seg_no`` 0) and of each segment of a mixed one (1, 2, ... in text order).

    A segment is a longest run of sentences in one language; names, numbers and references
    belong to the run around them. The document's language is that of most of its text.
    ``label_ok`` says whether the delivered label names it, in any notation. ``confidence``
    is the geometric mean of the sentences' posterior, whose temperature was set on held-out sentences. Null and empty texts, and texts
    without a letter, have no language: one row with ``seg_no`` 0, a null language and
    confidence 0. Whole texts of any length are scored. Repeated documents count each;
    empty tables give an empty result; other columns are ignored. The plan is one scan and
    one Arrow map without a shuffle.
    """
    if model is None:
        model = train(docs, doc_id=doc_id, text=text, label=label)
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, seg_no int, lang_found string, confidence double, label_ok boolean, n_sentences int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # of fixed size (BUCKETS x languages), shipped with the code
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, bounds = [], [0]
                texts = part.column(1).to_pylist()
                for t in texts:
                    flat += [letters(s) for s in sentences(t)] if t else []
                    bounds.append(len(flat))
                scores, sizes = m.scores(flat)
                logits = posteriors(scores, sizes, m.sharpness)
                belief = posteriors(scores, sizes, m.sharpness * m.temperature)
                lengths = np.array([len(x) for x in flat], dtype=float)
                out: dict[str, list] = {k: [] for k in ("row", "seg", "lang", "conf", "ok", "n")}

                def add(*values) -> None:
                    for v, x in zip(out.values(), values):
                        v.append(x)

                for row, l in enumerate(part.column(2).to_pylist()):
                    a, z = bounds[row], bounds[row + 1]
                    said = language_code(l)
                    if a == z or not sizes[a:z].any():
                        add(row, 0, None, 0.0, said is None, z - a)
                        continue
                    path, length = decode(logits[a:z], switch), lengths[a:z]
                    sure = belief[np.arange(a, z), path]
                    share = np.bincount(path, weights=length, minlength=len(m.languages))
                    main = m.languages[int(share.argmax())]
                    weight = np.maximum(length, 1e-9)
                    # confidence of the document: its language's share times how sure its sentences are
                    own = path == share.argmax()
                    conf = float(np.exp(np.average(sure[own], weights=weight[own])) * share.max() / max(share.sum(), 1e-9))
                    add(row, 0, main, conf, said == main, z - a)
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
                    if len(cuts) > 2:
                        for k, (b, e) in enumerate(zip(cuts, cuts[1:]), 1):
                            add(row, k, m.languages[path[b]], float(np.exp(np.average(sure[b:e], weights=weight[b:e]))), said == m.languages[path[b]], int(e - b))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["seg"], pa.int32()), pa.array(out["lang"], pa.string()),
                     pa.array(out["conf"], pa.float64()), pa.array(out["ok"], pa.bool_()), pa.array(out["n"], pa.int32())],
                    names=["doc_id", "seg_no", "lang_found", "confidence", "label_ok", "n_sentences"],
                )

    return docs.select(F.col(doc_id), F.col(text), F.col(label)).mapInArrow(run, schema)
