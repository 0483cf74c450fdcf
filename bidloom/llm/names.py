"""Names of companies, persons and public bodies: their parts, and how likely one is a spelling of another."""

from __future__ import annotations

import re
from dataclasses import dataclass

from bidloom.llm.text import edits, fold, mend

#: Legal forms and their spellings, folded, without points and connectives.
LEGAL_FORMS = {
    "gmbh": "gmbh|gesellschaft mbh|gesmbh|ges mbh|gesellschaft mit beschrankter haftung",
    "ggmbh": "ggmbh",
    "cokg": "gmbh co kg|gmbh cokg|co kg|cokg|kg|kommanditgesellschaft",
    "ag": "ag|aktiengesellschaft",
    "ohg": "ohg",
    "ev": "ev",
    "eg": "eg",
    "sa": "sa|sociedad anonima|societe anonyme|spolka akcyjna|sociedade anonima",
    "sl": "sl|slu|sociedad limitada",
    "spa": "spa|societa per azioni",
    "srl": "srl|societa a responsabilita limitata",
    "sas": "sas|societe par actions simplifiee",
    "sarl": "sarl|societe a responsabilite limitee",
    "spzoo": "sp z oo|sp zoo|spzoo|sp z o o|spolka z oo|spolka z ograniczona odpowiedzialnoscia",
    "bv": "bv|besloten vennootschap",
    "nv": "nv|naamloze vennootschap",
    "bvba": "bvba|sprl",
    "lda": "lda|limitada",
    "ltd": "ltd|limited",
    "plc": "plc|public limited company",
    "as": "aps|a s",
    "ab": "ab|aktiebolag",
}
#: Forms written for each other (parts of one, or names in a country's languages).
EQUAL_FORMS = ({"gmbh", "cokg"}, {"gmbh", "ggmbh"}, {"sa", "nv"}, {"bv", "bvba"})
#: Words of bodies and trades that stand for each other, as word: words.
ALIASES = {
    "magistrat": "stadt", "stadtverwaltung": "stadt", "stadtgemeinde": "stadt", "gemeindeverwaltung": "gemeinde", "gemeindeamt": "gemeinde",
    "marktgem": "marktgemeinde", "mktgem": "marktgemeinde", "landratsamt": "landkreis", "lk": "landkreis", "lkr": "landkreis", "kreisverwaltung": "landkreis",
    "kliniken": "klinikum", "mairie": "ville", "commune": "ville", "departement": "conseil departemental",
    "urzad": "gmina", "gminy": "gmina", "starostwo": "powiat", "powiatowe": "powiat", "powiatu": "powiat", "ug": "gmina", "mg": "marktgemeinde", "stadsbestuur": "stad",
    "gemeentebestuur": "gemeente", "zhs": "ziekenhuis", "sw": "stadtwerke", "stadtw": "stadtwerke", "ws": "waterschap",
    "ayto": "ayuntamiento", "bauunternehmen": "bau", "bauunternehmung": "bau", "bldg": "building", "mgmt": "management",
    "engrg": "engineering", "svcs": "services", "tp": "travaux publics", "pd": "przedsiebiorstwo drogowe", "fm": "facilities management",
    "cap": "centrale achats publics",
}
#: Words of which each pair can name one kind of body, in one language or a country's two.
EQUAL_WORDS = [{"stadhuis", "gemeente"}, {"stadhuis", "stad"}, {"gemeentehuis", "gemeente"}, {"stad", "ville"}, {"gemeente", "commune"}, {"municipio", "comune"}, {"municipio", "camara"}, {"municipio", "ayuntamiento"}]
PHRASES = {
    ("amministrazione", "comunale"): ("comune",), ("openbaar", "centrum"): ("ocmw",), ("hotel", "ville"): ("ville",), ("mkt", "gem"): ("marktgemeinde",),
    ("maatschappelijk", "welzijn"): (),
}
#: Words that name nobody (titles, purchasing offices), connectives, given names' short forms.
JUNK = set(
    "fa firma inh inhaber inhaberin dipling herr frau mr mrs ms dr prof mag excmo excma the spett spettle messrs vergabestelle einkauf procurement purchasing inkoop compras acquisti "
    "upphandling indkob beschaffung zamowien".split()
)
JUNK_PHRASES = {("service", "achats"), ("servizio", "acquisti"), ("servicio", "compras"), ("purchasing", "dept"), ("zamowienia", "publiczne")}
LINKS = set("de di del della dello dei degli des du der die das den la le les lo el los las il of the w we z d l von van voor het en et und u and e y i a da do dos na".split())
SHORT = {
    "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret", "willi": "wilhelm", "willy": "wilhelm", "bill": "william", "rob": "robert", "bob": "robert", "bert": "robert",
    "kasia": "katarzyna", "kate": "catherine", "cathy": "catherine", "katie": "catherine", "kathy": "catherine", "toni": "antonio", "tonio": "antonio", "beppe": "giuseppe", "pippo": "giuseppe", "peppe": "giuseppe",
    "paco": "francisco", "pancho": "francisco", "curro": "francisco", "hans": "johannes", "johann": "johannes", "hannes": "johannes", "lisa": "elisabeth", "liz": "elisabeth", "elsa": "elisabeth", "betty": "elisabeth", "lisbeth": "elisabeth", "else": "elisabeth",
    "fritz": "friedrich", "jim": "james", "jack": "john", "pepe": "jose", "manolo": "manuel", "gosia": "malgorzata", "jurek": "jerzy", "sepp": "josef", "kurt": "konrad", "uli": "ulrich", "heinz": "heinrich",
}
FORM = {tuple(s.split()): k for k, v in LEGAL_FORMS.items() for s in v.split("|")}
LONGEST = max(map(len, FORM))
SEPARATOR = re.compile(r"\s*[/;|]\s*|\s+[-–]\s+|\s*,\s*|\s*[()]\s*")
INITIALS = re.compile(r"(?<![^\W_])(?:[^\W\d_]\.){2,}(?:[^\W\d_](?![^\W_]))?")
#: Words shortened inside: "Str.bau", "Med.-Technik", "E-Technik" (the heads of compounds are fixed values).
GLUED = re.compile(r"(?<![^\W_])([^\W_]{2,4})\.-?((?:bau|technik|techniek|buro|buero|reinigung|werke|dienst|diensten|bedrijf|verwaltung|service|haus|handel))(?![^\W_])\.?")
DEGREE = re.compile(r"(?<![^\W_])dipl\.?[- ]*(?:ing|kfm|kff|inf|phys|chem)?\.?(?:-(?=[^\W_])|(?![^\W_]))")
ONE_LETTER = re.compile(r"(?<![^\W_])([^\W\d_])-([^\W_]{3,})")
TOKEN = re.compile(r"([^\W_]+)(\.?)(\x00?)")
OCR = str.maketrans("05", "os")


def is_list(name: str) -> bool:
    """Whether a string lists several names and so names no single one."""
    return "---" in name or "\n" in name or ";" in name or "|" in name


def split_name(name: str) -> list[tuple[str, bool, bool]]:
    """The folded words of a name as (word, abbreviated by a point, behind a separator)."""
    text = fold(mend(name)).replace("co.kg", "co kg").replace("&", " ").replace("+", " ")
    text = DEGREE.sub(" ", text)
    out: list[tuple[str, bool, bool]] = []
    for k, segment in enumerate(s for s in SEPARATOR.split(text) if s.strip(" .")):
        segment = INITIALS.sub(lambda m: " " + m.group().replace(".", "").replace(" ", "") + " ", segment)
        segment = ONE_LETTER.sub("\\1\\2\0", GLUED.sub("\\1\\2\0", segment))
        for m in TOKEN.finditer(segment):
            word = m.group(1)
            if not word.isdigit() and not word.isalpha():
                word = word.translate(OCR)
            out.append((word, bool(m.group(3)) or bool(m.group(2)) and len(word) > 0, k > 0))
    return out


#: Words established whatever the data.
KNOWN = {*ALIASES, *(w for v in ALIASES.values() for w in v.split()), *(w for pair in EQUAL_WORDS for w in pair), "uni", "univ", "hosp"}


class Vocabulary:
    """The established words of a set of names, with the number of names that hold them.

    Of words in at least ``least`` names there are at most (words per name) * names / least."""

    def __init__(self, words: dict[str, int]) -> None:
        self.counts = dict(words)
        self.words = set(words) | KNOWN
        self.near: dict[str, list[str]] = {}
        for w in sorted(self.counts):
            if len(w) >= 5:
                for d in deletions(w):
                    self.near.setdefault(d, []).append(w)
        self.starts = {w[:k] for w in self.words for k in range(2, len(w))}

    def both(self, a: str, b: str) -> bool:
        """Whether both are established in their own right, so neither is the other's short or wrong form."""
        x, y = self.counts.get(a, 0), self.counts.get(b, 0)
        return min(x, y) > 0 and min(x, y) >= 0.3 * max(x, y)

    def shortens(self, word: str) -> bool:
        """Whether ``word``, shortened inside or at its end, can be one of the established words."""
        if word in self.starts:
            return True
        return any(w[0] == word[0] and _inside(word, w) for w in self.words if len(w) > len(word))

    def corrected(self, word: str) -> str | None:
        """The established word that ``word`` misspells by one edit, if any."""
        if len(word) < 5:
            return None
        for d in deletions(word):
            for w in self.near.get(d, ()):
                if edits(word, w, 1) <= 1:
                    return w
        return None


def deletions(word: str) -> list[str]:
    """``word`` and what is left of it without any one letter."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}]


@dataclass(frozen=True)
class Name:
    """A parsed name: rare words (the proper name), established words, legal forms.

    A word ends in a point if it is abbreviated."""

    rare: tuple[str, ...]
    common: tuple[str, ...]
    legal: tuple[str, ...]

    def key(self) -> str:
        return " ".join(self.rare) + "|" + " ".join(self.common) + "|" + " ".join(self.legal)

    @staticmethod
    def of(key: str) -> "Name":
        return Name(*(tuple(x.split()) for x in key.split("|")))


def parse(tokens: list[tuple[str, bool, bool]], vocabulary: Vocabulary) -> Name:
    """The parts of a name given as ``split_name`` gives it."""
    rare: list[tuple[str, bool]] = []
    common: list[str] = []
    legal: set[str] = set()
    # legal forms first, the longest spellings, over the words with connectives and without
    whole = [w for w, _, _ in tokens]
    used: set[int] = set()
    i = 0
    while i < len(whole):
        for n in range(min(LONGEST, len(whole) - i), 0, -1):
            part = whole[i : i + n]
            joined = "".join(part) if n > 1 and all(len(w) == 1 for w in part) else ""
            form = FORM.get(tuple(part)) or FORM.get((joined,)) or FORM.get(tuple(w for w in whole[i : i + n] if w not in LINKS or w in ("z", "o", "a")))
            if form and not (n == 1 and tokens[i][1] and len(whole[i]) <= 1):
                legal.add(form)
                used.update(range(i, i + n))
                i += n - 1
                break
        i += 1
    rest = [t for k, t in enumerate(tokens) if k not in used and (t[0] not in LINKS)]
    if not rest:  # nothing but legal forms and connectives: they are the name
        rest = [t for t in tokens if t[0] not in LINKS] or tokens
        legal = set()
    k = 0
    while k < len(rest):
        w, dotted, tail = rest[k]
        pair = (w, rest[k + 1][0]) if k + 1 < len(rest) else None
        if pair in JUNK_PHRASES:
            k += 2
            continue
        if pair in PHRASES:
            common += PHRASES[pair]
            k += 2
            continue
        k += 1
        if w in JUNK or tail and len(w) == 2 and not dotted and w.isalpha() and w not in ALIASES and k == len(rest):
            continue
        if w in SHORT:
            common.append(SHORT[w])
        elif w in ALIASES:
            common += ALIASES[w].split()
        elif dotted:
            if len(w) >= 5 and w not in vocabulary.words and not vocabulary.shortens(w):
                rare.append((w + ".", tail))
            else:
                common.append(w + ".")
        elif w in vocabulary.words or w.isdigit() or len(w) <= 2:
            common.append(w)
        elif len(w) >= 6 and w in vocabulary.starts:
            common.append(w + ".")
        else:
            other = vocabulary.corrected(w)
            if other:
                common += ALIASES.get(other, other).split()
            else:
                rare.append((w, tail))
    if any(not t and len(w) >= 4 for w, t in rare):
        rare = [(w, t) for w, t in rare if not t]  # behind a separator: a place
    return Name(tuple(sorted({w for w, _ in rare})), tuple(sorted(set(common))), tuple(sorted(legal)))


def block_keys(name: Name) -> list[str]:
    """Keys of which two spellings of one name share at least one: the proper name within one
    edit at either, a truncation of it, or a pair of short proper names."""
    full = [w.rstrip(".") for w in name.rare]
    out: set[str] = set()
    single = len(name.rare) == 1
    for w in name.rare:
        if w.endswith("."):
            out.update(("p" + w[:-1], "d" + w[:-1]))
            continue
        if len(w) >= 4 and (single or len(w) >= 9):
            out.update("d" + x for x in deletions(w) if len(x) >= 4)
            out.update("p" + w[:k] for k in range(max(5, len(w) // 2), len(w) - 1))
            if "rn" in w:
                out.add("d" + w.replace("rn", "m"))
    for i, a in enumerate(full):
        for b in full[i + 1 :]:
            out.update("2" + " ".join(sorted((x, b))) for x in deletions(a))
            out.update("2" + " ".join(sorted((a, x))) for x in deletions(b))
    if not name.rare and name.common:
        out.add("c" + " ".join(name.common))
        if len(name.common) > 1:
            out.update("c" + " ".join(name.common[:k] + name.common[k + 1 :]) for k in range(len(name.common)))
    return sorted(out)


#: The channel: the steps from the intended name to the written one, and what each costs before
#: their probabilities are estimated (minus log probabilities); a pair beyond ``LIMIT`` is no pair.
COST = {"typo": 2.5, "truncated": 2.5, "short": 1.5, "acronym": 2.0, "dropped": 2.5, "added": 3.0, "form": 3.5, "form lost": 1.0, "proper only": 4.0}
LIMIT = 9.0


def _spelled(a: str, b: str) -> tuple[str, ...] | None:
    """The steps of writing the proper name ``b`` as ``a``."""
    if a == b:
        return ()
    if a.endswith(".") or b.endswith("."):
        x, y = a.rstrip("."), b.rstrip(".")
        short, long_ = (x, y) if len(x) <= len(y) else (y, x)
        if len(short) >= 4 and (long_.startswith(short) or edits(long_[: len(short)], short, 1) <= 1):
            return ("truncated",)
        return None
    if "rn" in a + b and a.replace("rn", "m") == b.replace("rn", "m"):
        return ("typo",)
    most = 1 if min(len(a), len(b)) < 8 else 2
    d = edits(a, b, most)
    return None if d > most else ("typo",) * d


def _abbreviates(short: str, long_: str, vocabulary: Vocabulary | None) -> bool:
    """Whether ``short`` (perhaps with a point) can abbreviate ``long_``: as its beginning, or by
    letters from within, unless ``short`` is the beginning of another established word."""
    dotted, s, t = short.endswith("."), short.rstrip("."), long_.rstrip(".")
    if not s or len(s) >= len(t) or s[0] != t[0]:
        return False
    if dotted and t.startswith(s):
        return True
    if not dotted and (len(s) < 2 or len(s) > 0.8 * len(t)):
        return False
    if t.startswith(s):
        return dotted or len(s) >= 3
    return len(s) >= 3 and _inside(s, t) and not (vocabulary and s in vocabulary.starts)


def _inside(short: str, long_: str) -> bool:
    """Whether the letters of ``short`` occur in ``long_`` in their order."""
    at = iter(long_)
    return all(c in at for c in short)


def cost(variant: Name, canonical: Name, vocabulary: Vocabulary | None = None) -> float | None:
    """Cost of writing ``canonical`` as ``variant`` before estimation; None where they cannot be one name."""
    steps = channel(variant, canonical, vocabulary)
    return None if steps is None else sum(COST[x] for x in steps)


def channel(variant: Name, canonical: Name, vocabulary: Vocabulary | None = None) -> list[str] | None:
    """The steps by which ``canonical`` was written as ``variant``; None where they cannot be one name.

    Every proper name of either must have its counterpart. Of the other words either side
    may hold more, but not both: different trades or kinds of body are different entities.
    """
    steps: list[str] = []
    short = True
    if variant.rare or canonical.rare:
        if len(variant.rare) != len(canonical.rare):
            return None
        left = list(canonical.rare)
        for a in variant.rare:
            best = min(((len(c), c, b) for b in left if (c := _spelled(a, b)) is not None), default=None)
            if best is None:
                return None
            steps += best[1]
            left.remove(best[2])
        short = len(variant.rare) > 1 and max(map(len, variant.rare)) < 9
        if short and len(steps) > 1:
            return None
    a, b = list(variant.common), list(canonical.common)
    for w in list(a):
        if w in b:
            a.remove(w)
            b.remove(w)
    matched = len(variant.common) > len(a)
    for x, y in ((a, b), (b, a)):  # abbreviations on either side
        for w in list(x):
            hit = next((v for v in y if {w, v} in EQUAL_WORDS or _abbreviates(w, v, vocabulary) and not (vocabulary and vocabulary.both(w, v))), None)
            if hit is not None:
                x.remove(w)
                y.remove(hit)
                steps.append("short")
                matched = True
                continue
            s = w.rstrip(".")
            some = [v for v in y if v[0] in s][: len(s)]
            if 2 <= len(s) <= 4 and sorted(v[0] for v in some) == sorted(s):
                x.remove(w)
                for v in some:
                    y.remove(v)
                steps.append("acronym")
                matched = True
    for w in list(a):  # misspelt words
        hit = next((v for v in b if len(v) >= 4 and edits(w, v, 1) <= 1 and not (vocabulary and vocabulary.both(w, v))), None)
        if hit is not None:
            a.remove(w)
            b.remove(hit)
            steps.append("typo")
            matched = True
    if a and b:
        return None
    if not matched and (variant.common or canonical.common) and not (variant.legal and variant.legal == canonical.legal):
        steps.append("proper only")
    steps += ["dropped"] * len(b) + ["added"] * len(a)
    f, g = set(variant.legal), set(canonical.legal)
    if f and g and not (f <= g or g <= f) and not any(f | g <= same for same in EQUAL_FORMS):
        if short:
            return None
        steps.append("form")
    elif f != g:
        steps.append("form lost")
    return steps if sum(COST[x] for x in steps) <= LIMIT else None
