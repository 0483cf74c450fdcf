"""Text normalisation shared by the operators on texts and names."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters that have no decomposition, and block-level tags.
LETTERS = {"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
LETTER = re.compile("[" + "".join(LETTERS) + "]")
ACCENT = re.compile("[\u0300-\u036f]+")
BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|th|tr|table|h[1-6]|hr|section|article|blockquote|pre)\b[^<>]*>", re.I)
ANY_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
#: UTF-8 read as Windows-1252 or Latin-1: a lead byte followed by continuation bytes.
CONTINUATION = "\u0080-¿" + "".join(bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
MOJIBAKE = re.compile(f"(?:[Â-ß][{CONTINUATION}]|[à-ï][{CONTINUATION}]{{2}})+")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
LINE_END_HYPHEN = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n\s*(?=\w)")
INNER_HYPHEN = re.compile(r"(?<=\w)[-‐‑'’](?=\w)")
GROUPED = re.compile(r"(?<=\d)[.,](?=\d{3}(?!\d))")
WORD = re.compile(r"[^\W_]+")


def _bytes(s: str) -> bytes:
    out = bytearray()
    for c in s:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            out += c.encode("latin-1")
    return bytes(out)


def _again(m: re.Match) -> str:
    try:
        return _bytes(m.group()).decode("utf-8")
    except UnicodeError:
        return m.group()


def mend(text: str) -> str:
    """``text`` with doubly encoded characters decoded again and invisible ones removed."""
    if not text.isascii():
        text = MOJIBAKE.sub(_again, text)
        text = INVISIBLE.sub("", text)
    return text


def plain(text: str) -> str:
    """``text`` without markup: entities resolved, block tags as breaks, inline tags gone."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = ANY_TAG.sub("", BLOCK_TAG.sub("\n", text))
    return mend(text)


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = ACCENT.sub("", unicodedata.normalize("NFKD", LETTER.sub(lambda m: LETTERS[m.group()], text.casefold())))
    if not text.isascii():
        other = [ord(c) for c in set(text) if unicodedata.combining(c)]
        text = LETTER.sub(lambda m: LETTERS[m.group()], text.translate(dict.fromkeys(other)) if other else text)
    return text


def words(text: str) -> list[str]:
    """The folded words of a text; case, accents, punctuation, tags, spacing and hyphens do not matter."""
    text = plain(text)
    if "-" in text or "'" in text or not text.isascii():
        text = INNER_HYPHEN.sub("", LINE_END_HYPHEN.sub("", text))
    text = GROUPED.sub("", text)
    return WORD.findall(fold(text))


def near(a: str, b: str) -> bool:
    """Whether ``b`` can be a misspelling of ``a``: one edit, two in words of six letters or more."""
    if a == b:
        return True
    most = 2 if min(len(a), len(b)) >= 6 else 1
    return min(len(a), len(b)) >= 3 and edits(a, b, most) <= most


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions; ``most + 1`` where it is more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return min(prev[-1], most + 1)
