"""Several values packed in one field: one row per value, with its slot.

A finite-state tokenizer walks each field once. It knows quoting (RFC 4180 doubled
quotes and backslash escapes) and the nesting depth of brackets; only delimiters
outside quotes, at the depth of the list itself, end a slot.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, CLOSE = "([{", ")]}"
#: Where the automaton can change its state; all between is copied at once.
EVENT = re.compile(r'["\\()\[\]{};|,\n\r\t/ ]|---+')
#: A comma between two digits of a list of weights, of which the automaton cannot tell alone whether it is decimal.
SOFT = "\0"


@dataclass(frozen=True)
class Packed:
    """A packed field. ``kind``: ``codes`` (blanks and slashes separate too), ``labels``
    or ``weights`` (a comma may be decimal; ``partner`` names the field whose number of
    values tells which)."""

    field: str
    kind: str
    partner: str | None = None


def tokenize(text: str | None, kind: str = "labels", soft: bool = False) -> list[str]:
    """The slots of ``text`` in order, empty ones too, as values without quotes and brackets.

    With ``soft`` a comma outside quotes with a digit on either side ends no slot but stands in it as ``SOFT``.
    Null gives no slot. A trailing delimiter opens no further slot. An unclosed quote or
    bracket is text, so nothing is lost.
    """
    if text is None:
        return []
    text = text.strip()
    if not text:
        return []
    slots = _walk(text, kind, soft)
    if slots is None:  # unclosed quotes or brackets: they are ordinary characters
        slots = _walk(text, kind, soft, literal=True)
    if len(slots) > 1 and slots[-1] == "":
        slots.pop()
    return slots


def _walk(text: str, kind: str, soft: bool, literal: bool = False) -> list[str] | None:
    codes = kind == "codes"
    base = 0
    if not literal and text[0] == "[" and text[-1] == "]":
        text, base = text[1:-1].strip(), 1
    slots: list[str] = []
    buf: list[str] = []
    depth, quoted, was_quoted, filled, at, n = 0, False, False, False, 0, len(text)

    def end() -> None:
        nonlocal was_quoted, filled
        value = "".join(buf).strip()
        if not was_quoted and len(value) > 1 and value[0] in OPEN and value[-1] == CLOSE[OPEN.index(value[0])]:
            value = value[1:-1].strip()
        slots.append(value)
        buf.clear()
        was_quoted = filled = False

    while at < n:
        if quoted:
            stop = at
            while stop < n and text[stop] not in '"\\':
                stop += 1
            buf.append(text[at:stop])
            filled = True
            if stop == n:
                return None
            if text[stop] == "\\":
                if stop + 1 < n and text[stop + 1] in '"\\':
                    buf.append(text[stop + 1])
                    at = stop + 2
                else:
                    buf.append("\\")
                    at = stop + 1
            elif stop + 1 < n and text[stop + 1] == '"':
                buf.append('"')
                at = stop + 2
            else:
                quoted, at = False, stop + 1
            continue
        m = EVENT.search(text, at)
        if m is None:
            buf.append(text[at:])
            break
        piece = text[at : m.start()]
        buf.append(piece)
        filled = filled or bool(piece.strip())
        c, at = m.group(), m.end()
        if c == '"' and not literal and not filled:
            buf.clear()
            quoted = was_quoted = True
        elif c in OPEN and not literal:
            depth += 1
            buf.append(c)
            filled = True
        elif c in CLOSE and not literal:
            depth = max(0, depth - 1)
            buf.append(c)
            filled = True
        elif c == "," and soft and not base and not was_quoted and text[m.start() - 1 : m.start()].isdigit() and text[at : at + 1].isdigit():
            buf.append(SOFT)
            filled = True
        elif depth:
            buf.append(c)
        elif c[0] == "-":
            for _ in range(len(c) // 3):
                end()
            buf.append(c[len(c) // 3 * 3 :])
        elif c in ";|\t":
            end()
        elif c in "\n\r":
            if c == "\r" and at < n and text[at] == "\n":
                at += 1
            end()
        elif c == ",":
            end()
        elif c == "/" and codes:
            end()
        elif c == " " and codes:
            # a blank separates only where no other delimiter stands beside it
            while at < n and text[at] == " ":
                at += 1
            if filled and at < n and (text[at] == '"' or not EVENT.match(text, at)):
                end()
        else:
            buf.append(c)
            filled = filled or c != " "
    if depth:
        return None
    end()
    return slots


def tokenize_weights(text: str | None, n_values: int) -> list[str]:
    """The slots of a list of weights in which a comma may be a decimal mark.

    Where a comma can be either, the reading is taken that gives ``n_values`` values (the
    number of criteria in the row), and among several such the one whose sum is nearest
    to 100. Where none gives that number, a lone comma between digits is decimal.
    """
    slots = tokenize(text, "weights", soft=True)
    if not any(SOFT in x for x in slots):
        return slots
    groups: list[list[str]] = []
    for x in slots:
        parts = [p.strip() for p in x.split(SOFT)]
        if len(parts) == 1 or all(p.isdigit() for p in parts):
            groups.append(parts)
        elif len(parts) == 2 and parts[0].isdigit() and parts[1].rstrip("% ").isdigit():  # a percentage of its own
            groups.append([x.replace(SOFT, ",")])
        else:  # numbers with points or blanks beside: commas separate
            groups += [[p] for p in parts]
    marks = [(g, k) for g, x in enumerate(groups) for k in range(len(x) - 1)]
    if not marks:
        return [x for g in groups for x in g]
    whole = sum(bool(x) for g in groups for x in g)
    need = whole - n_values  # so many of the marks are decimal
    chosen: set[tuple[int, int]] | None = None
    if need == 0:
        chosen = set()
    elif 0 < need <= len(marks):
        pairs = all(len(g) % 2 == 0 for g in groups if len(g) > 1)
        if pairs and need == sum(len(g) // 2 for g in groups if len(g) > 1):
            chosen = {(g, k) for g, k in marks if k % 2 == 0}
        else:
            chosen = _nearest(groups, need)
    if chosen is None:
        chosen = {(g, 0) for g, x in enumerate(groups) if len(x) == 2}
    return _join(groups, chosen)


def _join(groups: list[list[str]], decimal: set[tuple[int, int]]) -> list[str]:
    out: list[str] = []
    for g, parts in enumerate(groups):
        held = parts[0]
        for k, p in enumerate(parts[1:]):
            if (g, k) in decimal:
                held += "," + p
            else:
                out.append(held)
                held = p
        out.append(held)
    return out


def _nearest(groups: list[list[str]], need: int) -> set[tuple[int, int]] | None:
    """The ``need`` marks, no two of them adjacent, that as decimal commas bring the sum nearest
    to 100; of several such the first in order. None where there are not so many.

    From left to right each value takes one part or two. Of the readings of a beginning with
    equal decimals and sum the first is kept, and of those whose sums reach 100 the smallest."""
    parts = [(g, k) for g, x in enumerate(groups) for k in range(len(x))]
    one = [_exact(groups[g][k]) for g, k in parts]
    two = [_exact(f"{groups[g][k]},{groups[g][k + 1]}") if k + 1 < len(groups[g]) else None for g, k in parts]
    grows = all(v is None or v >= 0 for v in one + two)
    room = [0] * (len(parts) + 2)  # so many marks at most can still be decimal
    for i in reversed(range(len(parts))):
        room[i] = max(room[i + 1], 1 + room[i + 2]) if two[i] is not None else room[i + 1]
    states: list[dict[tuple[int, Fraction], tuple[int, ...]]] = [{} for _ in range(len(parts) + 2)]
    states[0][0, Fraction(0)] = ()
    for i in range(len(parts)):
        over: dict[int, Fraction] = {}
        for used, total in states[i]:
            if total >= 100:
                over[used] = min(total, over.get(used, total))
        for (used, total), some in states[i].items():
            if used + room[i] < need or grows and total >= 100 and total > over[used]:
                continue
            steps = [(i + 1, used, total + one[i], some)]
            if two[i] is not None and used < need:
                steps.append((i + 2, used + 1, total + two[i], (*some, i)))
            for at, n, x, t in steps:
                if (n, x) not in states[at] or t < states[at][n, x]:
                    states[at][n, x] = t
        states[i] = {}
    ends = [(abs(total - 100), some) for (used, total), some in states[len(parts)].items() if used == need]
    return {parts[i] for i in min(ends)[1]} if ends else None


def _exact(v: str) -> Fraction:
    v = v.replace("%", "").replace(",", ".").strip()
    if re.fullmatch(r"[0-9]+(\.[0-9]*)?", v):
        return Fraction(v)
    x = _number(v)
    return Fraction(x) if math.isfinite(x) else Fraction(0)


def _number(v: str) -> float:
    try:
        return float(v.replace("%", "").replace(",", ".").strip() or 0)
    except ValueError:
        return 0.0


def split_fields(df: DataFrame, id_col: str, fields: list[Packed], ref_table: str, min_values: int = 1) -> DataFrame:
    """One row per value of each packed field of ``df``.

    Columns: ``ref_table``, ``<id_col>``, ``field_name``, ``pos`` (int, counts the slots from
    1, empty ones too), ``item_text``, ``n_values``. Only fields with at least ``min_values``
    values are returned. Nulls, empty and blank fields give no rows; repeated rows count
    each; a null id stays null; other columns of ``df`` are never read. An empty table gives
    an empty result. The plan is one scan and one Arrow map: no shuffle, so no key can be hot.
    """
    names = list(dict.fromkeys([x for p in fields for x in (p.field, p.partner) if x]))
    plan = [(p.field, p.kind, names.index(p.field) + 1, names.index(p.partner) + 1 if p.partner else None) for p in fields]
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"ref_table string, {id_col} {id_type}, field_name string, pos int, item_text string, n_values int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            take: list[int] = []
            field_names: list[str] = []
            poss: list[int] = []
            items: list[str] = []
            counts: list[int] = []
            columns = {k: batch.column(k).to_pylist() for k in range(1, batch.num_columns)}
            for name, kind, k, partner in plan:
                others = columns[partner] if partner else None
                for row, text in enumerate(columns[k]):
                    if not text:
                        continue
                    if kind == "weights":
                        n = sum(bool(x) for x in tokenize(others[row])) if others is not None and "," in text else 0
                        slots = tokenize_weights(text, n)
                    else:
                        slots = tokenize(text, kind)
                    m = sum(map(bool, slots))
                    if m < min_values:
                        continue
                    for pos, value in enumerate(slots, 1):
                        if value:
                            take.append(row)
                            field_names.append(name)
                            poss.append(pos)
                            items.append(value)
                            counts.append(m)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ref_table] * len(take), pa.string()),
                    ids.take(pa.array(take, pa.int64())),
                    pa.array(field_names, pa.string()),
                    pa.array(poss, pa.int32()),
                    pa.array(items, pa.string()),
                    pa.array(counts, pa.int32()),
                ],
                names=["ref_table", id_col, "field_name", "pos", "item_text", "n_values"],
            )

    return df.select(id_col, *names).mapInArrow(run, schema)
