"""Raw delimited lines to rows, with the lines that cannot be loaded and why."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.can_schema import CAN_COLUMNS

#: The delimiters that occur, and English month names of the first notation.
DELIMITERS = ("\t", ",", ";", "|")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: The six date notations, each with the groups' meaning.
NOTATIONS = (
    (re.compile(r"(\d{1,2})-([A-Za-z]{3})-(\d{2})"), "dby"),
    (re.compile(r"(\d{1,2})/(\d{1,2})/(\d{2})"), "dmy"),
    (re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})"), "Ymd"),
    (re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})"), "dmY"),
    (re.compile(r"(\d{4})(\d{2})(\d{2})"), "Ymd"),
    (re.compile(r"(\d{1,2})-(\d{1,2})-(\d{4})"), "dmY"),
)


class FieldError(ValueError):
    """A field that its typed constructor refuses; ``args[0]`` is the reason."""


def notice_number(text: str, year: str) -> str:
    """Typed constructor of a notice number: twelve ASCII digits beginning with ``year``."""
    if not (len(text) == 12 and text.isascii() and text.isdigit() and text.startswith(year)):
        raise FieldError("bad_id")
    return text


def award_date(text: str) -> date | None:
    """Typed constructor of a date in one of the six notations; empty is no date."""
    if not text:
        return None
    for pattern, order in NOTATIONS:
        m = pattern.fullmatch(text) if text.isascii() else None
        if not m:
            continue
        part = dict(zip(order, m.groups()))
        try:
            month = MONTHS.index(part["b"].upper()) + 1 if "b" in part else int(part["m"])
            year = int(part["Y"]) if "Y" in part else (lambda y: y + (1900 if y >= 69 else 2000))(int(part["y"]))
            return date(year, month, int(part["d"]))
        except ValueError:
            continue
    raise FieldError("bad_date")


def assemble(lines: Iterable[str], delimiter: str) -> Iterator[tuple[list[str], bool]]:
    """The records of which physical ``lines`` are the parts, quote-aware: each as its lines and
    whether its quotes are closed (only the last can be left open).

    A quote opens at the start of a field and closes where none follows it; a line that ends
    inside quotes is continued by the next."""
    held: list[str] = []
    inside = False
    for line in lines:
        held.append(line)
        inside = _open_after(line, delimiter, inside)
        if not inside:
            yield held, True
            held = []
    if held:
        yield held, False


def _open_after(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that began so."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while at < n:
        if not inside:
            if line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(delimiter, at) + 1 or n
            continue
        at = line.find('"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == '"':
            at += 2
        else:  # closed: what follows up to the delimiter is for the strict reader to judge
            inside, at = False, line.find(delimiter, at) + 1 or n
    return inside


def parse_record(raw: str, delimiter: str, width: int) -> list[str]:
    """The fields of one record, assembled from its physical lines and read by the strict csv reader.

    Raises ``FieldError("quoting")`` where the quotes break RFC 4180 (left open, text after
    the closing quote, a quote inside an unquoted field), ``FieldError("column_count")``
    where there are not ``width`` fields or the lines hold several records.
    """
    found = [raw] if "\n" not in raw else ["\n".join(x) for x, _ in assemble(raw.split("\n"), delimiter)]
    try:
        records = [r for x in found for r in csv.reader(io.StringIO(x, newline=""), delimiter=delimiter, strict=True)]
    except csv.Error:
        raise FieldError("quoting") from None
    if '"' in raw and not _quotes_start_fields(raw, delimiter):
        raise FieldError("quoting")
    if len(records) != 1 or len(records[0]) != width:
        raise FieldError("column_count")
    return records[0]


#: Lines of a file that are looked at together.
CHUNK = 10_000


def assemble_lines(lines: DataFrame, columns: tuple[str, ...] | list[str] = tuple(CAN_COLUMNS), chunk: int = CHUNK) -> DataFrame:
    """``source_file, line_no, raw_line, n_lines``: the records of files given as physical lines
    (``source_file, line_no, raw_line``), each at its first line.

    A line that is a whole record of ``len(columns)`` fields by itself is one. The lines
    between two such are assembled quote-aware from the first on; where that leaves a record
    open or of another width, its first line stands alone, to be rejected, and assembly goes
    on with the next line, so a broken quote costs no other record. Line 1 is the header. A
    null ``raw_line`` is an empty line; lines with a null file or number get no row; repeated
    lines count each; other columns are ignored; an empty table gives an empty result.

    Lines never meet by file: a file is looked at in chunks of ``chunk`` lines, one row per
    chunk says where its last whole record is, and only the lines that are none are grouped.
    A stretch of more than ``chunk`` lines without any whole record is assembled in pieces of
    that length.
    """
    width = len(columns)
    base = lines.select("source_file", "line_no", F.coalesce("raw_line", F.lit("")).alias("raw_line")).filter("source_file is not null and line_no is not null")
    named = base.join(file_layouts(base).select(F.col("source_file").alias("_file"), "_delimiter"), F.col("source_file") == F.col("_file")).drop("_file")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for n, raw, d in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                try:
                    flags.append(n == 1 or len(parse_record(raw, d, width)) == width)
                except FieldError:
                    flags.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "whole"])

    flagged = named.mapInArrow(whole, "source_file string, line_no bigint, raw_line string, _delimiter string, whole boolean").withColumn("_chunk", F.floor(F.col("line_no") / chunk))
    last = flagged.groupBy("source_file", "_chunk").agg(F.max(F.when(F.col("whole"), F.col("line_no"))).alias("_at"))
    before = last.withColumn("_before", F.last("_at", True).over(Window.partitionBy("source_file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_at")
    own = F.last(F.when(F.col("whole"), F.col("line_no")), True).over(Window.partitionBy("source_file", "_chunk").orderBy("line_no"))
    rest = flagged.withColumn("_own", own).filter("not whole").join(before, ["source_file", "_chunk"])
    start = F.coalesce("_own", "_before", F.lit(0))
    rest = rest.withColumn("_run", start).withColumn("_piece", F.floor((F.col("line_no") - F.col("_run")) / chunk))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        raws, numbers, d = pdf["raw_line"].tolist(), pdf["line_no"].tolist(), pdf["_delimiter"].iloc[0]
        out, at = [], 0
        while at < len(raws):
            held, closed = next(assemble(raws[at:], d))
            text = "\n".join(held)
            try:
                if len(held) > 1:
                    parse_record(text, d, width)
            except FieldError:
                held, text = held[:1], raws[at]
            out.append((pdf["source_file"].iloc[0], numbers[at], text, len(held)))
            at += len(held)
        return pd.DataFrame(out, columns=["source_file", "line_no", "raw_line", "n_lines"])

    schema = "source_file string, line_no bigint, raw_line string, n_lines int"
    joined = rest.select("source_file", "line_no", "raw_line", "_delimiter", "_run", "_piece").groupBy("source_file", "_run", "_piece").applyInPandas(join, schema)
    return flagged.filter("whole").select("source_file", "line_no", "raw_line", F.lit(1).alias("n_lines")).unionByName(joined)


def _quotes_start_fields(raw: str, delimiter: str) -> bool:
    """Whether no unquoted field holds a quote. ``raw`` is well formed otherwise."""
    at, n = 0, len(raw)
    while at < n:
        if raw[at] == '"':
            at += 1
            while True:
                at = raw.index('"', at)
                if raw[at + 1 : at + 2] != '"':
                    break
                at += 2
            at += 1
        else:
            stop = raw.find(delimiter, at)
            stop = n if stop < 0 else stop
            if raw.find('"', at, stop) >= 0:
                return False
            at = stop
        while at < n and raw[at] in "\r\n":
            at += 1
        if at < n and raw[at] == delimiter:
            at += 1
    return True


def file_layouts(lines: DataFrame) -> DataFrame:
    """Delimiter and header of each ``source_file``: one small row per file.

    The delimiter is the candidate that occurs most in line 1, or over all lines where
    line 1 is absent. One scan with map-side aggregation; the rows of one file never meet
    in one task.
    """
    def occurs(d: str):
        return F.length("raw_line") - F.length(F.replace(F.col("raw_line"), F.lit(d), F.lit("")))

    head = F.col("line_no") == 1
    counts = [F.struct(F.coalesce(F.max(F.when(head, occurs(d))), F.lit(-1)).alias("h"), F.coalesce(F.sum(occurs(d)), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)]
    return lines.groupBy("source_file").agg(F.greatest(*counts).getField("d").alias("_delimiter"), F.max(F.when(head, F.col("raw_line"))).alias("_header"))


def load_lines(lines: DataFrame, year: str = "2015", columns: tuple[str, ...] | list[str] = tuple(CAN_COLUMNS)) -> DataFrame:
    """Every line but headers, as ``line_id, source_file, line_no, reason, award_date, fields``.

    ``reason`` is null for a loaded line, whose ``fields`` (array) hold the values in the
    order of ``columns``; else it is the first that applies of ``quoting``,
    ``column_count``, ``bad_id``, ``bad_date``. A null or empty ``raw_line`` is one empty
    field (``column_count``). A null ``line_no`` is no header. Repeated lines count each;
    an empty table gives an empty result; extra columns of ``lines`` are ignored. A column
    missing from the header is looked for at its place in ``columns``.

    Plan: a scan, a map-side aggregate to one row per file, a join to that (skew-split by
    AQE where a file is hot and the list of files is too long to broadcast), one Arrow map.
    """
    width = len(columns)
    layouts = file_layouts(lines.select("source_file", "line_no", "raw_line"))
    body = (
        lines.select("line_id", "source_file", "line_no", "raw_line")
        .filter(F.coalesce(F.col("line_no") != 1, F.lit(True)))
        .join(layouts.withColumnRenamed("source_file", "_file"), F.col("source_file").eqNullSafe(F.col("_file")), "left")
        .drop("_file")
    )
    schema = "line_id bigint, source_file string, line_no bigint, reason string, award_date date, fields array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        places: dict[tuple[str | None, str | None], list[int]] = {}
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            reasons: list[str | None] = []
            dates: list[date | None] = []
            rows: list[list[str] | None] = []
            for raw, d, header in zip(get["raw_line"].to_pylist(), get["_delimiter"].to_pylist(), get["_header"].to_pylist()):
                d = d or DELIMITERS[0]
                order = places.get((d, header))
                if order is None:
                    order = places[d, header] = _order(header, d, columns)
                try:
                    fields = parse_record(raw or "", d, width)
                    fields = [fields[k] for k in order]
                    notice_number(fields[0], year)
                    dates.append(award_date(fields[-1]))
                    rows.append(fields)
                    reasons.append(None)
                except FieldError as e:
                    dates.append(None)
                    rows.append(None)
                    reasons.append(e.args[0])
            yield pa.RecordBatch.from_arrays(
                [get["line_id"], get["source_file"], get["line_no"], pa.array(reasons, pa.string()), pa.array(dates, pa.date32()), pa.array(rows, pa.list_(pa.string()))],
                names=["line_id", "source_file", "line_no", "reason", "award_date", "fields"],
            )

    return body.mapInArrow(run, schema)


def _order(header: str | None, delimiter: str, columns: tuple[str, ...] | list[str]) -> list[int]:
    """Where each of ``columns`` stands in the file, by its header."""
    same = list(range(len(columns)))
    if not header:
        return same
    try:
        names = [x.strip().lstrip("﻿").strip('"').upper() for x in parse_record(header.lstrip("﻿"), delimiter, len(columns))]
    except FieldError:
        return same
    found = {n: k for k, n in enumerate(names)}
    return [found[c] for c in columns] if set(found) == set(columns) else same


def loaded_rows(loaded: DataFrame, columns: tuple[str, ...] | list[str] = tuple(CAN_COLUMNS)) -> DataFrame:
    """The loaded lines of ``load_lines`` as rows of named columns (empty text is null)."""
    named = [F.nullif(F.col("fields")[k], F.lit("")).alias(c.lower() if c != "YEAR" else "notice_year") for k, c in enumerate(columns)]
    return loaded.filter("reason is null").select("line_id", "source_file", "line_no", *named, F.col("award_date").alias("dt_award_clean"))


def failed_lines(loaded: DataFrame) -> DataFrame:
    """The lines of ``load_lines`` that could not be loaded, with the reason."""
    return loaded.filter("reason is not null").select("line_id", "reason")
