"""Notice numbers in their several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``2017NNNNNNNN``, ``2017-NNNNNNNN`` and ``NNNNNNNN-2017`` (fixed values: the notations).
NUMBER = r"(?<!\d)(\d{4}-\d{8}|\d{8}-\d{4}|\d{12})(?!\d)"


def canonical_notice(c: Column) -> Column:
    """The first notice number in ``c`` as twelve digits, year first; null where there is none."""
    found = F.regexp_extract(c, NUMBER, 1)
    return F.when(found == "", F.lit(None)).otherwise(_twelve(found))


def notice_numbers(c: Column) -> Column:
    """All notice numbers in ``c``, canonical and without repeats; an empty array where there is none."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, _twelve)), F.array().cast("array<string>"))


def _twelve(found: Column) -> Column:
    year_last = F.instr(found, "-") == 9
    return F.when(year_last, F.concat(F.substring(found, 10, 4), F.substring(found, 1, 8))).otherwise(
        F.translate(found, "-", "")
    )
