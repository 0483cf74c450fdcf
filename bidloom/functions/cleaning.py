"""Scalar cleaning of raw notice fields, as Column expressions that stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TRUE_TOKENS = ("Y", "YES", "1", "TRUE", "T")
FALSE_TOKENS = ("N", "NO", "0", "FALSE", "F")
DATE_FORMATS = ("d-MMM-yy", "d/M/yy", "yyyy-M-d", "d/M/yyyy", "yyyyMMdd", "d-M-yyyy")
DATE_SHAPES = (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{8}$", r"^\d{1,2}-\d{1,2}-\d{4}$")
#: Identifiers that name nobody: those of suppliers, and those of buyers.
PLACEHOLDER_IDS = (
    "0", "1", "00", "000", "0000", "NA", "NAN", "NONE", "NULL", "UNKNOWN", "NOTAVAILABLE", "NOTAPPLICABLE", "VAT", "VATNO", "NIL", "NOID", "NATIONALID", "REGISTRATIONNUMBER",
)
BUYER_PLACEHOLDERS = ("0000", "000000", "00000000", "NA", "NONE", "UNKNOWN", "NULL")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean_text(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def upper_clean(c: Column) -> Column:
    return F.upper(clean_text(c))


def normalize_entity(c: Column) -> Column:
    """Lower case, each run of other than ASCII letters and digits one blank; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^\p{Alnum}]+", " ")), F.lit(""))


def normalize_identifier(c: Column) -> Column:
    """Upper case ASCII letters and digits only; empty is null."""
    return F.nullif(F.regexp_replace(F.upper(c), r"[^\p{Alnum}]+", ""), F.lit(""))


def match_text(c: Column) -> Column:
    """Lower case words of ASCII letters and digits, one blank between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def parse_bool(c: Column) -> Column:
    """True, false or null of the usual tokens."""
    t = upper_clean(c)
    return F.when(t.isin(*TRUE_TOKENS), True).when(t.isin(*FALSE_TOKENS), False)


def parse_number(c: Column) -> Column:
    """A number in plain notation; null for anything else."""
    t = clean_text(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def parse_number_lenient(c: Column) -> Column:
    """A number with blanks and percent signs left out and a decimal comma allowed."""
    return parse_number(F.replace(F.replace(F.replace(c.cast("string"), F.lit(" "), F.lit("")), F.lit("%"), F.lit("")), F.lit(","), F.lit(".")))


def parse_date(c: Column) -> Column:
    """A day in one of the six notations. Two-digit years below 69 are 20xx, the others 19xx."""
    t = clean_text(c)
    tries = []
    for shape, fmt in zip(DATE_SHAPES, DATE_FORMATS):
        day = F.try_to_timestamp(F.when(t.rlike(shape), t), F.lit(fmt)).cast("date")
        if "yyyy" not in fmt:
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tries.append(day)
    return F.coalesce(*tries)


def parse_date_legacy(c: Column) -> Column:
    """The older parser: three notations, d/m/yyyy before d/m/yy, so 22/12/16 is year 16. Kept for comparison."""
    t = clean_text(c)
    return F.coalesce(
        F.try_to_timestamp(F.when(t.rlike(DATE_SHAPES[2]), t), F.lit("yyyy-M-d")).cast("date"),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2,4}$"), F.try_to_timestamp(F.regexp_replace(t, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", "$100$2"), F.lit("d/M/yyyy")).cast("date")),
    )


def repair_year(d: Column) -> Column:
    """A date whose century was lost, two thousand years later."""
    return F.when(F.year(d) < 100, F.add_months(d, 24000)).otherwise(d)


def cpv_digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def cpv_valid(c: Column) -> Column:
    """The code of exactly eight digits; null where there are fewer or more."""
    d = cpv_digits(c)
    return F.when(F.length(d) == 8, d)


def cpv_prefix(c: Column, n: int) -> Column:
    d = cpv_digits(c)
    return F.when(F.length(d) >= n, F.substring(d, 1, n))


def nuts_code(c: Column) -> Column:
    """A region code of three to five characters (a bare country is none), upper case without blanks; null where malformed."""
    t = F.upper(F.regexp_replace(F.trim(c), r"\s+", ""))
    return F.when(t.rlike("^[A-Z]{2}[A-Z0-9]{1,3}$"), t)


def iso2(c: Column) -> Column:
    t = upper_clean(c)
    return F.when(t.rlike("^[A-Z]{2}$"), t)


def alnum(c: Column) -> Column:
    """Upper case A to Z and digits only, of the trimmed text; empty is null."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", ""), F.lit(""))


def buyer_key(country: Column, ident: Column, name: Column) -> Column:
    """``BID||country||id`` where the identifier is usable (four characters at least, no
    placeholder, not only zeros), else ``BN||country||name``; null without a country of two letters."""
    c, i, n = upper_clean(country), alnum(ident), alnum(name)
    c = F.when(F.length(c) == 2, c)
    usable = (F.length(i) >= 4) & ~i.isin(*BUYER_PLACEHOLDERS) & ~i.rlike("^0+$")
    return F.when(c.isNotNull() & usable, F.concat(F.lit("BID||"), c, F.lit("||"), i)).when(c.isNotNull() & n.isNotNull(), F.concat(F.lit("BN||"), c, F.lit("||"), n))


def award_key(notice: Column, award: Column) -> Column:
    """``notice||award``; null where either is."""
    return F.concat(clean_text(notice), F.lit("||"), clean_text(award))


def supplier_key(country: Column, ident: Column, name: Column, town: Column) -> Column:
    """The provisional key: the strongest of identifier and country, name and country, town and name."""
    return _supplier_ladder(country, ident, name, town).getField("key")


def supplier_key_method(country: Column, ident: Column, name: Column, town: Column) -> Column:
    return _supplier_ladder(country, ident, name, town).getField("method")


def _supplier_ladder(country: Column, ident: Column, name: Column, town: Column) -> Column:
    c, i, n, t = upper_clean(country), normalize_identifier(ident), normalize_entity(name), normalize_entity(town)

    def rung(label: str, method: str, *parts: Column) -> Column:
        return F.struct(F.concat_ws("||", F.lit(label), *parts).alias("key"), F.lit(method).alias("method"))

    return (
        F.when(i.isNotNull() & c.isNotNull(), rung("nid_country", "national_id_country", c, i))
        .when(n.isNotNull() & c.isNotNull(), rung("name_country", "normalized_name_country", c, n))
        .when(n.isNotNull() & t.isNotNull(), rung("name_town", "normalized_name_town", t, n))
        .otherwise(F.struct(F.lit(None).cast("string").alias("key"), F.lit("unresolved").alias("method")))
    )


def group_or_list(group: Column, name: Column, ident: Column, country: Column, town: Column) -> Column:
    """Whether an award names several suppliers: flagged so, or a list in any of its fields."""
    return F.coalesce(group, F.lit(False)) | is_list_field(name) | is_list_field(ident) | is_list_field(country) | is_list_field(town)


def id_hygiene(ident: Column, country: Column, group: Column, min_length: int = 4) -> Column:
    """Why an identifier can or cannot anchor an entity, the first reason that applies."""
    t, k = normalize_identifier(ident), upper_clean(country)
    return (
        F.when(t.isNull(), "missing")
        .when(is_list_field(ident), "multi_value_identifier")
        .when(group, "group_or_list_record")
        .when(k.isNull(), "missing_country_context")
        .when(F.length(k) != 2, "invalid_country_context")
        .when(t == k, "country_code_placeholder")
        .when(t.isin(*PLACEHOLDER_IDS), "generic_placeholder")
        .when(F.length(t) < min_length, "suspicious_short")
        .otherwise("candidate_valid_anchor")
    )


def is_list_field(c: Column) -> Column:
    return F.instr(F.coalesce(c, F.lit("")), "---") > 0


def list_tokens(c: Column, mark: str = "---") -> Column:
    """How many tokens a list field holds; 0 for null or blank."""
    t = clean_text(c)
    return F.when(t.isNull(), F.lit(0)).otherwise(((F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark) + 1).cast("int"))


def first_number(*columns: Column) -> Column:
    """The first of several fields that holds a number."""
    return F.coalesce(*[parse_number(c) for c in columns])


def recency(days: Column) -> Column:
    """1 / (1 + days); null where days are negative or null."""
    return F.when(days >= 0, 1.0 / (1.0 + days))


def finite(c: Column) -> Column:
    """``c`` where it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def first_of(*rules: tuple[Column, str], otherwise: str | None = None) -> Column:
    """An ordered ladder of labels: the first rule that holds gives the label."""
    ladder = reduce(lambda w, r: w.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1])))
    return ladder if otherwise is None else ladder.otherwise(F.lit(otherwise))
