"""Document dates from French free text or from the file name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month spellings.
MONTHS = {
    "janv": 1, "jan": 1, "janvier": 1,
    "fev": 2, "fév": 2, "fevr": 2, "févr": 2, "fevrier": 2, "février": 2,
    "mars": 3, "mar": 3,
    "avr": 4, "avril": 4,
    "mai": 5,
    "juin": 6, "jun": 6,
    "juil": 7, "juillet": 7, "jul": 7,
    "aout": 8, "août": 8, "aou": 8,
    "sept": 9, "sep": 9, "septembre": 9,
    "oct": 10, "octobre": 10,
    "nov": 11, "novembre": 11,
    "dec": 12, "déc": 12, "decembre": 12, "décembre": 12,
}
FIRST_YEAR = 2010

# Accepted shapes in text (the first one found decides) and in file names.
TEXT_ISO = r"(\d{4})-(\d{2})-(\d{2})"
TEXT_NUMERIC = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})\b"
TEXT_DAY_MONTH = r"\b(\d{1,2})(?:er)?\s+([a-zéû]+)\.?\s+(\d{4})\b"
TEXT_MONTH = r"\b([a-zéû]+)\.?\s+(\d{4})\b"
TEXT_YEAR_MONTH = r"\b(\d{4})-(\d{2})\b"
FILE_YEAR_FIRST = r"(20\d{2})[-_ .]?(0[1-9]|1[0-2])[-_ .]?(0[1-9]|[12]\d|3[01])(?!\d)"
FILE_DAY_FIRST = r"(?<!\d)(0[1-9]|[12]\d|3[01])[-_./](0[1-9]|1[0-2])[-_./](20\d{2}|\d{2})(?!\d)"
FILE_COMPACT = r"(?<!\d)(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])(\d{2})(?!\d)"
FILE_YEAR_MONTH = r"(?<!\d)(20\d{2})[-_ .](0[1-9]|1[0-2])(?!\d)"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shaped(text: Column, pattern: str, order: str) -> Column:
    """The first match rewritten as year-month-day; empty when nothing matches."""
    return F.regexp_replace(F.regexp_extract(text, pattern, 0), pattern, order)


def _date(shaped: Column, last_year: Column) -> Column:
    """A real calendar date within the plausible years, else NULL."""
    full = F.when(shaped.rlike(r"^\d\d-"), F.concat(F.lit("20"), shaped)).otherwise(shaped)
    return bind(
        F.try_to_date(full, "yyyy-M-d"),
        lambda date: F.when(F.year(date).between(F.lit(FIRST_YEAR), last_year), date),
    )


def _numbered(shaped: Column) -> Column:
    """Year-month-day with the month word as a number; two parts only when it is no month."""
    months = F.create_map(*[F.lit(x) for name, n in MONTHS.items() for x in (name, str(n))])
    parts = F.split(shaped, "-")
    number = F.try_element_at(months, F.get(parts, F.lit(1)))
    return F.concat_ws("-", F.get(parts, F.lit(0)), number, F.get(parts, F.lit(2)))


def default_last_year() -> Column:
    return F.year(F.current_date()) + 1


def date_from_text(value: Column, last_year: Column | None = None) -> Column:
    """Free text to a date; an impossible date in the first matching shape gives NULL."""
    last = default_last_year() if last_year is None else last_year

    def read(text: Column) -> Column:
        # a word that is no month leaves two parts only, and the next shape is tried
        day_month = _numbered(_shaped(text, TEXT_DAY_MONTH, "$3-$2-$1"))
        month_only = _numbered(_shaped(text, TEXT_MONTH, "$2-$1-1"))
        is_date = r"^\d+-\d+-\d+$"
        return (
            F.when(text.rlike(TEXT_ISO), _date(_shaped(text, TEXT_ISO, "$1-$2-$3"), last))
            .when(
                text.rlike(TEXT_NUMERIC), _date(_shaped(text, TEXT_NUMERIC, "$3-$2-$1"), last)
            )
            .when(text.rlike(TEXT_DAY_MONTH) & day_month.rlike(is_date), _date(day_month, last))
            .when(text.rlike(TEXT_MONTH) & month_only.rlike(is_date), _date(month_only, last))
            .when(
                text.rlike(TEXT_YEAR_MONTH), _date(_shaped(text, TEXT_YEAR_MONTH, "$1-$2-1"), last)
            )
        )

    return bind(F.lower(F.trim(value)), read)


def date_from_file_name(value: Column, last_year: Column | None = None) -> Column:
    """File name to a date; an impossible date falls through to the next shape."""
    last = default_last_year() if last_year is None else last_year
    shapes = (
        (FILE_YEAR_FIRST, "$1-$2-$3"),
        (FILE_DAY_FIRST, "$3-$2-$1"),
        (FILE_COMPACT, "$3-$2-$1"),
        (FILE_YEAR_MONTH, "$1-$2-1"),
    )
    return bind(
        F.regexp_replace(value, r"(?i)\.[a-z0-9]{2,5}$", ""),
        lambda name: F.coalesce(*[_date(_shaped(name, p, order), last) for p, order in shapes]),
    )


def recovered(date_text: Column, file_name: Column, last_year: Column | None = None) -> Column:
    """Struct (document_date, date_source): ISO text as it is, other text, then the file name.

    NULL when no date is found; each reading is tried only when the ones before failed.
    """

    def found(date: Column, source: str) -> Column:
        return bind(
            date,
            lambda d: F.when(
                d.isNotNull(), F.struct(d.alias("document_date"), F.lit(source).alias("date_source"))
            ),
        )

    iso = F.when(date_text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date_text, "yyyy-MM-dd"))
    return F.coalesce(
        found(iso, "document"),
        found(date_from_text(date_text, last_year), "raw"),
        found(date_from_file_name(file_name, last_year), "fichier"),
    )
