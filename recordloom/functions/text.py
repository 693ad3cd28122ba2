"""Scalar column functions (all JVM-side built-ins, so they stay in codegen).

Each helper takes and returns ``Column`` objects; strings are column names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import OUTPUT_DATE_FORMAT, SHEET_DATE_FORMATS

# Unicode-aware trim: Spark's trim() removes only blanks.
_STRIP_RE = r"(?U)^\s+|\s+$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upper(x: str | Column) -> Column:
    """SF-01: upper-case; NULL stays NULL."""
    return F.upper(_c(x))


def empty_if_null(x: str | Column) -> Column:
    """SF-03: NULL -> ''."""
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def concat_null_empty(*parts: str | Column, sep: str | None = None) -> Column:
    """SF-02: concatenation where NULL counts as '' and separators always stay.

    ``concat`` returns NULL on any NULL input and ``concat_ws`` drops the
    separator next to a NULL; both differ from the registry's semantics.
    Plain Python strings in ``parts`` are literals only when ``sep`` is None
    and they are wrapped with ``F.lit`` by the caller.
    """
    cols = [empty_if_null(p) for p in parts]
    if sep is not None:
        out: list[Column] = []
        for i, c in enumerate(cols):
            if i:
                out.append(F.lit(sep))
            out.append(c)
        cols = out
    return F.concat(*cols)


def strip(x: str | Column) -> Column:
    """SF-04: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(x).cast("string"), _STRIP_RE, "")


def format_date(x: str | Column) -> Column:
    """SF-05: date -> dd/mm/yyyy text."""
    return F.date_format(_c(x), OUTPUT_DATE_FORMAT)


def parse_date(x: str | Column, formats: Iterable[str] = SHEET_DATE_FORMATS) -> Column:
    """Text in any of ``formats`` -> date; anything else -> NULL (never raises)."""
    s = _c(x).cast("string")
    return F.coalesce(*[F.try_to_date(s, f) for f in formats])


def parse_format_date(x: str | Column, dtype: str = "string",
                      formats: Iterable[str] = SHEET_DATE_FORMATS) -> Column:
    """SF-06: date or text -> dd/mm/yyyy; unparsable -> NULL.

    ``dtype`` is the Spark type name of the input column: dates and timestamps
    are formatted directly, text goes through :func:`parse_date`.
    """
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return format_date(_c(x))
    return format_date(parse_date(x, formats))


def date_and_text(d: str | Column, text: str | Column) -> Column:
    """SF-07 / SF-08: formatted date (or the text itself) + ', ' + text."""
    return concat_null_empty(format_date(d), F.lit(", "), text)


def text_and_date(text: str | Column, d: str | Column) -> Column:
    """SF-08: key text + ', ' + formatted date."""
    return concat_null_empty(text, F.lit(", "), format_date(d))


def serial_with_year(serial: str | Column, year: int | Column) -> Column:
    """SF-09: ``serial/year``."""
    y = year if isinstance(year, Column) else F.lit(int(year))
    return F.concat(_c(serial).cast("string"), F.lit("/"), y.cast("string"))


def serial_prefix(x: str | Column) -> Column:
    """SF-10: text before the first '/'."""
    return F.split_part(_c(x).cast("string"), F.lit("/"), F.lit(1))


def serial_to_int(x: str | Column) -> Column:
    """SF-11: text before the first '/' as an integer (NULL when not a number)."""
    return serial_prefix(x).try_cast("bigint")


def first_digits(x: str | Column) -> Column:
    """SF-12: first run of digits as an integer, 0 when there is none."""
    run = F.regexp_extract(_c(x).cast("string"), r"(\d+)", 1)
    return F.coalesce(F.nullif(run, F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def first_piece(x: str | Column, sep: str = ",") -> Column:
    """SF-13 (name): first ``sep``-separated piece, stripped."""
    return strip(F.split_part(_c(x), F.lit(sep), F.lit(1)))


def last_piece(x: str | Column, sep: str = ",") -> Column:
    """SF-13 (designation): last ``sep``-separated piece, stripped."""
    return strip(F.split_part(_c(x), F.lit(sep), F.lit(-1)))


def to_text(x: str | Column) -> Column:
    """SF-14: any value -> text."""
    return _c(x).cast("string")


def is_missing(x: str | Column) -> Column:
    """SF-15: NULL or whitespace-only (:func:`strip` leaves nothing), decided at the first other character."""
    c = _c(x)
    return c.isNull() | ~c.cast("string").rlike(r"(?U)\S")


def join_names(flags: Iterable[tuple[str, Column]], sep: str = ", ") -> Column:
    """SF-16: names whose flag is true, joined in the given order ('' when none)."""
    return F.concat_ws(sep, *[F.when(flag, F.lit(name)) for name, flag in flags])


def run_date(d) -> Column:
    """SF-17: the run date as a literal. Always a parameter, never
    ``current_date()``, so a rerun computes the same result."""
    return F.lit(d).cast("date")


def status_norm_table(status: str | Column) -> Column:
    """Upper-cased status with NULL as '' (table mode: not trimmed)."""
    return F.upper(F.coalesce(_c(status), F.lit("")))


def status_norm_sheet(status: str | Column) -> Column:
    """Upper-cased, stripped status with NULL as '' (sheet mode)."""
    return F.upper(strip(F.coalesce(_c(status).cast("string"), F.lit(""))))


def no_page_break(x: str | Column) -> Column:
    """Remove form feeds so a field value cannot fake a page break."""
    return F.translate(_c(x), "\f", "")
