"""Date parsing and day arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column, fmt: str, century_pivot: int = 70) -> Column:
    """Text to date with a stated format; text that does not fit gives NULL.

    Spark reads a two-digit year as 2000-2099. With a ``yy`` format, years from
    ``century_pivot`` to 99 are moved back to the 1900s.
    """
    parsed = F.try_to_date(text, fmt)
    if "yyyy" in fmt or "yy" not in fmt:
        return parsed
    return F.when(F.year(parsed) % 100 >= century_pivot, F.add_months(parsed, -1200)).otherwise(parsed)


def parse_date_or_fail(text: Column, fmt: str, century_pivot: int = 70) -> Column:
    """Like :func:`parse_date`, but text that does not fit stops the query; NULL and blank text give NULL."""
    parsed = parse_date(text, fmt, century_pivot)
    wrong = (F.trim(text) != "") & parsed.isNull()
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"no date in the format {fmt}: "), text))).otherwise(parsed)


def parse_date_month_first(text: Column, month_first: str, day_first: str) -> Column:
    """Read ambiguous text month-first and fall back to day-first.

    This repeats what format guessing does to day-first text, value by value; it
    exists to reproduce such data, not to be the default.
    """
    return F.coalesce(parse_date(text, month_first), parse_date(text, day_first))


def signed_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def duration_days(start: Column, end: Column) -> Column:
    """Whole days between two dates, without sign."""
    return F.abs(F.datediff(end, start))


def ends_before_start(start: Column, end: Column) -> Column:
    """True where a window runs backwards."""
    return F.datediff(end, start) < 0


def date_parts(name: str) -> dict[str, Column]:
    stem = name.removesuffix("_date")
    return {f"{stem}_year": F.year(name), f"{stem}_month": F.month(name)}
