"""Date parsing and calendar arithmetic. Dates are DateType inside the library;
months are 'yyyy-MM' strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MONTH_ABBREVIATIONS
from .text import BLANKS, trim_blanks

_REST = r"(?s:.*)\z"
_YEAR_FIRST = rf"\A([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}}){_REST}"
_YEAR_LAST = rf"\A([0-9]{{1,2}})[-/]([0-9]{{1,2}})[-/]([0-9]{{2,4}}){_REST}"
_WORDED = (
    rf"\A([A-Za-z]{{3}})[A-Za-z]*\.?{BLANKS}+([0-9]{{1,2}}),?{BLANKS}+([0-9]{{4}}){_REST}"
)


def parse_date(raw: Column, date_format: Column | str) -> Column:
    """Read the date at the start of ``raw``; trailing text such as a time is
    ignored. ``date_format`` may be a column, so files with different formats go
    through one projection.

    Each step rewrites the text of the one before and uses it once, so that the
    expression stays a chain: year-month-day, then a full year, then two-digit
    month and day, and only a true calendar date survives the cast."""
    fmt = F.lit(date_format) if isinstance(date_format, str) else date_format
    text = trim_blanks(raw)
    worded = F.regexp_replace(text, _WORDED, "$3-$1-0$2")
    names = F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS])
    month = F.array_position(names, F.upper(F.substring(worded, 6, 3)))
    ordered = (
        F.when(fmt.isin("YYYY-MM-DD", "YYYY/MM/DD"), F.regexp_replace(text, _YEAR_FIRST, "$1-0$2-0$3"))
        .when(fmt.isin("MM/DD/YYYY", "M/D/YYYY"), F.regexp_replace(text, _YEAR_LAST, "$3-0$1-0$2"))
        .when(fmt == "DD/MM/YYYY", F.regexp_replace(text, _YEAR_LAST, "$3-0$2-0$1"))
        .when(
            fmt == "MMM D, YYYY",
            F.concat(
                F.substring(worded, 1, 5), F.lpad(month.cast("string"), 2, "0"), F.substring(worded, 9, 4)
            ),
        )
    )
    full_year = F.regexp_replace(ordered, r"\A0*([0-9]{2})-", "20$1-")
    padded = F.regexp_replace(full_year, r"-0([0-9]{2})(?![0-9])", "-$1")
    iso = F.regexp_extract(padded, r"\A([1-9][0-9]{3}-[0-9]{2}-[0-9]{2})\z", 1)
    return iso.try_cast("date")


def is_iso_date(text: Column) -> Column:
    shaped = F.coalesce(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.lit(False))
    return shaped & text.try_cast("date").isNotNull()


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_start(month: Column) -> Column:
    return F.concat(month, F.lit("-01")).cast("date")


def month_end(month: Column) -> Column:
    return F.last_day(month_start(month))


def add_months(month: Column, delta: Column | int) -> Column:
    return month_of(F.add_months(month_start(month), delta))


def days_between(start: Column, end: Column) -> Column:
    return F.date_diff(end, start)


def day_number(date: Column) -> Column:
    """Days since the epoch, so that windows can range over whole days."""
    return F.unix_date(date)
