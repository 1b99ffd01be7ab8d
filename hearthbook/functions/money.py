"""Money is integer cents throughout; nothing here goes through a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, trim_blanks


def to_cents(value: Column) -> Column:
    """A two-decimal number (even one stored as double) to exact cents."""
    return (value.cast("decimal(18,2)") * 100).cast("long")


def parse_money(raw: Column) -> Column:
    """Printed amount to cents, null when it is not one. Parentheses or one
    leading minus mean negative; at most four decimals, rounded half up on the
    third.

    A chain of rewrites, each used once: brackets become a marker, signs and
    grouping go, and only a plain decimal is left to cast exactly."""
    marked = F.regexp_replace(trim_blanks(raw), r"\A\((.*)\)\z", "\u0001$1")
    plain = F.regexp_replace(marked, rf"[$,]|{BLANKS}", "")
    signed = F.regexp_replace(plain, r"\A\u0001[-+]?", "-")
    number = F.regexp_extract(signed, r"\A(?:\+(?!-))?(-?(?:[0-9]+(?:\.[0-9]{0,4})?|\.[0-9]{1,4}))\z", 1)
    return (F.round(number.try_cast("decimal(36,4)"), 2) * 100).try_cast("long")


def _dollars(cents: Column) -> Column:
    size = F.abs(cents)
    return F.concat(
        F.format_number(F.floor(size / F.lit(100).cast("decimal(3,0)")), 0),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def format_cents(cents: Column) -> Column:
    return F.concat(F.when(cents < 0, F.lit("-$")).otherwise(F.lit("$")), _dollars(cents))


def format_cents_abs(cents: Column) -> Column:
    return F.concat(F.lit("$"), _dollars(cents))


def cents_to_input(cents: Column) -> Column:
    return F.regexp_replace(
        F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), _dollars(cents)), ",", ""
    )
