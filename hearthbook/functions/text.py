"""Text clean-up, merchant names and the dedupe hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as browsers understand it: ASCII blanks, NBSP, the Unicode space
# separators, line and paragraph separator, and the byte order mark.
_BLANK = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BLANKS = f"[{_BLANK}]"


def trim_blanks(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A{BLANKS}+|{BLANKS}+\z", "")


def collapse_blanks(value: Column) -> Column:
    # once collapsed, only plain spaces are left to trim
    return F.trim(F.regexp_replace(value, f"{BLANKS}+", " "))


def concat_description(parts: Sequence[Column]) -> Column:
    """Join columns by one space; null when nothing but blanks remains."""
    text = collapse_blanks(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.when(text != "", text)


def normalize_merchant(description: Column) -> Column:
    """Statement text to merchant key: drop processor prefixes, store numbers,
    trailing digit runs and web suffixes."""
    text = F.upper(collapse_blanks(description))
    text = F.regexp_replace(text, r"\A(SQ \*|TST\*|DIRECT DEP )\s*", "")
    text = F.regexp_replace(text, r"\A(AMZN|AMAZON)\b.*\z", "AMAZON")
    bare = F.regexp_replace(text, r"\.COM\b.*\z", "")
    bare = F.regexp_replace(bare, r"\s*#\s*\d+.*\z", "")
    bare = F.regexp_replace(bare, r"(\s+\d{3,})+\z", "")
    return F.coalesce(F.nullif(bare, F.lit("")), text)


def dedupe_hash(date: Column, amount: Column, description: Column, occurrence: Column) -> Column:
    """Hash of a row within its account; the occurrence keeps genuine walls of
    identical lines apart while a re-import of the same file still collides."""
    return F.sha2(
        F.concat_ws(
            "|",
            date.cast("string"),
            amount.cast("string"),
            F.upper(collapse_blanks(description)),
            occurrence.cast("string"),
        ),
        256,
    )


def reads_like_movement(description: Column) -> Column:
    """Does the wording say that money moves rather than is spent?"""
    return F.upper(description).rlike(
        r"\b(TRANSFER|XFER|PAYMENT|PMT|PYMT|CONTRIBUTION|DEPOSIT|AUTOPAY|ACH)\b"
    )


def reads_like_payment(description: Column) -> Column:
    return F.upper(description).rlike(r"\b(PAYMENT|PMT|PYMT|AUTOPAY|THANK YOU|TRANSFER)\b")
