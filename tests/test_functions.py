"""Golden values of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthbook.functions.accounts import account_label, payment_category, resolve_account_kind
from hearthbook.functions.dates import add_months, is_iso_date, month_end, parse_date
from hearthbook.functions.money import cents_to_input, format_cents, parse_money
from hearthbook.functions.text import concat_description, normalize_merchant


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


MONEY = [
    ("1,234.56", 123456), ("$-42.17", -4217), ("(42.17)", -4217), (".5", 50), ("5.", 500),
    ("1.005", 101), ("0.995", 100), (".", None), ("--5", None), ("-(5)", None), ("5-", None),
    ("1.23456", None), ("42 CR", None), ("-0", 0), ("(-5)", -500), ("", None), ("   ", None),
    ("+7", 700), ("+-5", None), ("1 234.5", 123450), ("(+5)", -500), ("1e5", None), ("1.0049", 100),
    ("-1.005", -101), (None, None), ("\t$5\xa0", 500), ("()", None), ("12.3.4", None),
]


def test_parse_money(spark):
    got = values(spark, [(m,) for m, _ in MONEY], "raw string", parse_money(F.col("raw")))
    assert got == [c for _, c in MONEY]


DATES = [
    ("2024-02-29", "YYYY-MM-DD", "2024-02-29"), ("2023-02-30", "YYYY-MM-DD", None),
    ("2024/3/5 10:11", "YYYY-MM-DD", "2024-03-05"), ("2024-3-5", "YYYY/MM/DD", "2024-03-05"),
    ("03/05/2024", "MM/DD/YYYY", "2024-03-05"), ("3-5-24", "M/D/YYYY", "2024-03-05"),
    ("03/05/2024", "DD/MM/YYYY", "2024-05-03"), ("3/5/0099", "M/D/YYYY", "2099-03-05"),
    ("3/5/123", "M/D/YYYY", None), ("3/5/0123", "M/D/YYYY", None), ("13/01/2024", "MM/DD/YYYY", None),
    ("Mar 5, 2024", "MMM D, YYYY", "2024-03-05"), ("march. 15 2024 x", "MMM D, YYYY", "2024-03-15"),
    ("Foo 5, 2024", "MMM D, YYYY", None), ("Mar5,2024", "MMM D, YYYY", None), ("", "YYYY-MM-DD", None),
    ("05.03.2024", "DD/MM/YYYY", None), (" 12/31/1999 ", "MM/DD/YYYY", "1999-12-31"),
    ("0000-01-01", "YYYY-MM-DD", "2000-01-01"), ("12/31/20245", "MM/DD/YYYY", "2024-12-31"),
    ("1/0/2024", "M/D/YYYY", None),
]


def test_parse_date(spark):
    got = values(spark, [(r, f) for r, f, _ in DATES], "raw string, fmt string", parse_date(F.col("raw"), F.col("fmt")))
    assert got == [dt.date.fromisoformat(d) if d else None for _, _, d in DATES]


MERCHANTS = [
    ("KROGER #442 SPRINGFIELD", "KROGER"), ("COSTCO WHSE #1121", "COSTCO WHSE"),
    ("SHELL OIL 57442199", "SHELL OIL"), ("CHIPOTLE 2211", "CHIPOTLE"),
    ("TST* THE GREEN FORK", "THE GREEN FORK"), ("NETFLIX.COM", "NETFLIX"),
    ("SPOTIFY USA", "SPOTIFY USA"), ("AMZN MKTP US*Z128KJ3", "AMAZON"),
    ("AMAZON.COM*MM2456", "AMAZON"), ("CITY OF SPRINGFIELD UTIL", "CITY OF SPRINGFIELD UTIL"),
    ("SQ *CORNER COFFEE", "CORNER COFFEE"), ("TARGET 00021221", "TARGET"),
    ("DIRECT DEP EMPLOYER PAYROLL", "EMPLOYER PAYROLL"), ("WALGREENS #5521", "WALGREENS"),
    ("AMC THEATRES 4422", "AMC THEATRES"),
]


def test_normalize_merchant(spark):
    got = values(spark, [(d,) for d, _ in MERCHANTS], "d string", normalize_merchant(F.col("d")))
    assert got == [m for _, m in MERCHANTS]


def test_format(spark):
    rows = [(123456,), (-4217,), (5,), (0,), (-123456789,)]
    assert values(spark, rows, "c long", format_cents(F.col("c"))) == [
        "$1,234.56", "-$42.17", "$0.05", "$0.00", "-$1,234,567.89",
    ]
    assert values(spark, rows, "c long", cents_to_input(F.col("c"))) == [
        "1234.56", "-42.17", "0.05", "0.00", "-1234567.89",
    ]


def test_accounts(spark):
    rows = [("mortgage", "transaction"), ("mortgage", "nonsense"), ("checking", "balance"), ("line_of_credit", None)]
    schema = "t string, k string"
    assert values(spark, rows, schema, resolve_account_kind(F.col("t"), F.col("k"))) == [
        "transaction", "balance", "transaction", "transaction",
    ]
    assert values(spark, rows, schema, payment_category(F.col("t"))) == ["Loan Payment", "Loan Payment", None, "Loan Payment"]
    labels = [("Chase", "Checking", "1234"), ("", "Cash", None), ("Bank", "", "")]
    got = values(spark, labels, "i string, n string, f string", account_label(F.col("i"), F.col("n"), F.col("f")))
    assert got == ["Chase · Checking ··1234", "Cash", "Bank"]


def test_dates_and_text(spark):
    rows = [("2024-02-29",), ("2023-02-29",), ("2024-2-9",), (None,)]
    assert values(spark, rows, "s string", is_iso_date(F.col("s"))) == [True, False, False, False]
    assert values(spark, [("2024-02",)], "m string", month_end(F.col("m"))) == [dt.date(2024, 2, 29)]
    assert values(spark, [("2024-01",)], "m string", add_months(F.col("m"), -1)) == ["2023-12"]
    got = values(spark, [(" a\xa0 b ", None), ("", " ")], "x string, y string", concat_description([F.col("x"), F.col("y")]))
    assert got == ["a b", None]


@pytest.mark.parametrize("cents", [0, 1, -1, 99, -100, 123456789])
def test_money_round_trip(spark, cents):
    assert values(spark, [(cents,)], "c long", parse_money(cents_to_input(F.col("c")))) == [cents]
