"""From uploaded records to ledger rows.

Records are string maps keyed by header, so files with different headers go
through the same projection; each carries its file's mapping as columns
(date_column, date_format, description_columns, amount_style, amount_column,
debit_column, credit_column, balance_column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import parse_money
from ..functions.text import collapse_blanks, trim_blanks

MAPPING_COLUMNS = [
    "date_column",
    "date_format",
    "description_columns",
    "amount_style",
    "amount_column",
    "debit_column",
    "credit_column",
    "balance_column",
]


def header_signature(headers: Sequence[str]) -> str:
    return "|".join(h.lower() for h in headers)


def header_signature_of(headers: Column) -> Column:
    return F.array_join(F.transform(headers, lambda h: F.lower(h)), "|")


def saved_mapping_lookup(files: DataFrame, mappings: DataFrame) -> DataFrame:
    """The mapping saved for a file's account and header signature, if any."""
    return files.join(mappings, ["account_id", "signature"], "left")


def save_mapping(mappings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert: a newly confirmed mapping replaces the one of the same key."""
    return mappings.join(fresh, ["account_id", "signature"], "left_anti").unionByName(fresh)


def _cell(column: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("record"), column), F.lit(""))


def map_amount(style: Column, amount: Column, debit: Column, credit: Column) -> Column:
    """Signed cents by the file's habit; null when nothing readable is there."""
    two_columns = (
        F.when(debit != 0, -F.abs(debit))
        .when(credit != 0, F.abs(credit))
        .when((debit == 0) | (credit == 0), F.lit(0).cast("long"))
    )
    return (
        F.when(style == "debit_credit", two_columns)
        .when(style == "single_inverted", -amount)
        .otherwise(amount)
    )


def map_records(
    records: DataFrame, kind: str = "transactions", carry: Sequence[str] = ()
) -> DataFrame:
    """One projection over (file_id, row_index, record, mapping columns): values,
    and ``problem`` where a row cannot be read. Rows to be dropped silently are
    marked by ``outcome``: row, balance, error, blank or empty. ``carry`` names
    further columns to pass through."""
    raw_date = _cell(F.col("date_column"))
    date = parse_date(raw_date, F.col("date_format"))
    filled = F.exists(F.map_values("record"), lambda v: trim_blanks(F.coalesce(v, F.lit(""))) != "")
    text = collapse_blanks(
        F.array_join(
            F.transform(
                F.col("description_columns"),
                lambda c: F.coalesce(F.try_element_at(F.col("record"), c), F.lit("")),
            ),
            " ",
        )
    )
    # Each cell is parsed once: a filter on the outcome would be pushed below a
    # plain projection and parse again, but it stays above a generator.
    parsed = F.struct(
        raw_date.alias("raw_date"),
        date.alias("date"),
        filled.alias("filled"),
        text.alias("text"),
        parse_money(_cell(F.col("amount_column"))).alias("amount"),
        parse_money(_cell(F.col("debit_column"))).alias("debit"),
        parse_money(_cell(F.col("credit_column"))).alias("credit"),
        _cell(F.col("balance_column")).alias("raw_balance"),
        parse_money(_cell(F.col("balance_column"))).alias("balance_cents"),
    )
    cells = records.select(
        *carry, "file_id", "row_index", "amount_style", F.inline(F.array(parsed))
    )
    bad_date = F.concat(F.lit('Unparseable date "'), "raw_date", F.lit('"'))
    if kind == "balances":
        problem = F.when(F.col("date").isNull(), F.when(F.col("filled"), bad_date)).when(
            F.col("balance_cents").isNull(),
            F.concat(F.lit('Unparseable balance "'), "raw_balance", F.lit('"')),
        )
        good = F.lit("balance")
        read = cells.withColumns(
            {"amount_cents": F.lit(None).cast("long"), "description": F.lit(None).cast("string")}
        )
    else:
        amount = map_amount(F.col("amount_style"), F.col("amount"), F.col("debit"), F.col("credit"))
        named = F.when(F.col("text") != "", F.col("text")).otherwise(F.lit("(no description)"))
        read = cells.withColumns({"amount_cents": amount, "description": named})
        problem = F.when(F.col("date").isNull(), F.when(F.col("filled"), bad_date)).when(
            F.col("amount_cents").isNull(), F.lit("Unparseable amount")
        )
        good = F.when((F.col("text") == "") & (F.col("amount_cents") == 0), F.lit("empty")).otherwise(
            F.lit("row")
        )
    outcome = (
        F.when(F.col("problem").isNotNull(), F.lit("error"))
        .when(F.col("date").isNull(), F.lit("blank"))
        .otherwise(good)
    )
    return (
        read.withColumn("problem", problem)
        .withColumn("outcome", outcome)
        .select(
            *carry,
            "file_id",
            "row_index",
            "date",
            "description",
            "amount_cents",
            "balance_cents",
            "problem",
            "outcome",
        )
    )


def mapped_rows(mapped: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return mapped.where("outcome = 'row'").select(
        *carry, "file_id", "row_index", "date", "description", "amount_cents"
    )


def row_errors(mapped: DataFrame) -> DataFrame:
    return mapped.where("outcome = 'error'").select("file_id", "row_index", "problem")


def running_balance_anchor(mapped: DataFrame) -> DataFrame:
    """A day's closing balance from a running-balance column: the chronologically
    last row of the day, which is the highest row of a file that runs forward in
    time and the lowest of one that runs backward. All partial aggregates."""
    rows = mapped.where("outcome = 'row' and balance_cents is not null")
    days = rows.groupBy("file_id", "date").agg(
        F.max("row_index").alias("last_row"),
        F.max_by("balance_cents", "row_index").alias("last_cents"),
        F.min("row_index").alias("first_row"),
        F.min_by("balance_cents", "row_index").alias("first_cents"),
    )
    files = days.groupBy("file_id").agg(
        (F.min_by("date", "first_row") <= F.max_by("date", "last_row")).alias("ascending")
    )
    up = F.col("ascending")
    return days.join(files, "file_id").select(
        "file_id",
        F.when(up, F.col("last_row")).otherwise(F.col("first_row")).alias("row_index"),
        "date",
        F.when(up, F.col("last_cents")).otherwise(F.col("first_cents")).alias("balance_cents"),
    )


# needles in order of preference; fixed values
DATE_NEEDLES = ["post date", "posted", "transaction date", "date"]
DEBIT_NEEDLES = ["debit", "withdrawal"]
CREDIT_NEEDLES = ["credit", "deposit"]
AMOUNT_NEEDLES = ["amount"]
DESCRIPTION_NEEDLES = ["description", "payee", "merchant", "memo", "name"]
BALANCE_NEEDLES = ["balance", "value"]


def _first_header(headers: Column, needles: Sequence[str]) -> Column:
    """The first header containing the most preferred needle that occurs."""

    def containing(needle: str) -> Column:
        hits = F.filter(headers, lambda h: F.contains(F.lower(h), F.lit(needle)))
        return F.try_element_at(hits, F.lit(1))

    return F.coalesce(*[containing(n) for n in needles])


def guessed_date_column(headers: Column) -> Column:
    return F.coalesce(_first_header(headers, DATE_NEEDLES), F.try_element_at(headers, F.lit(1)))


def heuristic_mappings(files: DataFrame, kind: str = "transactions") -> DataFrame:
    """Guess a mapping per file from its ``headers`` array and ``sample`` (the
    first non-blank value of each header, as a map)."""
    headers = F.col("headers")
    date_column = guessed_date_column(headers)
    sample = F.coalesce(F.try_element_at(F.col("sample"), date_column), F.lit(""))
    debit, credit = _first_header(headers, DEBIT_NEEDLES), _first_header(headers, CREDIT_NEEDLES)
    amount = _first_header(headers, AMOUNT_NEEDLES)
    description = _first_header(headers, DESCRIPTION_NEEDLES)
    style = F.when(
        debit.isNotNull() & credit.isNotNull() & amount.isNull(), F.lit("debit_credit")
    ).otherwise(F.lit("single_signed"))
    return files.select(
        *[c for c in files.columns if c not in ("headers", "sample")],
        date_column.alias("date_column"),
        F.when(sample.rlike(r"\A[0-9]{4}-"), F.lit("YYYY-MM-DD"))
        .when(sample.rlike(r"\A[0-9]{4}/"), F.lit("YYYY/MM/DD"))
        .when(sample.rlike(r"\A[A-Za-z]"), F.lit("MMM D, YYYY"))
        .otherwise(F.lit("MM/DD/YYYY"))
        .alias("date_format"),
        F.when(description.isNotNull(), F.array(description))
        .otherwise(F.array().cast("array<string>"))
        .alias("description_columns"),
        (F.lit(None).cast("string") if kind == "balances" else style).alias("amount_style"),
        amount.alias("amount_column"),
        debit.alias("debit_column"),
        credit.alias("credit_column"),
        _first_header(headers, BALANCE_NEEDLES).alias("balance_column"),
    )


def first_samples(records: DataFrame, files: DataFrame) -> DataFrame:
    """Per file the first non-blank value of its date column, which its headers
    decide, as a map: the sample a guess is made from. One cell per row is read."""
    dates = files.select("file_id", guessed_date_column(F.col("headers")).alias("header"))
    cells = records.join(dates, "file_id").select(
        "file_id", "row_index", "header", F.try_element_at("record", F.col("header")).alias("value")
    )
    firsts = (
        cells.where(trim_blanks(F.coalesce("value", F.lit(""))) != "")
        .groupBy("file_id", "header")
        .agg(F.min_by("value", "row_index").alias("value"))
    )
    return firsts.select("file_id", F.create_map("header", "value").alias("sample"))


