"""Checking bank statements off against the books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STATEMENT_MATCH_WINDOW_DAYS
from ..functions.accounts import is_liability
from ..functions.dates import day_number
from .assign import nearest_first, one_to_one

KEYS = ["account_id", "amount_cents"]


def statement_match(
    lines: DataFrame, transactions: DataFrame, window: int = STATEMENT_MATCH_WINDOW_DAYS
) -> DataFrame:
    """Statement lines and the register rows that satisfy them, one to one."""
    day = day_number(F.col("date")).alias("day")
    left = lines.select(*KEYS, day, F.col("id").alias("left_id"))
    right = transactions.select(*KEYS, day, F.col("id").alias("right_id"))
    return one_to_one(left, right, KEYS, nearest_first(window)).select(
        F.col("left_id").alias("line_id"), F.col("right_id").alias("matched_id"), F.col("days")
    )


def matched_lines(lines: DataFrame, transactions: DataFrame, matches: DataFrame) -> DataFrame:
    """Every line with the register row it was checked off against, if any."""
    rows = transactions.select(
        F.col("id").alias("matched_id"),
        F.col("date").alias("matched_date"),
        F.col("description").alias("matched_description"),
    )
    found = matches.select(F.col("line_id").alias("id"), "matched_id").join(rows, "matched_id")
    return lines.join(found, "id", "left")


def sign_conflicts(
    checked: DataFrame, transactions: DataFrame, window: int = STATEMENT_MATCH_WINDOW_DAYS
) -> DataFrame:
    """Add ``sign_conflict``: an unmatched line whose exact opposite is in the books
    nearby. Adding such a line would count it twice. Existence only, so both
    sides are reduced to days first."""
    day = day_number(F.col("date"))
    asked = checked.where("matched_id is null").select(
        "account_id", "amount_cents", day.alias("day"), F.lit(0).alias("there")
    ).distinct()
    opposite = transactions.groupBy(
        "account_id", (-F.col("amount_cents")).alias("amount_cents"), day.alias("day")
    ).agg(F.lit(1).alias("there"))
    near = Window.partitionBy(*KEYS).orderBy("day").rangeBetween(-window, window)
    # max, because a day may be both asked for and there
    days = (
        asked.unionByName(opposite)
        .withColumn("near", F.max("there").over(near))
        .where("there = 0 and near = 1")
        .select(*KEYS, "day", F.lit(True).alias("hit"))
    )
    return (
        checked.withColumn("day", day)
        .join(days, [*KEYS, "day"], "left")
        .withColumn("sign_conflict", F.col("matched_id").isNull() & F.coalesce("hit", F.lit(False)))
        .drop("day", "hit")
    )


def statement_close(lines: DataFrame, balances: DataFrame) -> DataFrame:
    """Per file: lines found, missing, turned round, and balances new or replacing.
    ``lines`` carry matched_id and sign_conflict, ``balances`` their effect."""
    missing = F.col("matched_id").isNull() & ~F.col("sign_conflict")
    per_file = lines.groupBy("batch_id").agg(
        F.count_if(F.col("matched_id").isNotNull()).alias("matched"),
        F.count_if(missing).alias("missing"),
        F.count_if("sign_conflict").alias("conflicts"),
        F.coalesce(F.sum(F.when(missing, F.col("amount_cents"))), F.lit(0).cast("long")).alias(
            "missing_cents"
        ),
    )
    recorded = balances.groupBy("batch_id").agg(
        F.count("*").alias("balances"), F.count_if(F.col("effect") == "replaces").alias("replaces")
    )
    zero = F.lit(0).cast("long")
    return per_file.join(recorded, "batch_id", "full").select(
        "batch_id",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("matched", "missing", "conflicts", "missing_cents", "balances", "replaces")
        ],
    )


def close_totals(closes: DataFrame) -> DataFrame:
    return closes.agg(
        F.sum("missing").alias("adding"),
        F.sum("balances").alias("balances"),
        F.sum("missing_cents").alias("missing_cents"),
    )


def statement_tie_out(files: DataFrame, lines: DataFrame, balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Do a statement's lines add up to the move between its printed balances, and
    are a debt's balances all negative? If not, or if a balance is not printed, it is
    blocked, with the first reason. ``files`` (batch_id, account_id): every file has a
    row, with null figures where it prints no balance."""
    sums = lines.groupBy("batch_id").agg(
        F.count("*").alias("rows"), F.sum("amount_cents").alias("net_cents")
    )
    printed = balances.groupBy("batch_id").agg(
        F.max(F.when(F.col("kind") == "opening", F.col("balance_cents"))).alias("opening_cents"),
        F.max(F.when(F.col("kind") == "closing", F.col("balance_cents"))).alias("closing_cents"),
        F.max("balance_cents").alias("highest"),
    )
    types = accounts.select(
        F.col("id").alias("account_id"), is_liability(F.col("account_type")).alias("is_debt")
    )
    off = F.coalesce("net_cents", F.lit(0).cast("long")) - (F.col("closing_cents") - F.col("opening_cents"))
    signs_ok = ~F.coalesce("is_debt", F.lit(False)) | F.coalesce(F.col("highest") < 0, F.lit(True))
    reason = (
        F.when(off.isNull(), F.lit("a balance is missing"))
        .when(off != 0, F.lit("lines and balances differ"))
        .when(~signs_ok, F.lit("a debt shows a credit"))
    )
    return (
        files.select("batch_id", "account_id")
        .join(printed, "batch_id", "left")
        .join(sums, "batch_id", "left")
        .join(types, "account_id", "left")
        .select(
            "batch_id",
            "account_id",
            F.coalesce("rows", F.lit(0).cast("long")).alias("rows"),
            off.alias("off_by_cents"),
            signs_ok.alias("signs_ok"),
            reason.isNotNull().alias("blocked"),
            reason.alias("reason"),
        )
    )


def statement_hold_check(
    tie_out: DataFrame, balances: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """Files to hold back: blocked ones, and those whose closing balance
    contradicts one already on file."""
    closing = balances.where("kind = 'closing'").select(
        "batch_id", F.col("account_id").alias("acct"), F.col("date").alias("close_date"), "balance_cents"
    )
    held = snapshots.select(
        F.col("account_id").alias("acct"), F.col("date").alias("close_date"), F.col("balance_cents").alias("on_file")
    )
    clash = (
        closing.join(held, ["acct", "close_date"])
        .where("balance_cents != on_file")
        .select("batch_id", "on_file", F.col("balance_cents").alias("printed"))
    )
    return (
        tie_out.drop("reason")
        .join(clash, "batch_id", "left")
        .select(
            "batch_id",
            "account_id",
            F.when(F.col("blocked"), F.lit("does not tie out"))
            .when(F.col("on_file").isNotNull(), F.lit("contradicts balance on file"))
            .alias("reason"),
            F.when(~F.col("blocked"), F.col("printed") - F.col("on_file")).alias("differs_by"),
        )
        .where("reason is not null")
    )


def close_history(batches: DataFrame, sessions: DataFrame, accounts: DataFrame, balances: DataFrame) -> DataFrame:
    """Past closes, one row per session and account label (a session's labels are
    rows rather than a list, however many files it had)."""
    closes = sessions.where("purpose = 'reconcile'").select(
        F.col("id").alias("session_id"), F.col("status").alias("session_status")
    )
    labels = accounts.select(F.col("id").alias("account_id"), "label")
    recorded = balances.groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("balances"))
    return (
        batches.join(closes, "session_id")
        .join(labels, "account_id")
        .join(recorded, "id", "left")
        .groupBy("session_id", "session_status", "label")
        .agg(
            F.min("period_start").alias("period_start"),
            F.max("period_end").alias("period_end"),
            F.count("*").alias("statements"),
            F.coalesce(F.sum("balances"), F.lit(0).cast("long")).alias("balances"),
            F.sum("row_count").alias("row_count"),
        )
    )


def close_sessions(sessions: DataFrame, batches: DataFrame, balances: DataFrame, ledger: DataFrame) -> DataFrame:
    """Past closes, one row per session, those without files included: files, rows,
    balances, and how many rows of its files are in the ledger (import_batch_id)."""
    files = batches.where(F.col("session_id").isNotNull()).select(
        "session_id", F.col("id").alias("batch_id"), "period_start", "period_end", "row_count"
    )
    recorded = balances.groupBy("batch_id").agg(F.count("*").alias("balances"))
    added = ledger.groupBy(F.col("import_batch_id").alias("batch_id")).agg(F.count("*").alias("inserted"))
    per_session = (
        files.join(recorded, "batch_id", "left")
        .join(added, "batch_id", "left")
        .groupBy("session_id")
        .agg(
            F.min("period_start").alias("period_start"),
            F.max("period_end").alias("period_end"),
            F.count("*").alias("statements"),
            *[F.sum(c).alias(c) for c in ("balances", "row_count", "inserted")],
        )
    )
    counts = ["statements", "balances", "row_count", "inserted"]
    return (
        sessions.where("purpose = 'reconcile'")
        .select(F.col("id").alias("session_id"), F.col("status").alias("session_status"))
        .join(per_session, "session_id", "left")
        .select(
            "session_id", "session_status", "period_start", "period_end",
            *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        )
    )


def statement_lines_of(extracted: DataFrame) -> DataFrame:
    """Lines of extracted statements (nested, one row per statement)."""
    return extracted.select("statement_id", F.posexplode("transactions").alias("row_index", "t")).select(
        "statement_id", "row_index", "t.*"
    )


def statement_balances_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("statement_id", F.explode("balances").alias("b")).select("statement_id", "b.*")
