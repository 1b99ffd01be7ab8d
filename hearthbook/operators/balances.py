"""Balances, reconciliation windows and cleared state.

Activity is first summed per account and day. From there on an account is at
most one row per calendar day, so windows over an account stay small even when
one account holds a third of all transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SNAPSHOTS_SHOWN
from ..functions.accounts import is_liability

UPTO = (Window.unboundedPreceding, Window.currentRow)


def zero():
    return F.lit(0).cast("long")


def daily_activity(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("account_id", "date").agg(
        F.count("*").alias("n"), F.sum("amount_cents").alias("cents")
    )


def daily_contributions(transactions: DataFrame) -> DataFrame:
    """Money paid into balance-only accounts by rows that name them."""
    return (
        transactions.where(F.col("transfer_account_id").isNotNull())
        .groupBy(F.col("transfer_account_id").alias("account_id"), "date")
        .agg(F.count("*").alias("n"), F.sum(-F.col("amount_cents")).alias("cents"))
    )


def latest_anchor(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("account_id").agg(
        F.max("date").alias("anchor_date"),
        F.max_by("balance_cents", "date").alias("anchor_cents"),
    )


def account_balances(accounts: DataFrame, snapshots: DataFrame, transactions: DataFrame) -> DataFrame:
    """Anchor plus the activity strictly after it. Without an anchor a ledger
    account shows its bare activity and is flagged; a balance account shows none."""
    anchors = latest_anchor(snapshots)
    after = F.col("anchor_date").isNull() | (F.col("date") > F.col("anchor_date"))
    since = (
        daily_activity(transactions)
        .join(anchors, "account_id", "left")
        .where(after)
        .groupBy("account_id")
        .agg(
            F.sum("cents").alias("since_cents"),
            F.sum("n").alias("since_count"),
            F.max("date").alias("last_date"),
        )
    )
    joined = (
        accounts.select(F.col("id").alias("account_id"), "name", "kind", "account_type", "is_active")
        .join(anchors, "account_id", "left")
        .join(since, "account_id", "left")
    )
    moved = F.coalesce("since_cents", zero())
    ledger = F.col("kind") == "transaction"
    return joined.select(
        "account_id",
        "name",
        "kind",
        is_liability(F.col("account_type")).alias("is_liability"),
        "is_active",
        "anchor_date",
        "anchor_cents",
        F.when(ledger, moved).otherwise(zero()).alias("activity_cents"),
        F.when(ledger, F.coalesce("since_count", zero())).otherwise(zero()).alias("activity_count"),
        F.when(ledger, F.coalesce("anchor_cents", zero()) + moved)
        .otherwise(F.col("anchor_cents"))
        .alias("current_cents"),
        F.greatest("anchor_date", F.when(ledger, F.col("last_date"))).alias("as_of"),
        F.col("anchor_date").isNull().alias("unanchored"),
    )


def net_worth(balances: DataFrame) -> DataFrame:
    known = F.when(F.col("unanchored"), zero()).otherwise(F.coalesce("current_cents", zero()))
    return balances.where("is_active").agg(
        F.coalesce(F.sum(known), zero()).alias("net_worth_cents"),
        F.count_if("unanchored").alias("unanchored_count"),
    )


def snapshot_history(snapshots: DataFrame, shown: int = SNAPSHOTS_SHOWN) -> DataFrame:
    newest = Window.partitionBy("account_id").orderBy(F.col("date").desc())
    return (
        snapshots.withColumn("place", F.row_number().over(newest).cast("long"))
        .where(F.col("place") <= shown)
        .select("account_id", "place", "date", "balance_cents", "source")
    )


def balance_trends(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Points of the trend lines of active accounts, in long form."""
    live = accounts.where("is_active").select(F.col("id").alias("account_id"), "name")
    return snapshots.join(live, "account_id").select("account_id", "name", "date", "balance_cents")


def _timeline(snapshots: DataFrame, activity: DataFrame) -> DataFrame:
    """One row per account and day with an anchor or activity, running totals and,
    on anchor days, the period that ends there."""
    days = (
        activity.select("account_id", "date", "n", "cents", F.lit(None).cast("long").alias("anchor"))
        .unionByName(
            snapshots.select(
                "account_id",
                "date",
                zero().alias("n"),
                zero().alias("cents"),
                F.col("balance_cents").alias("anchor"),
            )
        )
        .groupBy("account_id", "date")
        .agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("anchor").alias("anchor"))
    )
    by_date = Window.partitionBy("account_id").orderBy("date")
    before = by_date.rowsBetween(Window.unboundedPreceding, -1)
    totals = days.select(
        "*",
        F.sum("n").over(by_date.rowsBetween(*UPTO)).alias("n_upto"),
        F.sum("cents").over(by_date.rowsBetween(*UPTO)).alias("cents_upto"),
    ).withColumn(
        "mark", F.when(F.col("anchor").isNotNull(), F.struct("date", "anchor", "n_upto", "cents_upto"))
    )
    return totals.withColumn("prev", F.last("mark", ignorenulls=True).over(before))


def _window_columns(movement: bool):
    gap = (F.col("anchor") - F.col("prev.anchor")) - (F.col("cents_upto") - F.col("prev.cents_upto"))
    off = F.lit("movement" if movement else "mismatch")
    status = (
        F.when(F.col("prev").isNull(), F.lit("unanchored"))
        .when(gap == 0, F.lit("ok"))
        .otherwise(off)
    )
    return gap, status


def reconcile_windows(snapshots: DataFrame, activity: DataFrame, movement: bool = False) -> DataFrame:
    """Consecutive anchors as (from, to] periods: what moved against what the
    balances say. ``movement`` marks gaps that are market movement, not errors."""
    gap, status = _window_columns(movement)
    return (
        _timeline(snapshots, activity)
        .where(F.col("anchor").isNotNull())
        .select(
            "account_id",
            F.col("prev.date").alias("from_date"),
            F.col("date").alias("to_date"),
            F.col("prev.anchor").alias("from_cents"),
            F.col("anchor").alias("to_cents"),
            F.when(F.col("prev").isNotNull(), F.col("n_upto") - F.col("prev.n_upto")).alias("txn_count"),
            F.when(F.col("prev").isNotNull(), F.col("cents_upto") - F.col("prev.cents_upto")).alias(
                "txn_sum_cents"
            ),
            gap.alias("gap_cents"),
            status.alias("status"),
        )
    )


def reconcile_accounts(
    accounts: DataFrame, snapshots: DataFrame, transactions: DataFrame
) -> DataFrame:
    """All windows of all accounts: ledgers against their rows, balance accounts
    against what was paid in."""
    kinds = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"), "kind")

    def of_kind(df: DataFrame, kind: str) -> DataFrame:
        return df.join(kinds.where(F.col("kind") == kind).select("account_id"), "account_id", "left_semi")

    ledgers = reconcile_windows(
        of_kind(snapshots, "transaction"), of_kind(daily_activity(transactions), "transaction")
    )
    valued = reconcile_windows(
        of_kind(snapshots, "balance"), of_kind(daily_contributions(transactions), "balance"), movement=True
    )
    return kinds.join(ledgers.unionByName(valued), "account_id")


def account_status(accounts: DataFrame, windows: DataFrame) -> DataFrame:
    """One verdict per account: mismatch, ok (something was checked) or unanchored."""
    counts = windows.groupBy("account_id").agg(
        F.count_if(F.col("status") == "mismatch").alias("mismatches"),
        F.count_if(F.col("status") != "unanchored").alias("checked"),
    )
    return (
        accounts.select(F.col("id").alias("account_id"), "name", "kind")
        .join(counts, "account_id", "left")
        .select(
            "account_id",
            "name",
            "kind",
            F.coalesce("checked", zero()).alias("checked"),
            F.coalesce("mismatches", zero()).alias("mismatches"),
            F.when(F.col("mismatches") > 0, F.lit("mismatch"))
            .when(F.col("checked") > 0, F.lit("ok"))
            .otherwise(F.lit("unanchored"))
            .alias("status"),
        )
    )


def cleared_windows(snapshots: DataFrame, transactions: DataFrame) -> DataFrame:
    """The checked periods of each account."""
    return (
        reconcile_windows(snapshots, daily_activity(transactions))
        .where("status != 'unanchored'")
        .select("account_id", "from_date", "to_date", "txn_count", "txn_sum_cents", "status")
    )


def cleared_days(snapshots: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per account and day with activity, the period that covers it and its state."""
    _, status = _window_columns(movement=False)
    ahead = (
        Window.partitionBy("account_id").orderBy("date").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    marked = _timeline(snapshots, daily_activity(transactions)).withColumn(
        "closing",
        F.when(
            F.col("anchor").isNotNull(),
            F.struct(F.col("prev.date").alias("from_date"), F.col("date").alias("to_date"), status.alias("status")),
        ),
    )
    return (
        marked.withColumn("cover", F.first("closing", ignorenulls=True).over(ahead))
        .where("n > 0")
        .select(
            "account_id",
            "date",
            F.when(F.col("cover.status") != "unanchored", F.col("cover.from_date")).alias("from_date"),
            F.when(F.col("cover.status") != "unanchored", F.col("cover.to_date")).alias("to_date"),
            F.when(F.col("cover.status") == "ok", F.lit("reconciled"))
            .when(F.col("cover.status") == "mismatch", F.lit("mismatch"))
            .otherwise(F.lit("open"))
            .alias("cleared"),
        )
    )


def cleared_state(snapshots: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows with their cleared state, joined on (account, day): the day side has
    one row per key, so a hot account only makes a partition AQE can split."""
    return transactions.join(cleared_days(snapshots, transactions), ["account_id", "date"], "left")


def reconcile_issues(snapshots: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per suspect row of a mismatched period: rows that equal the gap, rows
    that are half of it (sign turned round), and repeats among the first.

    Each (account, day) first learns its period, one row per day, so a row meets
    just that period and its two wanted amounts, however often an amount recurs."""
    windows = reconcile_windows(snapshots, daily_activity(transactions))
    gap = F.col("gap_cents")
    wanted = windows.where("status = 'mismatch'").select(
        "account_id",
        "to_date",
        "gap_cents",
        F.explode(
            F.array(
                F.struct(F.lit("extra_row").alias("issue"), (-gap).alias("amount_cents")),
                F.struct(
                    F.lit("wrong_sign").alias("issue"),
                    F.when(gap % 2 == 0, -F.expr("gap_cents div 2")).alias("amount_cents"),
                ),
            )
        ).alias("w"),
    ).select("account_id", "to_date", "gap_cents", "w.*")
    days = cleared_days(snapshots, transactions).where("cleared = 'mismatch'").select("account_id", "date", "to_date")
    rows = transactions.select("id", "account_id", "date", "amount_cents", "description")
    hits = rows.join(days, ["account_id", "date"]).join(wanted, ["account_id", "to_date", "amount_cents"])
    alike = ["account_id", "date", "amount_cents", "description"]
    repeats = hits.where("issue = 'extra_row'").groupBy(*alike).agg(F.count("*").alias("n")).where("n > 1")
    repeated = hits.where("issue = 'extra_row'").join(repeats.drop("n"), alike, "left_semi").withColumn("issue", F.lit("repeated_row"))
    issue = F.col("issue")
    return hits.unionByName(repeated.select(*hits.columns)).select(
        "account_id",
        "to_date",
        "gap_cents",
        "id",
        "issue",
        F.when(issue == "repeated_row", F.lit("error")).when(issue == "extra_row", F.lit("warning")).otherwise(F.lit("info")).alias("severity"),
        F.when(issue == "repeated_row", F.lit("the same row is there more than once and equals the gap"))
        .when(issue == "extra_row", F.lit("one row equals the gap"))
        .otherwise(F.lit("one row equals half the gap"))
        .alias("message"),
        F.when(issue == "wrong_sign", F.lit("turn its sign")).otherwise(F.lit("delete it if it is not on the statement")).alias("fix"),
    )


def with_pending(
    transactions: DataFrame, snapshots: DataFrame, staged: DataFrame, staged_balances: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The books as though the given staged rows and balances, those included of
    files under review, were already in."""
    cols = ["id", "account_id", "date", "amount_cents", "description"]
    rows = transactions.select(*cols).unionByName(staged.select(*cols))
    return rows, balance_upsert(snapshots, staged_balances)


def balance_upsert(snapshots: DataFrame, incoming: DataFrame, today: str | None = None) -> DataFrame:
    """One balance per account and day; an incoming one replaces what is on file.
    With several incoming for one day the highest ``seq`` wins. Nothing dated
    after ``today`` is accepted."""
    fresh = incoming if today is None else incoming.where(F.col("date") <= F.lit(today).cast("date"))
    seq = F.col("seq") if "seq" in incoming.columns else F.lit(0)
    return (
        snapshots.select("account_id", "date", "balance_cents", "source", F.lit(-1).cast("long").alias("seq"))
        .unionByName(fresh.select("account_id", "date", "balance_cents", "source", seq.cast("long").alias("seq")))
        .groupBy("account_id", "date")
        .agg(F.max_by(F.struct("balance_cents", "source"), F.struct("seq", "balance_cents")).alias("b"))
        .select("account_id", "date", "b.balance_cents", "b.source")
    )


def balance_replace_check(staged_balances: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What a staged balance does to the one already on file for that day."""
    held = snapshots.select("account_id", "date", F.col("balance_cents").alias("on_file_cents"))
    return staged_balances.join(held, ["account_id", "date"], "left").withColumn(
        "effect",
        F.when(F.col("on_file_cents").isNull(), F.lit("new"))
        .when(F.col("on_file_cents") == F.col("balance_cents"), F.lit("already_on_file"))
        .otherwise(F.lit("replaces")),
    )
