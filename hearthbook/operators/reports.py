"""Spending, income and counting reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TOP_CATEGORIES_SHOWN
from ..functions.dates import month_of

SLICES = ["base", "living", "luxury", "uncategorized"]


def effective_lines(transactions: DataFrame, splits: DataFrame) -> DataFrame:
    """Split lines where a transaction has them, else the transaction itself."""
    whole = transactions.select(
        F.col("id").alias("transaction_id"), "account_id", "date", "category_id", "amount_cents"
    )
    parts = splits.select(
        "transaction_id",
        F.col("category_id").alias("split_category_id"),
        F.col("amount_cents").alias("split_cents"),
    ).withColumn("is_split", F.lit(True))
    # One left join does both halves: unsplit rows come through unmatched.
    return whole.join(parts, "transaction_id", "left").select(
        "transaction_id",
        "account_id",
        "date",
        F.when(F.col("is_split"), F.col("split_category_id"))
        .otherwise(F.col("category_id"))
        .alias("category_id"),
        F.when(F.col("is_split"), F.col("split_cents"))
        .otherwise(F.col("amount_cents"))
        .alias("amount_cents"),
    )


def in_range(date: Column, start: str, end: str) -> Column:
    return date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def _sums_by_category(
    transactions: DataFrame, splits: DataFrame, start: str, end: str, by_month: bool = True
) -> DataFrame:
    """Sums of effective lines per month, category and direction.

    Few transactions are split, so the ledger is summed where it lies: all rows,
    minus those that have splits, plus the split lines. Only the split ones are
    looked up, by an inner join on the id. While the split ids are few Spark
    broadcasts them; beyond that the join shuffles the ledger's narrow rows once. ``n`` counts lines, so a group emptied this way disappears."""
    rows = transactions.where(in_range(F.col("date"), start, end)).select(
        "id", "date", "category_id", "amount_cents"
    )
    month = [month_of(F.col("date")).alias("month")] if by_month else []

    keys = [*(["month"] if by_month else []), "category_id", "is_out"]

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy(
            *month, "category_id", (F.col("amount_cents") < 0).alias("is_out")
        ).agg(
            F.sum(F.col("sign") * F.col("amount_cents")).alias("cents"), F.sum("sign").alias("n")
        )

    one = F.lit(1).cast("long")
    lines = splits.select(
        F.col("transaction_id").alias("id"),
        F.col("category_id").alias("line_category"),
        F.col("amount_cents").alias("line_cents"),
        one.alias("sign"),
    )
    parents = lines.select("id").distinct().withColumns(
        {"line_category": F.lit(None).cast("long"), "line_cents": F.lit(None).cast("long"), "sign": -one}
    )
    is_line = F.col("sign") > 0
    corrections = rows.join(lines.unionByName(parents), "id").select(
        "date",
        "sign",
        F.when(is_line, F.col("line_category")).otherwise(F.col("category_id")).alias("category_id"),
        F.when(is_line, F.col("line_cents")).otherwise(F.col("amount_cents")).alias("amount_cents"),
    )
    return (
        sums(rows.withColumn("sign", one))
        .unionByName(sums(corrections))
        .groupBy(*keys)
        .agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))
        .where("n > 0")
    )


def _classes(categories: DataFrame) -> DataFrame:
    return categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name"), "spending_class"
    )


def _is_spend() -> Column:
    klass = F.col("spending_class")
    return klass.isin("base", "living", "luxury") | (klass.isNull() & F.col("is_out"))


def spend_by_month_class(
    transactions: DataFrame, splits: DataFrame, categories: DataFrame, start: str, end: str
) -> DataFrame:
    sums = _sums_by_category(transactions, splits, start, end)
    return (
        sums.join(_classes(categories), "category_id", "left")
        .where(_is_spend())
        .groupBy("month", "spending_class")
        .agg(F.sum("cents").alias("total_cents"))
    )


def income_by_month(
    transactions: DataFrame, splits: DataFrame, categories: DataFrame, start: str, end: str
) -> DataFrame:
    sums = _sums_by_category(transactions, splits, start, end)
    return (
        sums.join(_classes(categories), "category_id")
        .where(F.col("spending_class") == "income")
        .groupBy("month")
        .agg(F.sum("cents").alias("total_cents"))
    )


def top_categories(
    transactions: DataFrame,
    splits: DataFrame,
    categories: DataFrame,
    start: str,
    end: str,
    k: int = TOP_CATEGORIES_SHOWN,
) -> DataFrame:
    """Largest spend first; uncategorized spending is a group of its own."""
    return (
        _sums_by_category(transactions, splits, start, end, by_month=False)
        .join(_classes(categories), "category_id", "left")
        .where(_is_spend())
        .groupBy(F.coalesce("category_name", F.lit("Uncategorized")).alias("name"), "spending_class")
        .agg(F.sum("cents").alias("total_cents"))
        .orderBy(F.col("total_cents"), F.col("name"))
        .limit(k)
    )


def calendar_of(bounds: DataFrame, first: str, last: str, cap: int | None = None) -> DataFrame:
    """Every month touched by a row's [first, last]; with ``cap`` the first so many."""
    start = F.trunc(first, "month")
    end = F.trunc(last, "month")
    if cap is not None:
        end = F.least(end, F.add_months(start, cap - 1))
    months = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )
    return bounds.select(F.explode(months).alias("m")).select(month_of(F.col("m")).alias("month"))


def month_calendar(spark, start: str, end: str, cap: int | None = None) -> DataFrame:
    ends = spark.range(1).select(
        F.lit(start).cast("date").alias("first"), F.lit(end).cast("date").alias("last")
    )
    return calendar_of(ends, "first", "last", cap)


def month_pivot_dense(
    transactions: DataFrame, splits: DataFrame, categories: DataFrame, start: str, end: str
) -> DataFrame:
    """One row per calendar month with the four spending slices and income."""
    sums = _sums_by_category(transactions, splits, start, end)
    tagged = sums.join(_classes(categories), "category_id", "left")
    slice_ = F.when(_is_spend(), F.coalesce("spending_class", F.lit("uncategorized"))).when(
        F.col("spending_class") == "income", F.lit("income")
    )
    wide = (
        tagged.withColumn("slice", slice_)
        .where("slice is not null")
        .groupBy("month")
        .pivot("slice", [*SLICES, "income"])
        .agg(F.sum("cents"))
    )
    calendar = month_calendar(transactions.sparkSession, start, end)
    zero = F.lit(0).cast("long")
    return calendar.join(wide, "month", "left").select(
        "month",
        *[F.coalesce(F.abs(F.col(s)), zero).alias(s) for s in SLICES],
        F.coalesce(F.col("income"), zero).alias("income"),
    )


def month_summary(pivot: DataFrame) -> DataFrame:
    spend = F.col("base") + F.col("living") + F.col("luxury") + F.col("uncategorized")
    return pivot.select(
        "month",
        spend.alias("spend"),
        "income",
        (F.col("income") - spend).alias("net"),
        "base",
        "living",
        "luxury",
    )


def category_txn_counts(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    counts = transactions.groupBy("category_id").agg(F.count("*").alias("n"))
    return categories.join(counts, categories["id"] == counts["category_id"], "left").select(
        categories["id"],
        "name",
        "spending_class",
        F.coalesce("n", F.lit(0).cast("long")).alias("txn_count"),
    )


def ledger_counts(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.count("*").alias("total"), F.count_if(F.col("category_id").isNull()).alias("uncategorized")
    )


def _counted(df: DataFrame, key: str, name: str) -> DataFrame:
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.count("*").alias(name))
    )


def account_activity_counts(
    accounts: DataFrame, transactions: DataFrame, snapshots: DataFrame, batches: DataFrame
) -> DataFrame:
    """Transactions, snapshots and batches per account, and legs in other
    accounts that name it as their far side."""
    out = accounts.select("id", "name", "kind", "sort_order")
    parts = {
        "txn_count": (transactions, "account_id"),
        "snapshot_count": (snapshots, "account_id"),
        "batch_count": (batches, "account_id"),
        "far_side_count": (transactions, "transfer_account_id"),
    }
    for name, (df, key) in parts.items():
        out = out.join(_counted(df, key, name), "id", "left")
    return out.select(
        "id",
        "name",
        "kind",
        "sort_order",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in parts],
    )


def guarded_archive_check(activity: DataFrame) -> DataFrame:
    """Accounts that may be deleted outright, and what stands in the way."""
    history = F.col("txn_count") + F.col("snapshot_count") + F.col("batch_count")
    return activity.select(
        "id",
        "name",
        F.when(history > 0, F.lit("history"))
        .when(F.col("far_side_count") > 0, F.lit("far_side"))
        .otherwise(F.lit("deletable"))
        .alias("verdict"),
    )


def kind_switch_violations(
    accounts: DataFrame, transactions: DataFrame
) -> DataFrame:
    """Balance accounts that hold rows, ledger accounts named as a far side."""
    holds = transactions.groupBy(F.col("account_id").alias("id")).agg(F.count("*").alias("rows"))
    named = _counted(transactions, "transfer_account_id", "rows")
    kinds = accounts.select("id", "name", "kind")
    return (
        kinds.where("kind = 'balance'")
        .join(holds, "id")
        .withColumn("violation", F.lit("balance_account_has_rows"))
        .unionByName(
            kinds.where("kind = 'transaction'")
            .join(named, "id")
            .withColumn("violation", F.lit("ledger_account_is_far_side"))
        )
    )
