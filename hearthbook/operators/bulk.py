"""Committing staged files and following a folder run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BULK_FILE_STATUSES
from ..functions.text import normalize_merchant
from .categorize import guard_blocks
from .staging import commit_rows


def bulk_run_files(sessions: DataFrame, files: DataFrame, shown: int) -> DataFrame:
    counts = files.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    latest = sessions.where("purpose = 'bulk'").orderBy(F.col("id").desc()).limit(shown)
    return latest.join(counts, "id", "left").select(
        "id", "status", F.coalesce("n", F.lit(0).cast("long")).alias("files")
    )


def bulk_progress(files: DataFrame) -> DataFrame:
    finished = F.col("status").isin("categorized", "committed", "skipped", "failed", "held")
    return files.groupBy("session_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in BULK_FILE_STATUSES],
        F.count_if(finished).alias("finished"),
    )


def under_review(df: DataFrame, batches: DataFrame) -> DataFrame:
    """What belongs to files that are neither committed nor discarded."""
    open_files = batches.where("status = 'review'").select(F.col("id").alias("batch_id"))
    return df.join(open_files, "batch_id", "left_semi")


def commit(
    staged: DataFrame, ledger: DataFrame, accounts: DataFrame, categories: DataFrame, memory: DataFrame
) -> DataFrame:
    """The new ledger rows of a commit, filed from memory where that is allowed.
    ``staged`` is of files under review."""
    types = accounts.select(F.col("id").alias("account_id"), "account_type")
    classes = categories.select(F.col("id").alias("category_id"), "spending_class")
    known = memory.select("merchant", "category_id").join(classes, "category_id", "left")
    fresh = commit_rows(staged, ledger)
    rows = fresh.withColumn("merchant", normalize_merchant(F.col("description"))).join(types, "account_id")
    blocked = guard_blocks(
        F.col("amount_cents"), F.col("account_type"), F.coalesce("spending_class", F.lit(""))
    )
    return (
        rows.join(known, "merchant", "left")
        .withColumn("category_id", F.when(~blocked, F.col("category_id")))
        .withColumn("category_source", F.when(F.col("category_id").isNotNull(), F.lit("memory")))
        .drop("spending_class", "account_type")
    )


def commit_stats(staged: DataFrame, committed: DataFrame, balance_effects: DataFrame) -> DataFrame:
    """Per file: staged, inserted and skipped rows, rows filed from memory, and
    balances that are new or replace another (``effect`` of balance_replace_check)."""
    added = committed.groupBy("batch_id").agg(F.count("*").alias("n"), F.count("category_id").alias("filed"))
    recorded = balance_effects.where("effect != 'already_on_file'").groupBy("batch_id").agg(F.count("*").alias("balances"))
    zero = F.lit(0).cast("long")
    return (
        staged.groupBy("batch_id")
        .agg(F.count("*").alias("staged_rows"))
        .join(added, "batch_id", "left")
        .join(recorded, "batch_id", "left")
        .select(
            "batch_id",
            "staged_rows",
            F.coalesce("n", zero).alias("inserted"),
            (F.col("staged_rows") - F.coalesce("n", zero)).alias("skipped"),
            F.coalesce("filed", zero).alias("auto_categorized"),
            F.coalesce("balances", zero).alias("balances_recorded"),
        )
    )
