"""Appending to a ledger kept as parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import month_of
from ..session import cut_lineage

KEY = ["account_id", "dedupe_hash"]


def read_ledger(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The ledger at ``path``, or None before its first commit. With ``schema`` (of
    the rows and ``month``) a ledger without any file yet is an empty one."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_rows(rows: DataFrame, path: str) -> None:
    """Add the rows whose (account, hash) the ledger lacks, so that a commit may be
    repeated after a failure, also one that left an empty folder. Two commits at the
    same time may both add a row: let one stream or job write a ledger. One folder per month keeps the number of folders
    bounded; within it rows are clustered by account for scans of one account."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(KEY).withColumn("month", month_of(F.col("date")))
    known = read_ledger(spark, path, fresh.schema)
    if known is not None:
        # The hash covers the date, so only the months of this commit can hold one
        # of its rows; there is one name per calendar month to fetch.
        fresh = cut_lineage(fresh)
        months = [r["month"] for r in fresh.select("month").distinct().collect()]
        held = known.where(F.col("month").isin(months)).select(*KEY)
        fresh = fresh.join(held, KEY, "left_anti")
    # rebalancing by month splits a hot month over many tasks and packs quiet ones
    (
        fresh.hint("rebalance", F.col("month"))
        .sortWithinPartitions("month", "account_id", "date")
        .write.mode("append")
        .partitionBy("month")
        .parquet(path)
    )
