"""Reading uploads and folders: CSV records, order history, extracted statements."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.money import parse_money
from ..operators.ordering import positions

CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "",
    "escape": '"',
}

STATEMENT_SCHEMA = """
    statement_id long, account_type string, statementStart date, statementEnd date,
    institutionName string, accountName string, accountLastFour string,
    transactions array<struct<date: date, description: string, amountCents: long>>,
    balances array<struct<kind: string, date: date, balanceCents: long>>,
    problems array<string>, blocked boolean
"""


def read_csv_records(spark: SparkSession, path: str, quoted_newlines: bool = False) -> DataFrame:
    """CSV files of one header shape as all-string columns, with the file and the
    place of each row in it. Files are split over tasks unless cells may hold
    line breaks; the place follows from the split's offset and the row's order
    within the split, both of which Spark reports."""
    raw = spark.read.options(**CSV_OPTIONS, multiLine=str(quoted_newlines).lower()).csv(path)
    headers = raw.columns
    cells = raw.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in headers],
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    placed = positions(cells, ["file"], "_seq", "_start", "row_index")
    return placed.withColumn("row_index", F.col("row_index") - 1).drop("_start", "_seq")


def as_records(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Header-keyed string maps, the form mappings are applied to."""
    cells = [part for h in headers for part in (F.lit(h), F.col(f"`{h}`"))]
    return rows.select("file", "row_index", F.create_map(*cells).alias("record"))


def read_order_history(spark: SparkSession, path: str, date_format: str = "YYYY-MM-DD") -> DataFrame:
    """Item rows of an order-history export: one per ordered item."""
    rows = spark.read.options(**CSV_OPTIONS).csv(path)
    return rows.select(
        F.col("`Order ID`").alias("order_id"),
        parse_date(F.col("`Order Date`"), date_format).alias("order_date"),
        F.col("`Product Name`").alias("description"),
        F.col("Quantity").try_cast("long").alias("quantity"),
        parse_money(F.col("`Total Owed`")).alias("total_cents"),
    )


def new_orders(items: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders and items not on file yet; an order already known is skipped whole."""
    fresh = items.join(known.select("order_id"), "order_id", "left_anti")
    orders = fresh.groupBy("order_id").agg(
        F.min("order_date").alias("order_date"),
        F.sum("total_cents").alias("total_cents"),
        F.count("*").alias("items"),
    )
    return orders, fresh


def order_history_stats(items: DataFrame, known: DataFrame) -> DataFrame:
    per_order = items.groupBy("order_id").agg(F.count("*").alias("items"))
    on_file = known.select("order_id").distinct().withColumn("hit", F.lit(1))
    return per_order.join(on_file, "order_id", "left").agg(
        F.count_if(F.col("hit").isNull()).alias("orders_added"),
        F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("items"))), F.lit(0).cast("long")).alias("items_added"),
        F.count("hit").alias("orders_skipped"),
    )


def relative_path(path: Column, folder: str) -> Column:
    """A file's path within ``folder``, on any file system: scheme and authority are
    left out of both, as one of them may not name them."""
    scheme = r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    root = "/" + re.sub(scheme, "", folder).strip("/")
    inside = F.concat(F.lit("/"), F.ltrim(F.regexp_replace(path, scheme, ""), F.lit("/")))
    return F.substr(inside, F.lit(len(root.rstrip("/")) + 2))


def folder_scan(spark: SparkSession, folder: str, keep: list[str]) -> DataFrame:
    """Every file below a folder by its path within it; files whose name ends in
    none of ``keep`` are listed as skipped. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    )
    wanted = reduce(lambda a, b: a | b, [F.lower("path").endswith(k.lower()) for k in keep])
    return files.select(
        relative_path(F.col("path"), folder).alias("rel_path"),
        F.col("length").alias("size_bytes"),
        F.when(wanted, F.lit("kept")).otherwise(F.lit("skipped")).alias("status"),
    )


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements somebody else extracted, one JSON record each."""
    return spark.read.schema(STATEMENT_SCHEMA).json(path)
