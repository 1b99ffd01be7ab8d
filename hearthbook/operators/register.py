"""The register: filter, enrich, page, walk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIZE_RUN_LIMIT, REGISTER_PAGE_SIZE
from .ordering import lookup, with_neighbors


@dataclass(frozen=True)
class RegisterFilter:
    """All set fields must hold. ``category`` is an id or ``"none"``;
    ``reconciled`` asks for a cleared state; ``ids`` is a frame of ids."""

    account: int | None = None
    category: int | str | None = None
    spending_class: str | None = None
    start: str | None = None
    end: str | None = None
    text: str | None = None
    reconciled: bool | None = None
    ids: DataFrame | None = None


def _like_pattern(text: str) -> str:
    for special in ("\\", "%", "_"):
        text = text.replace(special, "\\" + special)
    return f"%{text}%"


def register_filter(
    transactions: DataFrame,
    f: RegisterFilter,
    categories: DataFrame | None = None,
    cleared: DataFrame | None = None,
) -> DataFrame:
    """``categories`` is needed for a class, ``cleared`` (account, date, cleared)
    for the reconciled filter. Plain comparisons come first so they reach the scan."""
    out = transactions
    if f.account is not None:
        out = out.where(F.col("account_id") == f.account)
    if f.category == "none":
        out = out.where(F.col("category_id").isNull())
    elif f.category is not None:
        out = out.where(F.col("category_id") == f.category)
    if f.start is not None:
        out = out.where(F.col("date") >= F.lit(f.start).cast("date"))
    if f.end is not None:
        out = out.where(F.col("date") <= F.lit(f.end).cast("date"))
    if f.text:
        out = out.where(F.col("description").ilike(_like_pattern(f.text)))
    if f.ids is not None:
        out = out.join(f.ids.select("id"), "id", "left_semi")
    if f.spending_class is not None:
        wanted = categories.where(F.col("spending_class") == f.spending_class)
        out = out.join(wanted.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    if f.reconciled is not None:
        ok = cleared.where("cleared = 'reconciled'").select("account_id", "date")
        out = out.join(ok, ["account_id", "date"], "left_semi" if f.reconciled else "left_anti")
    return out


def register_enrich(
    transactions: DataFrame, accounts: DataFrame, categories: DataFrame, splits: DataFrame
) -> DataFrame:
    """Names a register line shows. Rows without a category or a peer never meet
    in one task: the first are spread, the second are not in the join at all."""
    names = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    cats = categories.select(
        F.col("id").alias("cat_key"), F.col("name").alias("category_name"), "spending_class"
    )
    lines = splits.groupBy(F.col("transaction_id").alias("id")).agg(F.count("*").alias("split_count"))
    # the peer points back, so its pointer is this row's id
    peers = (
        transactions.where(F.col("transfer_peer_id").isNotNull())
        .select(F.col("transfer_peer_id").alias("id"), "account_id")
        .join(names.withColumnRenamed("account_name", "peer_account_name"), "account_id")
        .drop("account_id")
    )
    out = transactions.join(names, "account_id", "left")
    out = lookup(out, cats, "category_id", "cat_key", "id")
    return (
        out.join(lines, "id", "left")
        .join(peers, "id", "left")
        .select(
            "id",
            "account_id",
            "account_name",
            "date",
            "amount_cents",
            "description",
            "merchant",
            "category_name",
            "spending_class",
            "peer_account_name",
            F.coalesce("split_count", F.lit(0).cast("long")).alias("split_count"),
        )
    )


def newest_first() -> Sequence[Column]:
    return [F.col("date").desc(), F.col("id").desc()]


def register_page(
    transactions: DataFrame, cursor: tuple[str, int] | None = None, size: int = REGISTER_PAGE_SIZE
) -> DataFrame:
    """The page after ``cursor`` (date, id). ``next_cursor`` is set on its last
    row when there is more; one row beyond the page is read to know that."""
    rows = transactions
    if cursor is not None:
        day, last = F.lit(cursor[0]).cast("date"), cursor[1]
        rows = rows.where((F.col("date") < day) | ((F.col("date") == day) & (F.col("id") < last)))
    page = rows.orderBy(*newest_first()).limit(size + 1)
    # the page is at most size + 1 rows, so packing it is bounded
    packed = page.agg(
        F.sort_array(F.collect_list(F.struct("date", "id", "account_id", "amount_cents", "description")), False).alias("p")
    )
    cursor_text = F.concat_ws("_", F.date_format("r.date", "yyyy-MM-dd"), F.col("r.id").cast("string"))
    return packed.select(F.size("p").alias("n"), F.posexplode(F.slice("p", 1, size)).alias("i", "r")).select(
        "r.*",
        F.when((F.col("n") > size) & (F.col("i") == size - 1), cursor_text).alias("next_cursor"),
    )


def neighbor_rows(transactions: DataFrame) -> DataFrame:
    """Previous and next row of the (already filtered) register for every row."""
    cols = transactions.select("id", "date", "merchant")
    return with_neighbors(cols, [], "id", "date", ["id"]).select("id", "date", "prev_id", "next_id")


def categorize_plan(transactions: DataFrame, cap: int = CATEGORIZE_RUN_LIMIT) -> DataFrame:
    """The newest uncategorized rows of one run, and how many wait beyond it."""
    open_rows = transactions.where(F.col("category_id").isNull())
    beyond = open_rows.agg(
        F.greatest(F.count("*") - cap, F.lit(0).cast("long")).alias("queued_beyond_run")
    )
    ids = open_rows.orderBy(*newest_first()).limit(cap).select("id", "date")
    return ids.withColumn("_one", F.lit(1)).join(beyond.withColumn("_one", F.lit(1)), "_one").drop("_one")


def imported_register_frame(transactions: DataFrame, batch_key: str = "import_batch_id") -> DataFrame:
    """Per batch: the account and dates that frame what it added, and how much of
    it still lacks a category."""
    return (
        transactions.where(F.col(batch_key).isNotNull())
        .groupBy(batch_key, "account_id")
        .agg(
            F.min("date").alias("from_date"),
            F.max("date").alias("to_date"),
            F.count("*").alias("added"),
            F.count_if(F.col("category_id").isNull()).alias("uncategorized"),
        )
    )


def txn_detail(
    transactions: DataFrame,
    accounts: DataFrame,
    categories: DataFrame,
    splits: DataFrame,
    matches: DataFrame,
    orders: DataFrame,
) -> DataFrame:
    """Everything a transaction's window lists, as flat child rows: the row itself,
    its peer, its splits, its matched orders. Flat, because nesting would gather a
    transaction's children in one task however many there are."""
    names = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    cats = categories.select(F.col("id").alias("cat_key"), F.col("name").alias("category_name"))
    none = F.lit(None).cast("long")
    own = transactions.select(
        "id", F.lit("transaction").alias("part"), F.col("id").alias("part_id"), "account_id", "category_id", "amount_cents"
    )
    peer = transactions.where(F.col("transfer_peer_id").isNotNull()).select(
        F.col("transfer_peer_id").alias("id"),
        F.lit("peer").alias("part"),
        F.col("id").alias("part_id"),
        "account_id",
        "category_id",
        "amount_cents",
    )
    split = splits.select(
        F.col("transaction_id").alias("id"),
        F.lit("split").alias("part"),
        F.col("line_no").alias("part_id"),
        none.alias("account_id"),
        "category_id",
        "amount_cents",
    )
    order = matches.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi").select(
        F.col("transaction_id").alias("id"),
        F.lit("order").alias("part"),
        F.col("order_id").alias("part_id"),
        none.alias("account_id"),
        none.alias("category_id"),
        "amount_cents",
    )
    parts = own.unionByName(peer).unionByName(split).unionByName(order)
    parts = parts.withColumn("_row", F.xxhash64("id", "part", "part_id"))
    named = lookup(lookup(parts, cats, "category_id", "cat_key", "_row"),
                   names.withColumnRenamed("account_id", "acct_key"), "account_id", "acct_key", "_row")
    return named.select("id", "part", "part_id", "account_name", "category_name", "amount_cents")
