"""Splitting a transaction over lines or order items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running


def split_validate(transactions: DataFrame, proposed: DataFrame) -> DataFrame:
    """A split needs two non-zero lines that total the transaction exactly."""
    sums = (
        proposed.where("category_id is not null and amount_cents is not null and amount_cents != 0")
        .groupBy(F.col("transaction_id").alias("id"))
        .agg(F.count("*").alias("lines"), F.sum("amount_cents").alias("line_cents"))
    )
    asked = proposed.select(F.col("transaction_id").alias("id")).distinct()
    zero = F.lit(0).cast("long")
    return (
        transactions.select("id", "amount_cents")
        .join(asked, "id")
        .join(sums, "id", "left")
        .select(
            "id",
            "amount_cents",
            F.coalesce("lines", zero).alias("lines"),
            F.coalesce("line_cents", zero).alias("line_cents"),
        )
        .withColumn(
            "problem",
            F.when(F.col("lines") < 2, F.lit("needs two lines")).when(
                F.col("line_cents") != F.col("amount_cents"), F.lit("total differs")
            ),
        )
    )


def item_split_allocate(charges: DataFrame, items: DataFrame) -> DataFrame:
    """Allocate a charge over its order's items in proportion to their price, tax
    and shipping included, to the cent.

    Each item gets the rounded running total up to it minus the one before, so
    the shares add up exactly whatever the rounding did, and only running sums
    are needed -- no ranking of remainders over an order's whole group.
    ``charges``: order_id, amount_cents; ``items``: order_id, item_id, total_cents."""
    sums = items.groupBy("order_id").agg(F.sum("total_cents").alias("items_cents")).where("items_cents > 0")
    whole = charges.join(sums, "order_id")
    upto = running(items, ["order_id"], "item_id", {"upto": F.col("total_cents")})
    wide = "decimal(38,0)"

    def rounded(x: str) -> str:
        # 38 digits: a running total times an amount may leave 64 bits
        return (
            f"cast((cast(2 * {x} as {wide}) * cast(abs(amount_cents) as {wide}) + cast(items_cents as {wide}))"
            f" div cast(2 * items_cents as {wide}) as bigint)"
        )

    share = F.expr(f"{rounded('upto')} - {rounded('(upto - total_cents)')}")
    return (
        upto.join(whole, "order_id")
        .withColumn("share", F.when(F.col("amount_cents") < 0, -share).otherwise(share))
        .select(
            "order_id", "item_id", "part_id", "total_cents", "amount_cents", F.col("share").alias("share_cents")
        )
    )
