"""Pairing the two legs of money moved between own accounts.

Two legs may pair when their amounts are equal and opposite, their accounts
differ, their days are close, both are unlinked and the pair was not dismissed.
A popular amount would make that join quadratic, so counts and partners come
from per-(amount, day) sums instead: candidates = all legs near in time, minus
those in the own account, minus dismissed ones. The xor of ids travels along
with each count, so where the count is one the xor *is* the partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MANUAL_TRANSFER_WINDOW_DAYS, TRANSFER_WINDOW_DAYS
from ..functions.accounts import payment_category
from ..functions.dates import day_number


def free_legs(transactions: DataFrame) -> DataFrame:
    return transactions.where(
        "transfer_peer_id is null and transfer_account_id is null and amount_cents != 0"
    ).select(
        "id",
        "account_id",
        "date",
        day_number(F.col("date")).alias("day"),
        F.abs("amount_cents").alias("size"),
        (F.col("amount_cents") < 0).alias("is_out"),
    )


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _nothing() -> Column:
    return F.lit(0).cast("long")


def _dismissed(legs: DataFrame, rejections: DataFrame, window: int) -> DataFrame:
    """Per leg: how many of its candidates were dismissed, by distance in days."""
    a = legs.select(*[F.col(c).alias(f"a_{c}") for c in legs.columns])
    b = legs.select(*[F.col(c).alias(f"b_{c}") for c in legs.columns])
    pairs = (
        rejections.select("txn_a_id", "txn_b_id")
        .distinct()
        .join(a, F.col("txn_a_id") == F.col("a_id"))
        .join(b, F.col("txn_b_id") == F.col("b_id"))
        .where(
            (F.col("a_size") == F.col("b_size"))
            & (F.col("a_is_out") != F.col("b_is_out"))
            & (F.col("a_account_id") != F.col("b_account_id"))
            & (F.abs(F.col("a_day") - F.col("b_day")) <= window)
        )
        .withColumn("apart", F.abs(F.col("a_day") - F.col("b_day")))
    )
    sides = F.explode(
        F.array(
            F.struct(F.col("a_id").alias("id"), F.col("b_id").alias("other")),
            F.struct(F.col("b_id").alias("id"), F.col("a_id").alias("other")),
        )
    )
    flat = pairs.select("apart", sides.alias("s")).select("apart", "s.id", "s.other")
    return flat.groupBy("id").agg(
        F.count("*").alias("gone"),
        F.bit_xor("other").alias("gone_xor"),
        *[F.count_if(F.col("apart") == d).alias(f"gone{d}") for d in range(window + 1)],
    )


def leg_candidates(
    transactions: DataFrame, rejections: DataFrame, window: int = TRANSFER_WINDOW_DAYS
) -> DataFrame:
    """Every free leg with the number of legs it could pair with, the distance of
    the nearest one, and the partner where there is exactly one."""
    legs = free_legs(transactions)
    keys = ["size", "account_id", "day"]
    points = legs.groupBy(*keys).agg(
        *[
            agg
            for side, out in (("in", False), ("out", True))
            for agg in (
                F.count_if(F.col("is_out") == out).alias(f"n_{side}"),
                F.coalesce(
                    F.bit_xor(F.when(F.col("is_out") == out, F.col("id"))), _nothing()
                ).alias(f"x_{side}"),
            )
        ]
    )
    facts = ["n_in", "x_in", "n_out", "x_out"]
    days = points.groupBy("size", "day").agg(
        F.sum("n_in").alias("n_in"),
        F.bit_xor("x_in").alias("x_in"),
        F.sum("n_out").alias("n_out"),
        F.bit_xor("x_out").alias("x_out"),
    )

    def around(df: DataFrame, by: list[str], tag: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("day")
        near = order.rangeBetween(-window, window)
        cols = []
        for side in ("in", "out"):
            cols += [
                F.sum(f"n_{side}").over(near).alias(f"{tag}_n_{side}"),
                F.bit_xor(f"x_{side}").over(near).alias(f"{tag}_x_{side}"),
            ]
            for d in range(window + 1):
                ahead = F.coalesce(F.sum(f"n_{side}").over(order.rangeBetween(d, d)), _nothing())
                behind = F.coalesce(F.sum(f"n_{side}").over(order.rangeBetween(-d, -d)), _nothing())
                cols.append((ahead + (behind if d else _nothing())).alias(f"{tag}_{side}{d}"))
        return df.select(*by, "day", *cols)

    own = around(points, ["size", "account_id"], "own")
    everyone = around(days.select("size", "day", *facts), ["size"], "all")
    gone = _dismissed(legs, rejections, window)
    joined = (
        legs.join(own, keys).join(everyone, ["size", "day"]).join(gone, "id", "left")
    )

    def pick(name: str) -> Column:
        """The facts about the other side of this leg."""
        return F.when(F.col("is_out"), F.col(name.format("in"))).otherwise(F.col(name.format("out")))

    def missing(name: str) -> Column:
        return F.coalesce(F.col(name), _nothing())

    count = pick("all_n_{}") - pick("own_n_{}") - missing("gone")
    partner = _xor(_xor(pick("all_x_{}"), pick("own_x_{}")), missing("gone_xor"))
    nearest = F.coalesce(
        *[
            F.when(pick(f"all_{{}}{d}") - pick(f"own_{{}}{d}") - missing(f"gone{d}") > 0, F.lit(d).cast("long"))
            for d in range(window + 1)
        ]
    )
    return joined.select(
        "id",
        "account_id",
        "date",
        F.when(F.col("is_out"), -F.col("size")).otherwise(F.col("size")).alias("amount_cents"),
        "is_out",
        count.alias("candidates"),
        nearest.alias("nearest_days"),
        partner.alias("_partner"),
    ).select(
        "*", F.when(F.col("candidates") == 1, F.col("_partner")).alias("only_partner_id")
    ).drop("_partner")


def transfer_candidates(
    transactions: DataFrame, rejections: DataFrame, window: int = TRANSFER_WINDOW_DAYS
) -> DataFrame:
    """Outgoing legs that have something to pair with. Who exactly the partners of
    an ambiguous leg are is a question for one leg: `candidates_for`."""
    return (
        leg_candidates(transactions, rejections, window)
        .where("is_out and candidates > 0")
        .drop("is_out")
    )


def candidates_for(
    transactions: DataFrame,
    rejections: DataFrame,
    asked: DataFrame,
    window: int = TRANSFER_WINDOW_DAYS,
) -> DataFrame:
    """All candidates of the few legs in ``asked`` (id), whichever side they are."""
    legs = free_legs(transactions)
    mine = legs.join(asked.select("id"), "id", "left_semi").select(
        F.col("id").alias("asked_id"),
        F.col("account_id").alias("asked_account"),
        F.col("day").alias("asked_day"),
        "size",
        (~F.col("is_out")).alias("is_out"),
    )
    pairs = legs.join(mine, ["size", "is_out"]).where(
        (F.col("account_id") != F.col("asked_account"))
        & (F.abs(F.col("day") - F.col("asked_day")) <= window)
    )
    keyed = pairs.withColumn("txn_a_id", F.least("id", "asked_id")).withColumn(
        "txn_b_id", F.greatest("id", "asked_id")
    )
    return rejected_pair_anti(keyed, rejections).select(
        "asked_id",
        F.col("id").alias("peer_id"),
        F.col("account_id").alias("peer_account_id"),
        F.col("date").alias("peer_date"),
        F.abs(F.col("day") - F.col("asked_day")).cast("long").alias("day_diff"),
    )


def manual_peer_candidates(
    transactions: DataFrame,
    rejections: DataFrame,
    asked: DataFrame,
    window: int = MANUAL_TRANSFER_WINDOW_DAYS,
) -> DataFrame:
    """Rows in the account named beside each asked id (id, target_account_id)."""
    found = candidates_for(transactions, rejections.limit(0), asked, window)
    named = asked.select(
        F.col("id").alias("asked_id"), F.col("target_account_id").alias("peer_account_id")
    )
    return found.join(named, ["asked_id", "peer_account_id"])


def rejected_pair_anti(pairs: DataFrame, rejections: DataFrame) -> DataFrame:
    """Pairs (txn_a_id < txn_b_id) that nobody has dismissed."""
    return pairs.join(rejections, ["txn_a_id", "txn_b_id"], "left_anti")


def auto_link(
    transactions: DataFrame, rejections: DataFrame, window: int = TRANSFER_WINDOW_DAYS
) -> DataFrame:
    """The obvious pairs: each leg is the other's only candidate. Both legs name the
    same two ids, so a pair is a group of two; one aggregate finds them."""
    single = leg_candidates(transactions, rejections, window).where("candidates = 1")
    pair = [F.least("id", "only_partner_id").alias("a"), F.greatest("id", "only_partner_id").alias("b")]

    def leg(is_out: bool, column: str):
        return F.max(F.when(F.col("is_out") == is_out, F.col(column)))

    return (
        single.groupBy(*pair)
        .agg(
            F.count("*").alias("legs"),
            leg(True, "id").alias("out_id"),
            leg(False, "id").alias("in_id"),
            leg(True, "account_id").alias("out_account_id"),
            leg(False, "account_id").alias("in_account_id"),
            leg(True, "amount_cents").alias("amount_cents"),
            leg(True, "nearest_days").alias("day_diff"),
        )
        .where("legs = 2")
        .drop("a", "b", "legs")
    )


def link_category(pairs: DataFrame, accounts: DataFrame, categories: DataFrame) -> DataFrame:
    """The category both legs of a pair are filed under: the payment category of
    the receiving account if it is a debt, else plain Transfer."""
    debts = accounts.select(
        F.col("id").alias("in_account_id"),
        F.coalesce(payment_category(F.col("account_type")), F.lit("Transfer")).alias("category_name"),
    )
    ids = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return pairs.join(debts, "in_account_id").join(ids, "category_name")


def apply_links(transactions: DataFrame, linked: DataFrame) -> DataFrame:
    """The ledger with the pairs in ``linked`` (out_id, in_id, category_id) set."""
    ends = linked.select(
        F.explode(
            F.array(
                F.struct(F.col("out_id").alias("id"), F.col("in_id").alias("new_peer"), "category_id"),
                F.struct(F.col("in_id").alias("id"), F.col("out_id").alias("new_peer"), "category_id"),
            )
        ).alias("e")
    ).select("e.id", "e.new_peer", F.col("e.category_id").alias("new_category"))
    return transactions.join(ends, "id", "left").select(
        *[
            F.coalesce("new_peer", c).alias(c)
            if c == "transfer_peer_id"
            else F.coalesce("new_category", c).alias(c)
            if c == "category_id"
            else F.when(F.col("new_peer").isNotNull(), F.lit("auto")).otherwise(F.col(c)).alias(c)
            if c == "category_source"
            else F.col(c)
            for c in transactions.columns
        ]
    )


def linked_transfers(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each linked pair once, from its outgoing leg."""
    names = accounts.select(F.col("id").alias("acct"), F.col("name").alias("acct_name"))
    legs = transactions.where("transfer_peer_id is not null")
    out = legs.where("amount_cents < 0").select(
        F.col("id").alias("out_id"), F.col("transfer_peer_id").alias("in_id"),
        F.col("account_id").alias("acct"), F.col("date").alias("out_date"), "amount_cents",
    ).join(names, "acct").withColumnRenamed("acct_name", "out_account").drop("acct")
    inn = legs.select(
        F.col("id").alias("in_id"), F.col("account_id").alias("acct"), F.col("date").alias("in_date")
    ).join(names, "acct").withColumnRenamed("acct_name", "in_account").drop("acct")
    return out.join(inn, "in_id").select(
        "out_id", "in_id", "out_account", "in_account", "out_date", "in_date", "amount_cents"
    )


def account_linked_transfers(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows that name a balance-only account as their far side."""
    rows = transactions.where("transfer_account_id is not null")
    mine = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    theirs = accounts.select(
        F.col("id").alias("transfer_account_id"), F.col("name").alias("target_account_name")
    )
    return rows.join(mine, "account_id").join(theirs, "transfer_account_id").select(
        "id", "date", "account_name", "target_account_name", "description", "amount_cents"
    )


def unmatched_transfer_legs(transactions: DataFrame, categories: DataFrame) -> DataFrame:
    """Filed as a transfer, with nothing linked on the far side."""
    transfer = categories.where("spending_class = 'transfer'").select(F.col("id").alias("category_id"))
    return transactions.where("transfer_peer_id is null and transfer_account_id is null").join(
        transfer, "category_id", "left_semi"
    )


def transfer_volume(transactions: DataFrame, start: str, end: str) -> DataFrame:
    """Cents moved: each linked pair once by its outgoing leg, and account-linked
    rows, by the row's own day."""
    pair_out = F.col("transfer_peer_id").isNotNull() & (F.col("amount_cents") < 0)
    moved = pair_out | F.col("transfer_account_id").isNotNull()
    days = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return transactions.where(days & moved).agg(
        F.coalesce(F.sum(F.abs("amount_cents")), F.lit(0).cast("long")).alias("moved_cents")
    )
