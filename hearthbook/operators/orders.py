"""Matching online orders to card charges.

exact: one charge of the order's total. split: one order, several charges.
combined: several orders, one charge. Splits and combinations are looked for among
what no exact match explains, as subsets of up to ``MOST`` rows in the order's window
of days (`subsets`)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ORDER_MATCH_WINDOW_DAYS
from ..functions.dates import day_number
from ..session import cut_lineage
from .assign import one_to_one
from .subsets import MOST, match_subsets, open_targets

KEYS = ["account_id", "size"]
MATCH_COLUMNS = "kind order_id charge_id amount_cents days confidence status".split()


def _day(column: str = "date") -> Column:
    return day_number(F.col(column))


def _confidence(days: Column) -> Column:
    return F.lit(1.0) - days / F.lit(20.0)


def _status(sure: Column) -> Column:
    return F.when(sure, F.lit("confirmed")).otherwise(F.lit("suggested"))


def match_exact(
    orders: DataFrame, charges: DataFrame, window: int = ORDER_MATCH_WINDOW_DAYS
) -> DataFrame:
    """One charge of exactly the total, 0..window days after the order. Confirmed
    when neither side had another choice."""
    left = charges.where("amount_cents < 0").select(
        "account_id", (-F.col("amount_cents")).alias("size"), _day().alias("day"), F.col("id").alias("left_id")
    )
    right = orders.select(
        "account_id", F.col("total_cents").alias("size"), _day().alias("day"), F.col("id").alias("right_id")
    )
    return one_to_one(left, right, KEYS, list(range(window + 1))).select(
        F.lit("exact").alias("kind"),
        F.col("right_id").alias("order_id"),
        F.col("left_id").alias("charge_id"),
        (-F.col("size")).alias("amount_cents"),
        F.col("days").cast("long").alias("days"),
        _confidence(F.col("days")).alias("confidence"),
        _status((F.col("left_choices") == 1) & (F.col("right_choices") == 1)).alias("status"),
    )


def _sizes(orders: DataFrame, charges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as (account_id, day, size, id), amounts above zero."""
    return (
        orders.select("account_id", _day().alias("day"), F.col("total_cents").alias("size"), "id"),
        charges.select("account_id", _day().alias("day"), (-F.col("amount_cents")).alias("size"), "id"),
    )


def match_split(
    orders: DataFrame, charges: DataFrame, window: int = ORDER_MATCH_WINDOW_DAYS, most: int = MOST, bounds: dict[int, int] | None = None, rounds: int | None = None
) -> DataFrame:
    """One order paid by 2..most charges 0..window days after it. ``days`` is that of
    the last charge."""
    targets, parts = _sizes(orders, charges)
    pairs = match_subsets(targets, parts, 0, window, most, bounds, rounds)
    amounts = charges.select(F.col("id").alias("part_id"), "amount_cents")
    return pairs.join(amounts, "part_id").select(
        F.lit("split").alias("kind"),
        F.col("target_id").alias("order_id"),
        F.col("part_id").alias("charge_id"),
        "amount_cents",
        "days",
        _confidence(F.col("days")).alias("confidence"),
        _status(F.col("sure")).alias("status"),
    )


def match_combined(
    orders: DataFrame, charges: DataFrame, window: int = ORDER_MATCH_WINDOW_DAYS, most: int = MOST, bounds: dict[int, int] | None = None, rounds: int | None = None
) -> DataFrame:
    """2..most orders paid by one charge 0..window days after each of them. The
    portion of each order is its own total; ``days`` is that of the first order."""
    parts, targets = _sizes(orders, charges)
    pairs = match_subsets(targets, parts, -window, 0, most, bounds, rounds)
    totals = orders.select(F.col("id").alias("part_id"), "total_cents")
    return pairs.join(totals, "part_id").select(
        F.lit("combined").alias("kind"),
        F.col("part_id").alias("order_id"),
        F.col("target_id").alias("charge_id"),
        (-F.col("total_cents")).alias("amount_cents"),
        "days",
        _confidence(F.col("days")).alias("confidence"),
        _status(F.col("sure")).alias("status"),
    )


def order_reach(
    orders: DataFrame, charges: DataFrame, matches: DataFrame, window: int = ORDER_MATCH_WINDOW_DAYS, most: int = MOST, bounds: dict[int, int] | None = None
) -> DataFrame:
    """Orders that no match explains: how many different open charges lie in their
    window, and up to how many of them together were tried. A bound that kept a larger
    subset from being tried shows as ``tried`` below ``most``."""
    targets, parts = _sizes(*unexplained(orders, charges, matches))
    none = targets.select(F.col("id").alias("target_id")).limit(0)
    return open_targets(targets, parts, none, 0, window, most, bounds)


def unexplained(orders: DataFrame, charges: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders and charges that ``matches`` does not touch."""
    return (
        orders.join(matches.select(F.col("order_id").alias("id")), "id", "left_anti"),
        charges.join(matches.select(F.col("charge_id").alias("id")), "id", "left_anti"),
    )


def written(sides: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both sides written out: a matcher reads each several times."""
    return cut_lineage(sides[0]), cut_lineage(sides[1])


def run_matcher(
    orders: DataFrame, charges: DataFrame, window: int = ORDER_MATCH_WINDOW_DAYS, rounds: int | None = None
) -> DataFrame:
    """All three kinds, the stronger first; each only sees what is left. The
    matches of a stage are written out before the next one reads them. ``rounds`` is that
    of `match_subsets`: as many as it takes."""
    orders = cut_lineage(orders.select("id", "account_id", "date", "total_cents"))
    charges = cut_lineage(charges.select("id", "account_id", "date", "amount_cents"))
    exact = cut_lineage(match_exact(orders, charges, window))
    orders, charges = written(unexplained(orders, charges, exact))
    split = cut_lineage(match_split(orders, charges, window, rounds=rounds))
    orders, charges = written(unexplained(orders, charges, split))
    combined = cut_lineage(match_combined(orders, charges, window, rounds=rounds))
    return exact.unionByName(split).unionByName(combined)


def apply_reviews(matches: DataFrame, reviews: DataFrame) -> DataFrame:
    """What the user decided on matches (order_id, charge_id, action, amount_cents):
    confirm, reject, undo (drops the match) or manual (adds or overrides it with
    full confidence). The last action (highest ``seq``) counts."""
    last = reviews.groupBy("order_id", "charge_id").agg(
        F.max_by(F.struct("action", F.col("amount_cents").alias("given_cents")), "seq").alias("r")
    ).select("order_id", "charge_id", "r.*")
    action = F.col("action")
    return (
        matches.join(last, ["order_id", "charge_id"], "full")
        .where("not (action <=> 'undo') and (kind is not null or action = 'manual')")
        .select(
            F.coalesce("kind", F.lit("exact")).alias("kind"),
            "order_id",
            "charge_id",
            F.coalesce("amount_cents", "given_cents").alias("amount_cents"),
            F.when(action == "manual", F.lit("manual")).otherwise(F.lit("auto")).alias("match_type"),
            F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
            F.when(action.isin("confirm", "manual"), F.lit("confirmed"))
            .when(action == "reject", F.lit("rejected"))
            .otherwise(F.col("status"))
            .alias("status"),
        )
    )


def order_match_stats(orders: DataFrame, matches: DataFrame) -> DataFrame:
    confirmed = matches.where("status = 'confirmed'").select(F.col("order_id").alias("id")).distinct()
    return orders.join(confirmed.withColumn("hit", F.lit(1)), "id", "left").agg(
        F.count("*").alias("orders"), F.count("hit").alias("matched")
    )


def unmatched_orders(orders: DataFrame, matches: DataFrame, shown: int) -> DataFrame:
    confirmed = matches.where("status = 'confirmed'").select(F.col("order_id").alias("id"))
    return orders.join(confirmed, "id", "left_anti").orderBy(F.col("date").desc(), F.col("id").desc()).limit(shown)


def unmatched_charges(charges: DataFrame, matches: DataFrame, patterns: list[str]) -> DataFrame:
    """Outgoing rows of the shop's merchants that no confirmed match explains."""
    named = reduce(lambda a, b: a | b, [F.col("merchant").ilike(p) for p in patterns])
    confirmed = matches.where("status = 'confirmed'").select(F.col("charge_id").alias("id"))
    return charges.where(named & (F.col("amount_cents") < 0)).join(confirmed, "id", "left_anti")


def latest_matches(matches: DataFrame, status: str, shown: int) -> DataFrame:
    newest = [F.col("charge_id").desc(), F.col("order_id").desc()]
    return matches.where(F.col("status") == status).orderBy(*newest).limit(shown)
