"""One-to-one assignment under a date window.

Rows that agree on the keys and the day are interchangeable, so the assignment
is settled on counts per (keys, day) -- never on pairs -- and afterwards handed
to rows by their rank. A key group costs one row per calendar day however many
rows it holds, and every step is an equality join or a window over days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import positions


def one_to_one(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    offsets: Sequence[int],
) -> DataFrame:
    """Pair ``left`` (keys, day, left_id) with ``right`` (keys, day, right_id).

    ``offsets`` lists the allowed ``left.day - right.day`` in order of
    preference and must cover a whole range. Each round pairs all it can at one
    offset, lowest ids first. Returns the keys, left_id, right_id, days (the offset)
    and how many partners each side had before anything was taken."""
    keys = list(keys)
    lo, hi = min(offsets), max(offsets)
    if sorted(offsets) != list(range(lo, hi + 1)):
        raise ValueError("offsets must cover a whole range of days")

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # both are written out, so nothing before them is done again
    ranked_left = positions(left.select(*keys, "day", "left_id"), [*keys, "day"], "left_id", name="l_pos")
    ranked_right = positions(right.select(*keys, "day", "right_id"), [*keys, "day"], "right_id", name="r_pos")
    days = (
        ranked_left.select(*keys, "day", one.alias("l"), zero.alias("r"))
        .unionByName(ranked_right.select(*keys, "day", zero.alias("l"), one.alias("r")))
        .groupBy(*keys, "day")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    group = Window.partitionBy(*keys)
    by_day = group.orderBy("day")

    def shifted(column: str, start: int, end: int | None = None):
        if start == 0 and end is None:
            return F.col(column)
        frame = by_day.rangeBetween(start, start if end is None else end)
        return F.coalesce(F.sum(column).over(frame), zero)

    # Groups that one side never visits cannot pair; drop them before the rounds.
    days = (
        days.withColumn("_has_l", F.max("l").over(group))
        .withColumn("_has_r", F.max("r").over(group))
        .where("_has_l > 0 and _has_r > 0")
        .drop("_has_l", "_has_r")
        .select(
            "*",
            shifted("r", -hi, -lo).alias("left_choices"),
            shifted("l", lo, hi).alias("right_choices"),
        )
        # days without anybody in reach take no part in the rounds
        .where("(l > 0 and left_choices > 0) or (r > 0 and right_choices > 0)")
        .withColumn("_all_l", F.sum("l").over(group))
        .withColumn("_all_r", F.sum("r").over(group))
    )
    # most groups are one row on either side, a pair without any round
    days = cut_lineage(days)
    single = days.where("_all_l = 1 and _all_r = 1").groupBy(*keys).agg(
        F.max(F.when(F.col("l") > 0, F.col("day"))).alias("day"), F.max(F.when(F.col("r") > 0, F.col("day"))).alias("r_day")
    )
    one_each = single.select(
        *keys, "day", one.alias("left_choices"), (F.col("day") - F.col("r_day")).cast("int").alias("days"),
        zero.alias("l_from"), zero.alias("r_from"), one.alias("n"), one.alias("right_choices"),
    )
    days = days.where("_all_l > 1 or _all_r > 1").drop("_all_l", "_all_r").withColumn("l_used", zero).withColumn("r_used", zero)
    for i, d in enumerate(offsets):
        days = days.select(
            "*",
            F.least(F.col("l"), shifted("r", -d)).alias("_take_l"),
            F.least(F.col("r"), shifted("l", d)).alias("_take_r"),
            shifted("r_used", -d).alias("_r_from"),
            shifted("right_choices", -d).alias("_r_choices"),
        )
        days = days.select(
            *keys,
            "day",
            "left_choices",
            "right_choices",
            (F.col("l") - F.col("_take_l")).alias("l"),
            (F.col("r") - F.col("_take_r")).alias("r"),
            (F.col("l_used") + F.col("_take_l")).alias("l_used"),
            (F.col("r_used") + F.col("_take_r")).alias("r_used"),
            *[f"flow{j}" for j in range(i)],
            F.struct(
                F.lit(d).alias("days"),
                F.col("l_used").alias("l_from"),
                F.col("_r_from").alias("r_from"),
                F.col("_take_l").alias("n"),
                F.col("_r_choices").alias("right_choices"),
            ).alias(f"flow{i}"),
        )
    flows = (
        days.select(
            *keys,
            "day",
            "left_choices",
            F.explode(F.array(*[F.col(f"flow{j}") for j in range(len(offsets))])).alias("f"),
        )
        .where("f.n > 0")
        .select(*keys, "day", "left_choices", "f.*")
        .unionByName(one_each)
    )

    placed = (
        ranked_left.join(flows, [*keys, "day"])
        .where("l_pos > l_from and l_pos <= l_from + n")
        .select(
            *keys,
            "left_id",
            "days",
            "left_choices",
            "right_choices",
            (F.col("day") - F.col("days")).alias("day"),
            (F.col("l_pos") - F.col("l_from") + F.col("r_from")).alias("r_pos"),
        )
    )
    return placed.join(ranked_right, [*keys, "day", "r_pos"]).select(
        *keys, "left_id", "right_id", "days", "left_choices", "right_choices"
    )


def nearest_first(window: int) -> list[int]:
    """0, 1, -1, 2, -2, ... : a later left row is preferred at equal distance."""
    return [0, *[s for d in range(1, window + 1) for s in (d, -d)]]
