"""Targets paid by several parts: bounded subset sums on counts.

A target (an order, or a charge) is met by k = 2..most parts of its account that lie
within a window of days and add up to it exactly. Rows that agree on account, day and
amount are one cell with a count. Subsets are found by meeting in the middle: a part or
pair of parts near a target leaves a remainder, and the remainder is an equality key of
the other parts or pairs of parts. Cells are then dealt out on counts, and rows get
their partners by rank.

How many cells lie in a target's window decides the work. Up to ``JOINED`` cells subsets
are joined: k = 2 forms that many rows a target, 3 pairs of them an account, 4 pairs of
them a target. Wider windows are searched where they lie (`_searched`): a task holds the
cells of one window and a slice of their pairs, and only subsets that add up leave it. No
target is left out, and cells are dealt until nobody asks any more; whoever gives
``bounds`` or ``rounds`` stops earlier, and `open_targets` reports what bounds kept out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut_lineage
from .ordering import positions

MOST = 4
#: Distinct (day, amount) cells in a target's window up to which k parts are found by joins.
JOINED = {2: 500, 3: 120, 4: 60}
#: Pairs of cells, and subsets, that a search holds at once.
SLICE = 1 << 19
#: The sizes and rounds that the SQL of `order_reach`, and of the reports beside it, states.
#: `match_subsets` has none of its own.
BOUNDS = {2: 20_000, 3: 500, 4: 120}
ROUNDS = 3

CELL = ["account_id", "day", "size"]


def cells(rows: DataFrame) -> DataFrame:
    """account_id, day, size, n of rows (account_id, day, size, id) above zero."""
    return rows.where("size > 0").groupBy(*CELL).agg(F.count("*").alias("n"))


def with_reach(targets: DataFrame, parts: DataFrame, lo: int, hi: int) -> DataFrame:
    """Add ``reach``: the cells of parts within lo..hi days of each target. Counted per
    day, by one window over the days of an account."""
    days = parts.groupBy("account_id", "day").agg(F.count("*").alias("c"), F.lit(0).alias("asked"))
    asked = targets.select("account_id", "day").distinct().withColumn("c", F.lit(0).cast("long")).withColumn("asked", F.lit(1))
    days = days.unionByName(asked).groupBy("account_id", "day").agg(F.sum("c").alias("c"), F.max("asked").alias("asked"))
    near = Window.partitionBy("account_id").orderBy("day").rangeBetween(lo, hi)
    days = days.withColumn("reach", F.sum("c").over(near)).where("asked = 1").select("account_id", "day", "reach")
    return targets.join(days, ["account_id", "day"])


def _bucket(day: Column, width: int) -> Column:
    return F.floor(day / F.lit(width))


def _spread(targets: DataFrame, lo: int, hi: int) -> DataFrame:
    """A row per bucket that the window touches, two at most."""
    width = hi - lo + 1
    ends = F.array(_bucket(F.col("day") + lo, width), _bucket(F.col("day") + hi, width))
    return targets.withColumn("bucket", F.explode(F.array_distinct(ends)))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    """account_id and bucket as they are, the rest with a prefix."""
    return df.select(*[F.col(c) if c in ("account_id", "bucket") else F.col(c).alias(prefix + c) for c in df.columns])


def _pairs(parts: DataFrame, days: DataFrame, width: int) -> DataFrame:
    """Pairs of cells on ``days`` (account_id, day), less than ``width`` days apart, the
    earlier (then smaller) first: account_id, bucket (of the first), total, and both."""
    use = parts.join(days, ["account_id", "day"], "left_semi").withColumn("bucket", _bucket(F.col("day"), width))
    first = _named(use, "a_")
    second = _named(use.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))), "b_")
    in_order = "b_day - a_day < {w} and (b_day > a_day or (b_day = a_day and b_size >= a_size))".format(w=width)
    return first.join(second, ["account_id", "bucket"]).where(in_order).withColumn("total", F.expr("a_size + b_size"))


def _after(x: str, y: str) -> str:
    return f"({y}_day > {x}_day or ({y}_day = {x}_day and {y}_size >= {x}_size))"


def _candidates(targets: DataFrame, parts: DataFrame, k: int, lo: int, hi: int) -> DataFrame:
    """Subsets of k cells: the target's t_* columns and ``members``, an array of
    (day, size, n) in order, none used more often than it is there."""
    width = hi - lo + 1
    inside = lambda x: f"{x}_day between t_day + {lo} and t_day + {hi}"
    spread = _spread(targets, lo, hi).select("account_id", "bucket", *[F.col(c).alias(f"t_{c}") for c in ("day", "size", "n")])
    single = parts.withColumn("bucket", _bucket(F.col("day"), width))
    if k > 2:
        window = F.explode(F.sequence(F.col("day") + lo, F.col("day") + hi)).alias("day")
        days = targets.select("account_id", window).distinct()
        pairs = cut_lineage(_pairs(parts, days, width))
    if k < 4:
        found = spread.join(_named(single, "x_"), ["account_id", "bucket"]).where(f"{inside('x')} and x_size < t_size")
        names, rest = ["x"], "t_size - x_size"
    else:
        found = spread.join(pairs, ["account_id", "bucket"]).where(f"{inside('a')} and {inside('b')} and total < t_size")
        found = found.withColumnsRenamed({f"{p}_{c}": f"{q}_{c}" for p, q in (("a", "x"), ("b", "y")) for c in ("day", "size", "n")})
        names, rest = ["x", "y"], "t_size - total"
    found = found.withColumn("rest", F.expr(rest)).drop("bucket", "total")
    # the other part, or pair of parts, begins in one of the window's buckets
    ends = F.array_distinct(F.array(_bucket(F.col("t_day") + lo, width), _bucket(F.col("t_day") + hi, width)))
    found = found.withColumn("bucket", F.explode(ends))
    if k == 2:
        other, more = _named(single, "y_").withColumn("rest", F.col("y_size")), ["y"]
    else:
        other = pairs.withColumnRenamed("total", "rest")
        more = ["z", "w"] if k == 4 else ["y", "z"]
        other = other.withColumnsRenamed({f"{p}_{c}": f"{q}_{c}" for p, q in zip("ab", more, strict=True) for c in ("day", "size", "n")})
    whole = found.join(other, ["account_id", "bucket", "rest"]).where(" and ".join([*map(inside, more), _after(names[-1], more[0])]))
    cell = lambda x: F.struct(F.col(f"{x}_day").alias("day"), F.col(f"{x}_size").alias("size"), F.col(f"{x}_n").alias("n"))
    members = F.array(*[cell(x) for x in names + more])
    enough = F.forall("members", lambda m: F.size(F.filter("members", lambda o: o == m)) <= m["n"])
    return whole.select("account_id", "t_day", "t_size", "t_n", members.alias("members")).where(enough)


def _finder(k: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search for the targets of one account and day (rows with ``asked``) among the cells
    in their window (the other rows): a row per subset of k cells that adds up. Cells are
    sorted by size; at most about ``most`` pairs or subsets are held at once."""

    # a closure, so that workers need nothing but it
    def ranges(lo, hi):
        """(row, place) for every place in lo..hi - 1 of every row, ``most`` or so at a time."""
        counts = np.maximum(hi - lo, 0)
        upto = np.cumsum(counts)
        at = 0
        while at < len(counts):
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + most, "right")))
            some = counts[at:end]
            row = np.repeat(np.arange(at, end), some)
            if len(row):
                yield row, np.arange(len(row)) - np.repeat(upto[at:end] - some - base, some) + lo[row]
            at = end

    def equal(sizes, rest):
        return np.searchsorted(sizes, rest, "left"), np.searchsorted(sizes, rest, "right")

    def two(sizes, whole):
        lo, hi = equal(sizes, whole - sizes)
        for p, q in ranges(np.maximum(lo, np.arange(len(sizes))), hi):
            yield np.stack([p, q], 1)

    def three(sizes, whole):
        for p, q in ranges(np.arange(len(sizes)), np.searchsorted(sizes, (whole - sizes) // 2, "right")):
            lo, hi = equal(sizes, whole - sizes[p] - sizes[q])
            for i, r in ranges(np.maximum(lo, q), hi):
                yield np.stack([p[i], q[i], r], 1)

    def between(sizes, lo, hi):
        """For each cell the places after it with which it adds up to lo..hi."""
        return np.maximum(np.searchsorted(sizes, lo - sizes, "left"), np.arange(len(sizes))), np.searchsorted(sizes, hi - sizes, "right")

    def four(sizes, whole):
        # the smaller pair adds up to at most half; slices of what it adds up to
        slices = [(0, whole // 2)]
        while slices:
            lo, hi = slices.pop()
            small, large = between(sizes, lo, hi), between(sizes, whole - hi, whole - lo)
            held = [int(np.maximum(b - a, 0).sum()) for a, b in (small, large)]
            if not min(held):
                continue
            if max(held) > most and lo < hi:
                middle = (lo + hi) // 2
                slices += [(lo, middle), (middle + 1, hi)]
                continue
            (p, q), (r, u) = ([np.concatenate(x) for x in zip(*ranges(*side), strict=True)] for side in (small, large))
            sums = sizes[r] + sizes[u]
            order = np.argsort(sums, kind="stable")
            r, u = r[order], u[order]
            for i, j in ranges(*equal(sums[order], whole - sizes[p] - sizes[q])):
                after = r[j] >= q[i]
                i, j = i[after], j[after]
                yield np.stack([p[i], q[i], r[j], u[j]], 1)

    find = {2: two, 3: three, 4: four}[k]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        kinds = {c: rows.schema.field(c).type for c in rows.column_names}
        asked = rows.column("asked").to_numpy()
        day, size, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("day", "size", "n"))
        account, t_day = (rows.column(c)[0] for c in ("account_id", "t_day"))
        cells_ = [x[~asked] for x in (day, size, n)]
        order = np.lexsort((cells_[1], cells_[0]))
        day_, size_, n_ = (x[order] for x in cells_)
        by_size = np.argsort(size_, kind="stable")
        sizes, there = size_[by_size], n_[by_size]
        for whole, many in zip(size[asked].tolist(), n[asked].tolist(), strict=True):
            for places in find(sizes[: np.searchsorted(sizes, whole, "left")], whole):
                enough = np.ones(len(places), bool)
                for i in range(k):
                    enough &= (places == places[:, i : i + 1]).sum(1) <= there[places[:, i]]
                members = np.sort(by_size[places[enough]], axis=1)  # by day, then size
                if not len(members):
                    continue
                given = [pa.repeat(account, len(members)), pa.repeat(t_day, len(members))]
                given += [pa.array(np.full(len(members), x), kinds[c]) for x, c in ((whole, "size"), (many, "n"))]
                for i in range(k):
                    given += [pa.array(x[members[:, i]]).cast(kinds[c]) for x, c in ((day_, "day"), (size_, "size"), (n_, "n"))]
                yield pa.RecordBatch.from_arrays(given, names=names)

    names = ["account_id", "t_day", "t_size", "t_n", *[f"{c}{i}" for i in range(k) for c in ("day", "size", "n")]]
    return search


def _searched(targets: DataFrame, parts: DataFrame, k: int, lo: int, hi: int, most: int = SLICE) -> DataFrame:
    """What `_candidates` gives, for wide windows: the cells of a window travel once for all
    targets of a day, and their pairs not at all."""
    asked = targets.select("account_id", F.col("day").alias("t_day"))
    near = parts.join(asked.distinct().withColumn("day", F.explode(F.sequence(F.col("t_day") + lo, F.col("t_day") + hi))), ["account_id", "day"])
    both = near.select("account_id", "t_day", F.lit(False).alias("asked"), "day", "size", "n").unionByName(
        targets.select("account_id", F.col("day").alias("t_day"), F.lit(True).alias("asked"), "day", "size", "n")
    )
    # by number: a search takes long for few bytes, by which tasks would be merged
    tasks = 4 * both.sparkSession.sparkContext.defaultParallelism
    fields = [("account_id", "account_id"), ("t_day", "t_day"), ("t_size", "size"), ("t_n", "n"), *[(f"{c}{i}", c) for i in range(k) for c in ("day", "size", "n")]]
    schema = StructType([StructField(name, both.schema[c].dataType) for name, c in fields])
    found = both.repartition(tasks, "account_id", "t_day").groupBy("account_id", "t_day").applyInArrow(_finder(k, most), schema)
    members = F.array(*[F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("day", "size", "n")]) for i in range(k)])
    return found.select("account_id", "t_day", "t_size", "t_n", members.alias("members"))


TARGET = ["account_id", "t_day", "t_size"]


def _dealt(found: DataFrame, k: int, rounds: int | None) -> DataFrame | None:
    """Deal cells to targets, round by round. Each round a target asks for the subset
    that ends nearest among those still whole; earlier (then smaller) targets come
    first, and a target gets as many as all its members have left. The first of an account
    always gets some, so the rounds end by themselves; ``rounds`` stops them earlier."""
    far = F.greatest(*[F.abs(F.col("members")[i]["day"] - F.col("t_day")) for i in range(k)])
    flat = F.flatten(F.transform("members", lambda m: F.array(m["day"], m["size"])))
    found = cut_lineage(found.select(*TARGET, "t_n", "members", far.alias("days"), flat.alias("subset")))
    if found.isEmpty():
        return None
    part = found.select(*TARGET, "t_n", "days", "subset", F.explode("members").alias("m"))
    part = part.groupBy(*TARGET, "t_n", "days", "subset", "m").agg(F.count("*").alias("times"))
    part = part.select(*TARGET, "t_n", "days", "subset", F.col("m.day").alias("day"), F.col("m.size").alias("size"), F.col("m.n").alias("n"), "times")
    # sure: one subset, and nothing in it is wanted elsewhere
    choices = found.groupBy(*TARGET).agg(F.count("*").alias("choices"))
    wanted = part.groupBy(*CELL).agg(F.count("*").alias("wanted"))
    alone = (F.col("t_n") == 1) & (F.col("choices") == 1) & (F.col("wanted") == 1) & (F.col("n") == F.col("times"))
    part = part.join(choices, TARGET).join(wanted, CELL).withColumn("alone", alone).drop("choices", "wanted")
    whole = Window.partitionBy(*TARGET, "subset")  # k rows
    part = cut_lineage(part.withColumn("sure", F.min("alone").over(whole)).drop("alone"))

    # what is sure needs no dealing, and no contested target or cell is in it
    zero = F.lit(0).cast("long")
    granted = part.where("sure").select(
        *part.columns, F.col("n").alias("left"), F.col("t_n").alias("open"), F.lit(1).cast("long").alias("got"), zero.alias("part_from"), zero.alias("target_from")
    )
    part = part.where("not sure")
    if part.isEmpty():
        return granted
    order = Window.partitionBy(*CELL).orderBy("t_day", "t_size").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(order), F.lit(0))
    state, turn = part.withColumn("left", F.col("n")).withColumn("open", F.col("t_n")), 0
    while rounds is None or turn < rounds:
        turn += 1
        whole = state.groupBy(*TARGET, "subset").agg(F.min(F.col("left") >= F.col("times")).alias("whole"), F.min("open").alias("open"), F.first("days").alias("days"))
        whole = whole.where("whole and open > 0")
        best = whole.groupBy(*TARGET).agg(F.min(F.struct("days", "subset")).alias("best"))
        asked = state.join(best.select(*TARGET, F.col("best.subset").alias("subset")), [*TARGET, "subset"])
        asked = asked.withColumn("queue", before(F.col("times") * F.col("open")))
        can = F.floor(F.greatest(F.lit(0), F.col("left") - F.col("queue")) / F.col("times"))
        got = asked.withColumn("can", F.least(F.col("open"), can)).groupBy(*TARGET).agg(F.min("can").alias("got")).where("got > 0")
        new = asked.drop("queue").join(got, TARGET)
        new = new.select(
            "*", (F.col("n") - F.col("left") + before(F.col("times") * F.col("got"))).alias("part_from"), (F.col("t_n") - F.col("open")).alias("target_from")
        )
        new = cut_lineage(new)
        if new.isEmpty():
            break
        granted = granted.unionByName(new)
        if turn % 16 == 0:
            granted = cut_lineage(granted)  # keeps the plan short
        if turn == rounds:
            break
        # what is not whole, or whose target is met, never comes back
        gone = new.groupBy(*CELL).agg(F.sum(F.col("times") * F.col("got")).alias("gone"))
        met = new.groupBy(*TARGET).agg(F.max("got").alias("met"))
        state = state.join(whole.select(*TARGET, "subset"), [*TARGET, "subset"], "left_semi").join(gone, CELL, "left").join(met, TARGET, "left")
        state = state.withColumn("left", F.col("left") - F.coalesce("gone", zero)).withColumn("open", F.col("open") - F.coalesce("met", zero)).drop("gone", "met")
        state = cut_lineage(state.where("open > 0").select(*part.columns, "left", "open"))
        if state.isEmpty():
            break
    return granted


def match_subsets(
    targets: DataFrame, parts: DataFrame, lo: int, hi: int, most: int = MOST, bounds: dict[int, int] | None = None, rounds: int | None = None,
    joined: dict[int, int] | None = None,
) -> DataFrame:
    """Pairs (target_id, part_id, k, days, sure) for targets and parts of
    (account_id, day, size, id). Small subsets first: k + 1 parts are tried for what k
    left over. ``days`` is the largest distance in the subset, ``sure`` when the target
    had one subset and its rows could go nowhere else. Each row is used once. Every target
    is tried, unless ``bounds`` says up to how many cells in its window, and rounds go on
    until nothing is dealt, unless ``rounds`` says how many. ``joined`` is `JOINED`."""
    joined = JOINED if joined is None else joined
    ranked_targets = positions(targets.where("size > 0").select(*CELL, "id"), CELL, "id", name="rank")
    ranked_parts = positions(parts.where("size > 0").select(*CELL, "id"), CELL, "id", name="rank")
    left_targets, left_parts = cells(ranked_targets), cells(ranked_parts)
    left_targets = cut_lineage(with_reach(left_targets, left_parts, lo, hi).where("reach > 0").withColumn("used", F.lit(0).cast("long")))
    left_parts = cut_lineage(left_parts.join(left_targets.select("account_id").distinct(), "account_id", "left_semi").withColumn("used", F.lit(0).cast("long")))
    widest = left_targets.agg(F.max("reach")).first()[0] or 0
    found = []
    for k in range(2, most + 1):
        tried, there = left_targets.where("n > 0"), left_parts.where("n > 0").drop("used")
        if bounds is not None:
            tried = tried.where(F.col("reach") <= bounds[k])
        narrow, wide = (tried.where(x).drop("reach", "used") for x in (F.col("reach") <= joined[k], F.col("reach") > joined[k]))
        subsets = _candidates(narrow, there, k, lo, hi)
        if widest > joined[k]:
            subsets = subsets.unionByName(_searched(wide, there, k, lo, hi))
        granted = _dealt(subsets, k, rounds)
        if granted is None:
            continue
        # places are counted over all rows of a cell, also those an earlier k dealt out
        granted = granted.join(left_targets.select(*[F.col(c).alias(t) for c, t in zip(CELL, TARGET, strict=True)], F.col("used").alias("t_used")), TARGET)
        granted = granted.join(left_parts.select(*CELL, F.col("used").alias("p_used")), CELL)
        granted = cut_lineage(granted.withColumn("target_from", F.expr("target_from + t_used")).withColumn("part_from", F.expr("part_from + p_used")))
        found.append(granted.withColumn("k", F.lit(k)))
        if k < most:
            met = granted.select(*TARGET, "subset", "target_from", "got").distinct().groupBy(*[F.col(t).alias(c) for c, t in zip(CELL, TARGET, strict=True)]).agg(F.sum("got").alias("gone"))
            gone = granted.groupBy(*CELL).agg(F.sum(F.expr("times * got")).alias("gone"))
            left_targets, left_parts = (
                cut_lineage(
                    df.join(less, CELL, "left").withColumn("gone", F.coalesce("gone", F.lit(0).cast("long")))
                    .withColumn("n", F.expr("n - gone")).withColumn("used", F.expr("used + gone")).drop("gone")
                )
                for df, less in ((left_targets, met), (left_parts, gone))
            )
    if not found:
        return targets.select(F.col("id").alias("target_id"), F.col("id").alias("part_id"), F.lit(2).alias("k"), F.lit(0).cast("long").alias("days"), F.lit(True).alias("sure")).limit(0)
    dealt = reduce(DataFrame.unionByName, found)
    rows = ranked_targets.select(*[F.col(c).alias(t) for c, t in zip(CELL, TARGET, strict=True)], F.col("id").alias("target_id"), F.col("rank").alias("t_rank"))
    rows = rows.join(dealt, TARGET).where("t_rank > target_from and t_rank <= target_from + got")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    rows = rows.withColumn("rank", F.expr("part_from + (t_rank - target_from - 1) * times + i"))
    return rows.join(ranked_parts.select(*CELL, "rank", F.col("id").alias("part_id")), [*CELL, "rank"]).select(
        "target_id", "part_id", "k", F.col("days").cast("long").alias("days"), "sure"
    )


def open_targets(targets: DataFrame, parts: DataFrame, matches: DataFrame, lo: int, hi: int, most: int = MOST, bounds: dict[int, int] | None = None) -> DataFrame:
    """Targets without a partner, with the cells in their window (``reach``) and the
    largest number of parts that was tried for them under ``bounds`` (1 if not even pairs
    were); without any, ``most``."""
    left = targets.where("size > 0").join(matches.select(F.col("target_id").alias("id")), "id", "left_anti")
    near = with_reach(left, cells(parts), lo, hi)
    tried = F.lit(most if bounds is None else 1)
    for k in range(2, most + 1) if bounds is not None else ():
        tried = F.when(F.col("reach") <= bounds[k], F.lit(k)).otherwise(tried)
    return near.select("id", *CELL, "reach", tried.alias("tried"))
