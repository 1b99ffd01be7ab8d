"""Ranks, running totals and neighbours that survive a hot group.

A window function sorts its whole group in one task. When one account (or the
whole register) holds a third of all rows that task never ends, so rows are
sorted once by range over (keys, date, id), which cuts a large group wherever
its rows lie. A narrow pass then adds up within each partition. Only groups cut
by a partition's edge need more: the totals of the first and last group of each
partition, two rows of it at most, are added to what comes later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _narrow(df: DataFrame, keys: list[str], sums: list[str], carry: list[str]) -> DataFrame:
    """Per partition of sorted rows: ``_part``; ``_first`` and ``_last``, the place
    at an edge of the partition; ``_run``, 1 in the first group; ``_end``, the last
    row of its group; inclusive sums ``_local_<c>`` and values of the row before
    and behind, ``_up_<c>`` and ``_down_<c>``, within the group and the partition."""
    added = df.select(
        "*",
        F.lit(0).alias("_part"),
        *[F.lit(False).alias(c) for c in ("_first", "_last", "_end")],
        F.lit(0).cast("long").alias("_run"),
        *[F.lit(0).cast("long").alias(f"_local_{c}") for c in sums],
        *[F.when(F.lit(False), F.col(c)).alias(f"{side}_{c}") for side in ("_up", "_down") for c in carry],
    )
    at = {c: i for i, c in enumerate(df.columns)}
    names = added.columns

    # a closure, so that workers need nothing but it
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = None  # the last row of the batch before this one, as a batch
        totals, groups = [0] * len(sums), 0

        def changes(batch, other):
            """Does each row begin a group, ``other`` being the row before the first?"""
            new = np.zeros(len(batch), bool)
            new[0] = other is None
            for k in keys:
                column = batch.column(at[k])
                new[1:] |= column[1:].to_numpy(zero_copy_only=False) != column[:-1].to_numpy(zero_copy_only=False)
                new[0] |= other is not None and other.column(at[k])[0].as_py() != column[0].as_py()
            return new

        def shifted(column, ends, one, down):
            """The column moved by one row, ``one`` at its open end, null past ends."""
            kind = column.type
            one = pa.nulls(1, kind) if one is None else one
            parts = [column[1:], one] if down else [one, column[:-1]]
            moved = pa.concat_arrays([x.cast(kind) for x in parts])
            return pc.if_else(pa.array(ends), pa.nulls(len(column), kind), moved)

        def done(batch, behind):
            nonlocal before, groups
            n = len(batch)
            new = changes(batch, before)
            end = np.append(new[1:], behind is None or changes(behind, batch.slice(n - 1))[0])
            number = groups + np.cumsum(new)
            groups = int(number[-1])
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32))]
            edge = np.zeros(n, bool)
            edge[0] = before is None
            columns.append(pa.array(edge))
            edge = np.zeros(n, bool)
            edge[-1] = behind is None
            columns += [pa.array(edge), pa.array(end), pa.array(number.astype(np.int64))]
            for i, c in enumerate(sums):
                run_ = np.concatenate([[0], np.cumsum(batch.column(at[c]).to_numpy(zero_copy_only=False))])
                own = run_[1:] - np.where(start < 0, -totals[i], run_[np.maximum(start, 0)])
                totals[i] = int(own[-1])
                columns.append(pa.array(own.astype(np.int64)))
            for c in carry:
                one = None if before is None else before.column(at[c])
                columns.append(shifted(batch.column(at[c]), new, one, False))
            for c in carry:
                one = None if behind is None else behind.column(at[c])[:1]
                columns.append(shifted(batch.column(at[c]), end, one, True))
            before = batch.slice(n - 1)
            return pa.RecordBatch.from_arrays(columns, names=names)

        held = None
        for batch in batches:
            if len(batch):
                if held is not None:
                    yield done(held, batch.slice(0, 1))
                held = batch
        if held is not None:
            yield done(held, None)

    return cut_lineage(df.mapInArrow(run, added.schema))


def _sorted(df: DataFrame, order: list[str], tasks: int | None) -> DataFrame:
    ranged = df.repartitionByRange(*([tasks] if tasks else []), *order)
    return ranged.sortWithinPartitions(*order)


def running(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    measures: dict[str, Column],
    date_col: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of whole numbers in (date_col, id_col) order
    within ``keys``. No key may be null. ``tasks``: partitions of the sort, else as
    the session says. The sorted rows are written out."""
    keys = list(keys)
    sums = [f"_m{i}" for i in range(len(measures))]
    rows = df.select("*", *[F.coalesce(m.cast("long"), F.lit(0)).alias(c) for c, m in zip(sums, measures.values(), strict=True)])
    placed = _narrow(_sorted(rows, [*keys, *([date_col] if date_col else []), id_col], tasks), keys, sums, [])
    # the last row of a partition's first and last group holds that group's total
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = placed.where("_end and (_run = 1 or _last)").select(
        *keys, "_part", *[F.coalesce(F.sum(f"_local_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums]
    )
    # one row per partition at most: the first group of it, if that began earlier
    offsets = edges.where(" or ".join(f"_before_{c} != 0" for c in sums))
    return placed.join(F.broadcast(offsets), [*keys, "_part"], "left").select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_local_{c}") + F.coalesce(f"_before_{c}", F.lit(0))).alias(name) for c, name in zip(sums, measures, strict=True)],
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    date_col: str | None = None,
    name: str = "position",
    tasks: int | None = None,
) -> DataFrame:
    """Add the 1-based place of each row in its group."""
    return running(df, keys, id_col, {name: F.lit(1)}, date_col, tasks)


def with_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    date_col: str,
    carry: Sequence[str],
    tasks: int | None = None,
) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>`` for each carried column, prev being the
    later row in (date, id) order as in a register that lists newest first.

    Only the first and last row of a partition look further, at the nearest rows of
    the partitions beside it."""
    keys, carry = list(keys), list(carry)
    placed = _narrow(_sorted(df, [*keys, date_col, id_col], tasks), keys, [], carry)
    edge = placed.where("_first or _last").select(
        "_part", "_first", "_last", *keys, *[F.col(c).alias(f"_own_{c}") for c in carry]
    )
    order = Window.partitionBy(F.lit(0)).orderBy("_part", F.desc("_first"))  # two rows per partition at most
    same = [F.lit(True), *[F.lag(k).over(order) == F.col(k) for k in keys]]
    other = [F.lit(True), *[F.lead(k).over(order) == F.col(k) for k in keys]]
    above, below = same[0], other[0]
    for a, b in zip(same, other, strict=True):
        above, below = above & a, below & b
    edge = edge.select(
        "_part",
        "_first",
        "_last",
        *[F.when(F.col("_first") & above, F.lag(f"_own_{c}").over(order)).alias(f"_far_up_{c}") for c in carry],
        *[F.when(F.col("_last") & below, F.lead(f"_own_{c}").over(order)).alias(f"_far_down_{c}") for c in carry],
    )
    return placed.join(F.broadcast(edge), ["_part", "_first", "_last"], "left").select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_down_{c}", f"_far_down_{c}").alias(f"prev_{c}") for c in carry],
        *[F.coalesce(f"_up_{c}", f"_far_up_{c}").alias(f"next_{c}") for c in carry],
    )


def lookup(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    dim_key: str,
    row_id: str,
    salt: int = 1024,
) -> DataFrame:
    """Left join on a nullable key. Null keys would all hash to one task, so they
    are spread over negative stand-ins that no dimension row carries."""
    spread = -1 - F.pmod(F.xxhash64(F.col(row_id)), F.lit(salt))
    keyed = df.withColumn("_key", F.coalesce(F.col(key), spread))
    right = dim.withColumnRenamed(dim_key, "_dim_key")
    return keyed.join(right, F.col("_key") == F.col("_dim_key"), "left").drop("_key", "_dim_key")
