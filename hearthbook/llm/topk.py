"""Exact top-k search by inner product with a pivot-distance index.

Inner products are distances in one more dimension: with M the largest norm, a vector
x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0); all lifted vectors then
have norm M and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Every vector is keyed by its
nearest lifted pivot and its distance r to it, sorted, and cut into *annuli* of one
pivot and at most ``ANNULUS`` rows. A query first searches the annulus it lies in,
which gives a k-th best score. By the triangle inequality an annulus with r in [a, b]
at pivot distance d holds nothing nearer than max(a - d, d - b, 0), so annuli whose
bound is below that score are never visited; those that remain are expanded ring by
ring under the same test. Pivots come from a bounded sample and decide speed only:
every vector is indexed and the result is exact.

Hot vectors are no trouble: rows of one pivot and one distance are split by count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, ship, temporary, written

PIVOTS = 48
SAMPLE = 2048
ANNULUS = 8192
RING = 1024
QUERIES = 8192

VECTOR = "row bigint, id bigint, is_query boolean, dim int, norm double, vector binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector is null, empty, or
    holds a null or a component that is not finite."""
    inf = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows and turns components into bytes, 4 or 8 each. Runs before a
    written table, so a row keeps its number."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        vectors = [np.array(v, np.int64) for v in batch.column(2).to_pylist()]
        norms = [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in vectors]
        packed = [v.astype("<i4").tobytes() if len(v) == 0 or abs(v).max() < 2**31 else v.tobytes() for v in vectors]
        n = len(vectors)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array([len(v) for v in vectors], pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())],
            names=["row", "id", "is_query", "dim", "norm", "vector"],
        )
        row += n


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of one dimension."""
    out = [np.frombuffer(v.as_py(), "<i4" if len(v.as_py()) == 4 * dim else "<i8") for v in column]
    return np.array(out, np.int64).reshape(len(out), dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products, by float64 where that is exact and else by Python's whole
    numbers; what no long can hold is cut to its ends."""
    a, b = q.astype(np.float64), x.astype(np.float64)
    if len(q) == 0 or len(x) == 0 or np.sqrt((a**2).sum(1).max() * (b**2).sum(1).max()) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    rows = x.tolist()
    sums = [[sum(i * j for i, j in zip(v, w, strict=True)) for w in rows] for v in q.tolist()]
    return np.array([[min(max(s, -(2**63)), 2**63 - 1) for s in own] for own in sums], np.int64)


def _pivots(sample: dict[int, np.ndarray], largest: float, count: int) -> dict[int, np.ndarray]:
    """Lifted pivots of each dimension: a few rounds of k-means over the sample."""
    out = {}
    for dim, x in sample.items():
        x = _lift(x, largest)
        centre = x[np.unique(np.linspace(0, len(x) - 1, min(count, len(x))).astype(int))]
        for _ in range(5):
            near = _distance(x, centre).argmin(axis=1)
            centre = np.array([x[near == i].mean(axis=0) if (near == i).any() else centre[i] for i in range(len(centre))])
        out[dim] = centre
    return out


def _lift(x: np.ndarray, largest: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0, largest**2 - (x**2).sum(axis=1)))])


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T))


def margin(largest: float) -> tuple[float, float]:
    """What rounding may take from a distance and from a score, with room to spare:
    next to nothing for usual vectors, and in proportion to the largest norm."""
    return 1e-6 * largest, 0.5 + 1e-13 * largest * largest


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def build_index(vectors: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, dict[int, np.ndarray], float]:
    """The index rows (annulus, row, id, is_query, dim, norm, vector, pivot, r), the
    pivots and the largest norm. ``vectors`` is (id, is_query, vector of longs)."""
    rows = written(map_batches(vectors, _pack, VECTOR), "vectors")
    largest = float(rows.agg(F.max("norm")).first()[0] or 0.0)
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "vector").collect():
        sample.setdefault(r["dim"], []).append(pa.scalar(bytes(r["vector"]), pa.binary()))
    centres = _pivots({d: matrix(v, d) for d, v in sample.items()}, largest, pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, r = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, at in _by_dim(batch):
                x = _lift(matrix(batch.column("vector").take(pa.array(at)), dim), largest)
                d = _distance(x, centres.get(dim, np.zeros((1, dim + 1))))
                pivot[at], r[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(r)], names=[*batch.schema.names, "pivot", "r"])

    keyed = written(map_batches(rows, key, VECTOR + ", pivot int, r double"), "keyed")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartitionByRange(parts, "dim", "pivot", "r", "row").sortWithinPartitions("dim", "pivot", "r", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, filled = (TaskContext.get().partitionId() << 32) - 1, None, 0
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, own in enumerate(zip(batch.column("dim").to_pylist(), batch.column("pivot").to_pylist(), strict=True)):
                if own != last or filled >= ANNULUS:
                    number, last, filled = number + 1, own, 0
                out[i] = number
                filled += 1
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], names=["annulus", *batch.schema.names])

    return written(map_batches(keyed, cut, "annulus bigint, " + VECTOR + ", pivot int, r double"), "index"), centres, largest


FOUND = "query bigint, query_id bigint, id bigint, score bigint"


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score down, id up)."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _ids(column) -> np.ndarray:
    """Identifiers for sorting; a null one comes last."""
    return np.array([2**63 - 1 if v is None else v for v in column.to_pylist()], np.int64)


def _rows(found: list[tuple]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query", "query_id", "id", "score"), columns, strict=True)})


def search(vectors: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """The k best other rows of every query: query (row number), query_id, rank, id,
    score; ties go to the smaller id, a null id last.

    ``vectors`` holds id, is_query and vector (longs; a null vector takes no part).
    Only vectors of equal dimension are compared. Repeated rows are rows of their own:
    a query leaves out itself, not its copies. Without other rows it has no result. A
    score that no long can hold is cut to the largest or smallest one."""
    with temporary():
        return written(_search(vectors, k, pivots), "found", keep=True)


def _search(vectors: DataFrame, k: int, pivots: int) -> DataFrame:
    ship(vectors.sparkSession)
    usable = vectors.select("id", F.coalesce("is_query", F.lit(False)).alias("is_query"), "vector").where("vector is not null")
    index, centres, largest = build_index(usable, pivots)

    def at_home(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x, ids = matrix(table.column("vector"), dim), _ids(table.column("id"))
        own = table.column("id").to_pylist()
        row = table.column("row").to_numpy()
        asks = np.flatnonzero(table.column("is_query").to_numpy(zero_copy_only=False))
        found = []
        for some in np.array_split(asks, max(1, len(asks) * len(x) // 4_000_000)):
            for i, scores in zip(some, products(x[some], x), strict=True):
                others = np.delete(np.arange(len(x)), i)
                for j in others[_best(scores[others], ids[others], k)]:
                    found.append((int(row[i]), own[i], own[j], int(scores[j])))
        return _rows(found)

    home = written(index.groupBy("annulus").applyInArrow(at_home, FOUND), "home")
    reached = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for dim, at in _by_dim(batch):
                q = matrix(batch.column("vector").take(pa.array(at)), dim)
                lifted = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
                for i, d in zip(at, _distance(lifted, centres.get(dim, np.zeros((1, dim + 1)))), strict=True):
                    out[i] = d.tolist()
            keep = [batch.column(n) for n in ("annulus", "row", "id", "dim", "norm")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.list_(pa.float64()))], names=["home", "row", "id", "dim", "norm", "d"])

    asks = index.where("is_query").select("annulus", "row", "id", "dim", "norm", "vector")
    bounds = map_batches(asks, distances, "home bigint, row bigint, id bigint, dim int, norm double, d array<double>")
    bounds = bounds.join(reached.withColumnRenamed("query", "row"), "row", "left")
    bounds = bounds.withColumn("least", F.when(F.col("n") >= k, F.col("least")))
    bounds = bounds.select("home", "row", "dim", "norm", "least", F.posexplode("d").alias("pivot", "d"))
    annuli = index.groupBy("annulus", "dim", "pivot").agg(F.min("r").alias("a"), F.max("r").alias("b"))
    room, slack = margin(largest)
    gap = F.greatest(F.col("a") - F.col("d") - room, F.col("d") - F.col("b") - room, F.lit(0.0))
    best = (F.col("norm") * F.col("norm") + largest * largest - gap * gap) / 2 + slack
    visits = bounds.join(annuli, ["dim", "pivot"]).where(
        (F.col("home") != F.col("annulus")) & (F.col("least").isNull() | (best >= F.col("least")))
    )
    visits = written(visits.select("annulus", "row", "least", "d"), "visits")

    n_asks = index.where("is_query").count()
    chunks = max(1, -(-n_asks // QUERIES))
    chunk = F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")
    left = visits.join(asks.select("row", "id", "vector", "dim", "norm"), "row").withColumn("chunk", chunk)
    left = left.toDF(*left.columns)  # names of its own, as both sides stem from the index
    visited = visits.select("annulus", chunk.alias("chunk")).distinct()
    right = index.join(visited, "annulus")

    def expand(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return _rows([])
        dim = rows.column("dim")[0].as_py()
        rows = rows.sort_by("r")
        r = rows.column("r").to_numpy()
        q, d = matrix(asked.column("vector"), dim), asked.column("d").to_numpy()
        norm = asked.column("norm").to_numpy()
        number, query_id = asked.column("row").to_pylist(), asked.column("id").to_pylist()
        least = np.array([-np.inf if v is None else v for v in asked.column("least").to_pylist()])
        starts = np.arange(0, len(r), RING)
        a, b = r[starts], r[np.minimum(starts + RING, len(r)) - 1]
        gaps = np.maximum(np.maximum(a - d[:, None], d[:, None] - b) - room, 0)
        bound = (norm[:, None] ** 2 + largest**2 - gaps**2) / 2 + slack
        kept: list[list[tuple[int, int, int | None]]] = [[] for _ in number]
        for ring in np.argsort(-bound.max(axis=0), kind="stable"):  # nearest rings first
            active = np.flatnonzero(bound[:, ring] >= least)
            if not len(active):
                continue
            part = rows.slice(int(starts[ring]), RING)
            x, ids, own = matrix(part.column("vector"), dim), _ids(part.column("id")), part.column("id").to_pylist()
            for i, scores in zip(active, products(q[active], x), strict=True):
                near = np.flatnonzero(scores >= least[i])
                if len(near):
                    near = near[_best(scores[near], ids[near], k)]
                    kept[i] = sorted(kept[i] + [(-int(scores[j]), int(ids[j]), own[j]) for j in near], key=lambda t: t[:2])[:k]
                    if len(kept[i]) == k:
                        least[i] = max(least[i], -kept[i][-1][0])
        return _rows([(n, qid, one, -s) for n, qid, best in zip(number, query_id, kept, strict=True) for s, _, one in best])

    away = left.groupBy("annulus", "chunk").cogroup(right.groupBy("annulus", "chunk")).applyInArrow(expand, FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query", "query_id", "rank", "id", "score")
