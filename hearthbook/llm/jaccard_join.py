"""N-gram Jaccard join: near-duplicate groups of whole texts.

A text is the set of its distinct word n-grams; two texts link when 100 |X and Y| is
at least ``percent`` |X or Y|. The join is by universe partitioning:

* Sets fall into size bands so that partners are in the same or the next band; the
  band bounds their symmetric difference by some H. A hash deals the universe of
  n-grams into H + 1 + s segments, so that linked sets agree on s + 1 segments.
* *Allocation by cost.* The s costliest segments of a set - those with the fewest
  n-grams, which many sets share - are left out. The order depends on a segment's
  content alone, so of s + 1 shared segments one is kept by both sides. Where H = 1,
  for small sets, the whole set and its one-deletion neighbourhood are indexed
  instead: few keys and far more selective than halves.
* Sets that agree on a key form a group. Every linked pair is in some group.

Copies (equal sets) are one node throughout. Groups are not expanded into pairs: a
node is first verified against the leader it shares most groups with, and connected
components follow. Only groups that then still span several components are looked
at again, and only across components: small ones by their distinct pairs, large ones
in blocks whose intersections are one matrix product and which emit links alone. So
all links between components are found, and the components are exact.

Keys travel as packed arrays, one per bucket and batch. A batch sends one member of
a key's group to the bucket and ties the others to it, so a key that a third of all
rows share reaches its bucket once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, map_batches, temporary, utf8, written
from .components import connected
from .suffix_dedup import text_key

BLOCK_BYTES = 1 << 18
HELD_KEYS = 400_000
BUCKET_ROWS = 500_000
SMALL_GROUP = 24
BLOCK_MEMBERS = 512

A1, A2, A3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring values fall far apart."""
    x = (x ^ (x >> np.uint64(30))) * A2
    x = (x ^ (x >> np.uint64(27))) * A3
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, A1), np.full(n, np.uint64(pow(int(A1), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * A1)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit n-gram hashes of every row. Words are what stands
    between ASCII blanks, A-Z in lower case; a row of fewer words than ``width`` has
    one n-gram, all of them, and a row without words none."""
    n_rows, n = len(offsets) - 1, len(data)
    if not n:
        return [np.zeros(0, np.uint64)] * n_rows
    data = LOWER[data]
    word = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    up, down = _powers(1 << max(19, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=total[1:])
    h = mixed((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    at = np.searchsorted(begins, offsets)
    grams = np.zeros(0, np.uint64)
    if len(h) >= width:
        grams = h[: len(h) - width + 1].copy()
        for j in range(1, width):
            grams = mixed(grams * A1 + h[j : len(h) - width + 1 + j])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mixed(one * A3 + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(own: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    digest = blake2b(own.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


@dataclass(frozen=True)
class Scheme:
    """How sets of one band meet those of the same and the next band."""

    number: int
    differ: int  # the largest symmetric difference of a linked pair
    segments: int
    spare: int  # segments left out per set

    @property
    def kept(self) -> int:
        return self.segments - self.spare


@lru_cache(maxsize=8)
def band_starts(percent: int) -> tuple[int, ...]:
    """Least sizes of the bands: the next band begins above 100 / percent times the
    largest size of the last one, so partners are at most one band apart."""
    starts = [1, 2]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    return tuple(starts)


@lru_cache(maxsize=4096)
def scheme(number: int, percent: int) -> Scheme:
    starts = band_starts(percent)
    largest = starts[number + 1] - 1
    differ = (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)
    # leave out so many segments that the smallest sets drop all those of less than two
    # n-grams (Poisson), with some room
    spare, most = 1, 1 + (differ + 1) // 2
    while spare < most:
        m = differ + 1 + spare
        mean = starts[number] / m
        if spare >= 1 + 1.2 * m * exp(-mean) * (1 + mean):
            break
        spare += 1
    return Scheme(number, differ, differ + 1 + spare, spare)


def keys(sets: list[np.ndarray], plan: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the segments of all sets under one scheme."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    size = np.array([len(s) for s in sets])
    if plan.differ == 0 or not len(size):
        return none  # only equal sets can link, and those are one node
    token = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    tag = mixed(np.array([plan.number + 1], np.uint64) * A3)[0]
    value = mixed(token * A2 + tag)
    if plan.differ == 1:
        whole = np.add.reduceat(value, np.concatenate([[0], np.cumsum(size)[:-1]]))
        return np.concatenate([np.arange(len(sets)), row]), mixed(np.concatenate([whole, whole[row] - value]) + tag)
    m = plan.segments
    place = (mixed(token + tag) >> np.uint64(33)).astype(np.int64) % m + row * m
    content = np.zeros(len(sets) * m, np.uint64)
    np.add.at(content, place, value)
    count = np.bincount(place, minlength=len(content)).reshape(-1, m)
    content = mixed(content + mixed(np.tile(np.arange(m, dtype=np.uint64), len(sets)) * A1 + tag)).reshape(-1, m)
    # fewest n-grams first, then by content: an order that both sides of a pair share
    cost = (np.minimum(count, 1023).astype(np.uint64) << np.uint64(54)) | (content >> np.uint64(10))
    kept = np.argpartition(cost, plan.spare - 1, axis=1)[:, plan.spare :]
    return np.repeat(np.arange(len(sets)), kept.shape[1]), np.take_along_axis(content, kept, axis=1).ravel()


def all_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) under both schemes that a set takes part in."""
    band = np.searchsorted(band_starts(percent), [len(s) for s in sets], "right") - 1
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b in np.unique(band[band >= 0]):
        own = np.flatnonzero(band == b)
        for number in (b, b - 1):
            if number >= 0:
                row, key = keys([sets[i] for i in own], scheme(int(number), percent))
                rows.append(own[row])
                out.append(key)
    return np.concatenate(rows), np.concatenate(out)


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = utf8(batch.column("text"))
    for first, last in blocks(offsets, BLOCK_BYTES, 4096):
        own = offsets[first : last + 1]
        yield first, shingle_sets(data[own[0] : own[-1]], own - own[0], width)


def _nodes(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, n, node, check) of every row; a column ``key`` of the texts goes along."""
    more = ["key"] if "key" in texts.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, check = [], [], []
            for _, sets in _sets(batch, width):
                n += [len(s) for s in sets]
                both = [node_of(s, seed) for s in sets]
                node += [b[0] for b in both]
                check += [b[1] for b in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), *map(batch.column, more)],
                names=["id", "n", "node", "check", *more],
            )

    kind = dict(texts.dtypes)["id"]
    return map_batches(texts, run, f"id {kind}, n bigint, node bigint, check bigint" + (", key binary" if more else ""))


KEYED = np.dtype([("key", "<u8"), ("node", "<i8")])
#: What travels: within a bucket 32 bits of the key do; a clash is one more candidate.
PAIRS = np.dtype([("key", "<u4"), ("node", "<i8")])


def _unique(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs["node"], pairs["key"]))]
    if not len(pairs):
        return pairs
    return pairs[np.concatenate([[True], (pairs["key"][1:] != pairs["key"][:-1]) | (pairs["node"][1:] != pairs["node"][:-1])])]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.concatenate([first, [len(key)]]))


def _packed_keys(texts: DataFrame, width: int, percent: int, seed: int, buckets: int) -> DataFrame:
    """(bucket, pairs): packed (key, node) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, sets in _sets(batch, width):
                node = np.array([node_of(s, seed)[0] for s in sets], np.int64)
                row, key = all_keys(sets, percent)
                held.append(np.rec.fromarrays([key, node[row]], dtype=KEYED))
                if sum(len(h) for h in held) >= HELD_KEYS:
                    yield by_bucket(_unique(np.concatenate(held)))
                    held = []
        if held:
            yield by_bucket(_unique(np.concatenate(held)))

    def by_bucket(pairs: np.ndarray) -> pa.RecordBatch:
        bucket = (mixed(pairs["key"] + A2) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pairs, bucket = pairs[order], bucket[order]
        first, size = _runs(bucket)
        raw, width_ = np.rec.fromarrays([pairs["key"] >> np.uint64(32), pairs["node"]], dtype=PAIRS).tobytes(), PAIRS.itemsize
        parts = [raw[width_ * a : width_ * (a + s)] for a, s in zip(first.tolist(), size.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(parts, pa.binary())], names=["bucket", "pairs"])

    return map_batches(texts, run, "bucket bigint, pairs binary")


def _groups(packed: DataFrame) -> DataFrame:
    """(bucket, pairs): what belongs to a key of at least two nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def flush() -> pa.RecordBatch:
            pairs = _unique(np.concatenate(held))
            first, size = _runs(pairs["key"])
            kept = pairs[np.repeat(size > 1, size)]
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([kept.tobytes()], pa.binary())], names=["bucket", "pairs"])

        for batch in batches:
            for bucket, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != last and held:
                    yield flush()
                    held = []
                last = bucket
                held.append(np.frombuffer(pairs.as_py(), PAIRS))
        if held:
            yield flush()

    return map_batches(packed.repartition("bucket").sortWithinPartitions("bucket"), run, "bucket bigint, pairs binary")


def _read_groups(groups: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` of the bucket and its (sorted) pairs gives columns."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("pairs"), strict=True):
                columns = fn(bucket, np.frombuffer(raw.as_py(), PAIRS))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return map_batches(groups, run, schema)


LED = np.dtype([("node", "<i8"), ("leader", "<i8"), ("groups", "<i8")])


def _summed(led: np.ndarray) -> np.ndarray:
    """One entry per (node, leader), with the number of groups."""
    led = led[np.lexsort((led["leader"], led["node"]))]
    if not len(led):
        return led
    first = np.flatnonzero(np.concatenate([[True], (led["node"][1:] != led["node"][:-1]) | (led["leader"][1:] != led["leader"][:-1])]))
    out = led[first]
    out["groups"] = np.add.reduceat(led["groups"], first)
    return out


def _leaders(pairs: np.ndarray) -> np.ndarray:
    """The first node of a group leads all of it."""
    first, size = _runs(pairs["key"])
    leader = np.repeat(pairs["node"][first], size)
    return _summed(np.rec.fromarrays([pairs["node"], leader, np.ones(len(pairs), np.int64)], dtype=LED))


def _stars(groups: DataFrame, parts: int) -> DataFrame:
    """(node, leader) for every node of a group: the leader it shares most groups
    with, null for a node that only leads. Entries travel packed, by node."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("pairs"):
                led = _leaders(np.frombuffer(raw.as_py(), PAIRS))
                part = (mixed(led["node"].view(np.uint64) + A3) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                led, part = led[order], part[order]
                first, size = _runs(part)
                packed = [led[x : x + n].tobytes() for x, n in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(packed, pa.binary())], names=["part", "led"])

    def best(held: list[np.ndarray]) -> pa.RecordBatch:
        led = _summed(np.concatenate(held))
        shared = np.where(led["leader"] == led["node"], 0, led["groups"])
        led, shared = (x[np.lexsort((led["leader"], shared, led["node"]))] for x in (led, shared))
        last = np.flatnonzero(np.concatenate([led["node"][1:] != led["node"][:-1], [True]]))
        led, shared = led[last], shared[last]
        return pa.RecordBatch.from_arrays([pa.array(led["node"]), pa.array(led["leader"], mask=shared == 0)], names=["node", "leader"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if part != now and held:
                    yield best(held)
                    held = []
                now = part
                held.append(np.frombuffer(raw.as_py(), LED))
        if held:
            yield best(held)

    dealt = map_batches(groups, deal, "part bigint, led binary")
    return map_batches(dealt.repartition("part").sortWithinPartitions("part"), gather, "node bigint, leader bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` that link."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a")
    return map_batches(joined.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def _across(members: DataFrame) -> DataFrame:
    """(a, b, key, node, component): from (key, node, component) sorted by key, the
    pairs across components of small groups in a and b, and the members of large
    ones in key, node and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, large = None, [], False
        pairs: set[tuple[int, int]] = set()
        rows: list[tuple] = []

        def done() -> None:
            if not large:
                for i, (x, cx) in enumerate(group):
                    for y, cy in group[:i]:
                        if cx != cy:
                            pairs.add((x, y) if x < y else (y, x))

        def flush() -> pa.RecordBatch:
            both = [(a, b, None, None, None) for a, b in sorted(pairs)] + rows
            columns = list(zip(*both, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "key", "node", "component"])

        for batch in batches:
            for k, node, component in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    done()
                    key, group, large = k, [], False
                if large:
                    rows.append((None, None, key, node, component))
                    continue
                group.append((node, component))
                if len(group) > SMALL_GROUP:
                    large = True
                    rows += [(None, None, key, n, c) for n, c in group]
            if len(pairs) + len(rows) > 100_000:
                yield flush()
                pairs, rows = set(), []
        done()
        yield flush()

    return map_batches(members, run, "a bigint, b bigint, key bigint, node bigint, component bigint")


def cross_links(nodes: np.ndarray, component: np.ndarray, sets: list[np.ndarray], other: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """The links between members of different components, by one matrix product over
    the n-grams that at least two members have. ``other`` marks the second block."""
    size = np.array([len(s) for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at, minlength=len(token)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    row, column = row[keep], number[at[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        present = np.zeros((len(sets), 4096), np.float32)
        present[row[a:b], column[a:b] - start] = 1
        both += present @ present.T
    linked = 100 * both >= percent * (size[:, None] + size[None] - both)
    linked &= component[:, None] != component[None]
    if other is not None:
        linked &= ~other[:, None] & other[None]
    return [(int(nodes[i]), int(nodes[j])) for i, j in zip(*np.nonzero(np.triu(linked, 1) if other is None else linked), strict=True)]


def _blocks_of(near: DataFrame) -> DataFrame:
    """(node, block) for the nodes of ``near`` (node, other), both directions given.
    Nodes that see the same least node within two steps come into one block where they
    can, as their candidates are mostly each other; a block has about BLOCK_MEMBERS."""
    one = near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    one = written(one, "one-step")
    two = near.join(one.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("label").alias("label"))
    labels = written(two, "labels")
    total = labels.count()
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_MEMBERS))
    own = -1 - F.pmod(F.xxhash64("label", part), F.lit(1 << 40))
    mixed_ = F.pmod(F.xxhash64("label"), F.lit(total // BLOCK_MEMBERS + 1))
    return labels.join(sizes, "label").select("node", F.when(F.col("size") > BLOCK_MEMBERS, own).otherwise(mixed_).alias("block"))


def _across_links(across: DataFrame, part: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among the candidates of ``_across``. Nodes are dealt into blocks, and a
    cell compares what two blocks have of candidates for each other; so a set is sent
    once to a cell however many pairs and groups it is in there. A cell emits a spanning
    forest of its links."""
    pairs = written(across.where("a is not null").select("a", "b").distinct(), "pairs")
    groups = written(across.where("key is not null").select("key", "node").distinct(), "large")
    stars = groups.join(groups.groupBy("key").agg(F.min("node").alias("head")), "key").where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b"))
    edges = pairs.unionByName(stars)
    near = edges.toDF("node", "other").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    block = written(_blocks_of(near), "blocks")
    of = lambda x: block.withColumnsRenamed({"node": x, "block": f"{x}_block"})
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    member = F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(f"{x}_block").alias("block")) for x in ("a", "b")])).alias("m")
    single = both.select(F.least("a_block", "b_block").alias("i"), F.greatest("a_block", "b_block").alias("j"), member).select("i", "j", "m.*")
    placed = groups.join(block, "node")
    met = placed.select("key", F.col("block").alias("other")).distinct()
    grouped = placed.join(met, "key").select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block")
    cells = single.unionByName(grouped).distinct().join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells = cells.join(sets.select("node", "grams"), "node")

    def cell(table: pa.Table) -> pa.Table:
        nodes, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        sets_ = [np.frombuffer(g.as_py(), np.uint64) for g in table.column("grams")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        other = table.column("block").to_numpy() == j if i != j else None
        # of the links only those that tie components not yet tied: fewer than members
        found = cross_links(nodes, component, sets_, other, percent)
        root = {c: c for c in component.tolist()}
        of = dict(zip(nodes.tolist(), component.tolist(), strict=True))

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for a, b in found:
            x, y = top(of[a]), top(of[b])
            if x != y:
                root[x] = y
                out.append((a, b))
        columns = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return cells.groupBy("i", "j").applyInArrow(cell, "a bigint, b bigint")


def _gather_sets(texts: DataFrame, nodes: DataFrame, width: int, seed: int, few: int = 500_000) -> DataFrame:
    """(node, grams) of the wanted (id, node): only their texts are read again."""
    is_few = nodes.limit(few + 1).count() <= few
    wanted = nodes.select(F.col("id").alias("__id"), F.col("node").alias("wanted"))
    own = texts.join(F.broadcast(wanted) if is_few else wanted, texts.id.eqNullSafe(F.col("__id"))).select("id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_ = batch.column("wanted").to_pylist()
            node, grams = [], []
            for first, sets in _sets(batch, width):
                for i, s in enumerate(sets):
                    if node_of(s, seed)[0] == wanted_[first + i]:
                        node.append(wanted_[first + i])
                        grams.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(grams, pa.binary())], names=["node", "grams"])

    return map_batches(own, run, "node bigint, grams binary").dropDuplicates(["node"])


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles (size of its set),
    component_id (the smallest doc_id reachable by links, its own included).

    A text without words, or null, has an empty set and links with nothing, not even
    with its like. Repeated rows and equal sets link. A null doc_id is larger than any
    other. Other columns are left out, so none can clash; no rows give no rows."""
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    with temporary():
        rows, named = _named(texts, width, percent)
    out = rows.join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _named(texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, node) of every row, with ``key`` if the texts have one, and (node,
    component, component_id) of every node."""
    seed = 0
    while True:
        rows = written(_nodes(texts, width, seed), "nodes", keep=True)
        nodes = rows.where("n > 0").groupBy("node").agg(
            F.min("id").alias("id"), F.max("n").alias("n"), F.min("check").alias("c"), F.max("check").alias("d")
        )
        nodes = written(nodes, "distinct")
        if nodes.where("c <> d").isEmpty():
            break
        seed += 1  # two sets with one 64-bit hash: take another hash
    texts = texts.select("id", "text")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(8, int(total * 0.4) // BUCKET_ROWS + 1)
    groups = written(_groups(_packed_keys(texts, width, percent, seed, buckets)), "groups")

    stars = written(_stars(groups, buckets), "leaders")
    wanted = written(nodes.join(stars, "node").select("id", "node"), "involved")
    sets = written(_gather_sets(texts, wanted, width, seed), "sets")

    stars = stars.where("leader is not null").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    found = written(_verified(stars, sets, percent), "stars")
    part = written(connected(found, "a", "b"), "part")

    members = _read_groups(groups, lambda b, p: [p["key"].astype(np.int64) | b << 32, p["node"]], "key bigint, node bigint")
    members = members.join(part, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    # keys whose nodes are of one component have nothing left to find
    split = members.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
    members = written(members.join(split, "key"), "members")
    across = written(_across(members.repartition("key").sortWithinPartitions("key").select("key", "node", "component")), "across")
    every = written(found.unionByName(_across_links(across, part, sets, percent)).distinct(), "links")

    part = connected(every, "a", "b")
    least = nodes.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = least.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows, written(least.join(names, "component").select("node", "component", "component_id"), "named", keep=True)


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stay when one of each group of near duplicates
    does: the one with the smallest doc_id, a null one last; of several with that
    doc_id the one whose text's key is smallest, and any one of rows equal in both.
    Texts without words are in no group and stay."""
    key = text_key(F.col(text).cast("string"))
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), key.alias("key"))
    with temporary():
        rows, named = _named(texts, width, percent)
    copies = rows.where("n > 0").groupBy("id", "key", "node").agg(F.count("*").alias("copies"))
    copies = copies.join(named.select("node", "component"), "node")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("key"))
    first = copies.groupBy("component").agg(F.min(order).alias("first"))
    stays = order.eqNullSafe(F.col("first"))
    fate = copies.join(first, "component").select(F.col("id").alias("__id"), F.col("key").alias("__of"), "copies", stays.alias("stays"))
    # rows that are alone in their group, or come first in it and only once, are not named
    fate = written(fate.where("not stays or copies > 1"), "fate")

    keyed = documents.withColumn("__key", key)
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of"))
    out = keyed.join(fate, same, "left_anti")
    repeated = fate.where("stays")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates([doc_id, "__key"]))
    return out.select(*documents.columns)
