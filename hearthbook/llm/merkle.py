"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf; the leaves of a group, in key order, form a tree whose runs of
``arity`` consecutive nodes become their parent, and the roots of the groups, in group
order, form one more such tree. A row's witness holds the siblings on its way to the
root.

Witnesses are built by appending. Leaves come in order to a small set of open subtrees;
each leaf's witness begins empty, and whenever a run of siblings is complete the
witnesses of all leaves under them are extended by it. No one appends a whole group:
leaves are cut at aligned places into blocks of arity ** LEVELS, a task appends one
block after the other, and the block roots are appended in the same way, as leaves of
the next round, until one node per group is left. Witnesses of the rounds above go down
again to the blocks they belong to.

Only digests travel: a text is hashed where it lies. Places in a group come from a range
sort and one total per group and partition, so a group of any size is spread, and equal
rows are spread by a number of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, group_key, map_batches, numbered, temporary, written

ARITY = 3
LEVELS = 8

EMPTY = hashlib.sha256(b"").digest()


def leaf(*values: Column) -> Column:
    """Digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def parent(children: list[bytes]) -> bytes:
    """Digest of a run: over the digests of its nodes as lowercase hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class Appender:
    """A tree that grows leaf by leaf. ``witnesses[i]`` is a list of (left siblings,
    right siblings), bottom up, as far as they are complete."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[bytes, int, int]]] = []
        self.witnesses: list[list[tuple[list[bytes], list[bytes]]]] = []

    def append(self, digest: bytes) -> None:
        n = len(self.witnesses)
        self.witnesses.append([])
        self._put(0, (digest, n, n + 1))

    def _put(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        # a full run is closed when its next sibling run begins, so the top stays open
        if len(self.open[level]) == self.arity:
            self._complete(level)
        self.open[level].append(node)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for j, (_, first, last) in enumerate(run):
            step = (digests[:j], digests[j + 1 :])
            for witness in self.witnesses[first:last]:
                witness.append(step)
        self._put(level + 1, (parent(digests), run[0][1], run[-1][2]))

    def close(self, height: int | None = None) -> bytes:
        """Complete the open subtrees, to a tree of ``height`` levels above the leaves
        or of as many as leave one node; the root."""
        level = 0
        while True:
            above = any(self.open[level + 1 :])
            if level == height or (height is None and not above and len(self.open[level]) == 1):
                return self.open[level][0][0]
            self._complete(level)
            level += 1


def packed(witness: list[tuple[list[bytes], list[bytes]]]) -> bytes:
    """Per level: the numbers of left and right siblings, then their digests."""
    return b"".join(b"".join([bytes([len(a), len(b)]), *a, *b]) for a, b in witness)


def steps(witness: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(witness):
        n, m = witness[at], witness[at + 1]
        own = [witness[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n + m)]
        yield own[:n], own[n:]
        at += 2 + 32 * (n + m)


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for left, right in steps(witness):
        digest = parent([*left, digest, *right])
    return digest


def proof_hash(witness: bytes) -> str:
    """Digest over all siblings as hex text, level by level, left to right."""
    return hashlib.sha256("".join(d.hex() for a, b in steps(witness) for d in (*a, *b)).encode()).hexdigest()


@dataclass
class _Block:
    """Reads sorted rows of blocks and hands over one block after the other."""

    arity: int
    size: int

    def each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["g"], row["block"]) != (held[0]["g"], held[0]["block"]):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def grown(self, leaves: list[dict]) -> tuple[Appender, bytes]:
        tree = Appender(self.arity)
        for row in leaves:
            tree.append(row["digest"])
        whole = leaves[0]["n"] <= self.size
        height = None if whole else next(h for h in range(64) if self.arity**h == self.size)
        return tree, tree.close(height)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("pos") / F.lit(size)))


def _roots(rows: DataFrame, arity: int, size: int) -> DataFrame:
    """One row per block: its root as a node of the next round."""
    rows = _blocks(rows.select("g", "pos", "n", "digest"), size).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    reader = _Block(arity, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b[0]["g"], b[0]["block"], -(-b[0]["n"] // size), reader.grown(b)[1]) for b in reader.each(batches)]
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["g", "pos", "n", "digest"])

    return map_batches(rows, run, "g string, pos bigint, n bigint, digest binary")


def _rounds(rows: DataFrame, arity: int, size: int) -> list[DataFrame]:
    """``rows`` (g, pos, n, digest) and the block roots above, round by round; the last
    table holds the single root of each group that was cut into blocks the most often."""
    largest = rows.agg(F.max("n")).first()[0] or 0
    tables = [rows]
    while True:
        tables.append(written(_roots(tables[-1].where("n > 1") if len(tables) > 1 else tables[-1], arity, size), "roots"))
        if largest <= size:
            return tables
        largest = -(-largest // size)


def _witnesses(rows: DataFrame, upper: DataFrame, arity: int, size: int) -> DataFrame:
    """``rows`` with the columns of ``upper`` (g, block, witness, subroot), one row per
    block, the witness being the row's own in its block with that of the block behind."""
    others = [c for c in rows.columns if c not in ("g", "block", "pos", "n", "digest")]
    left = _blocks(rows, size)
    kinds = dict(left.dtypes)
    # a block's witness stands before its leaves in the same sorted stream
    heads = upper.select(
        "g", "block", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("digest"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in others], "witness", "subroot",
    )
    empty = F.lit(None).cast("binary")
    both = left.select("g", "block", "pos", "n", "digest", *others, empty.alias("witness"), empty.alias("subroot")).unionByName(heads)
    both = both.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    out = both.drop("block")
    schema, reader = out.schema, _Block(arity, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for head, *leaves in reader.each(batches):
            tree, _ = reader.grown(leaves)
            if kind is None:
                kind = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in schema.fields])
            for first in range(0, len(leaves), 1000):
                part = leaves[first : first + 1000]
                for row, own in zip(part, tree.witnesses[first : first + 1000], strict=True):
                    row["witness"] = packed(own) + head["witness"]
                    row["subroot"] = head["subroot"]
                yield pa.RecordBatch.from_pylist(part, schema=kind)

    return map_batches(both, run, schema)


def _arrow(kind: str) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "date": pa.date32()}
    return plain[kind]


def manifest(
    df: DataFrame, group: str, key: str, digest: Column, carry: Column | None = None, arity: int = ARITY, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``df``: key, group, leaf, carried (``carry``, 32 bytes or
    null), position in the group, witness (``packed``), subroot and root.

    Groups are ordered bytewise as text, the null group first; within a group rows go by
    key, nulls first, then by digest. Repeated rows are leaves of their own. A group of
    one row has that leaf as subroot; a single group's subroot is the root. An empty
    table gives no rows. Names of other columns play no part."""
    size = arity**levels
    g = group_key(F.col(group))
    carried = F.lit(None).cast("binary") if carry is None else carry
    rows = df.select(g.alias("g"), F.col(key).alias("k"), digest.alias("digest"), carried.alias("carried"))
    with temporary():
        leaves = numbered(rows.withColumn("copy", F.monotonically_increasing_id()), "g", ["k", "digest", "copy"]).drop("copy")
        own = _rounds(leaves, arity, size)
        done = [t.where("n = 1").select("g", "digest") for t in own[1:]]
        subroots = done[0]
        for t in done[1:]:
            subroots = subroots.unionByName(t)
        tops = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), "digest"), "g", ["k"])
        above = _rounds(tops, arity, size)
        root = above[-1].where("n = 1").select("digest").first()
        root = F.lit(bytes(root[0]) if root else EMPTY)

        def down(tables: list[DataFrame], tip: DataFrame) -> DataFrame:
            """Witnesses of the lowest table, given those of its groups' roots."""
            found = None
            for i in range(len(tables) - 2, -1, -1):
                # roots of groups that end in round i + 1, and blocks that go on above
                ends = tables[i + 1].where("n = 1").select("g", F.col("pos").alias("block")).join(tip, "g")
                if found is not None:
                    ends = ends.unionByName(found.select("g", F.col("pos").alias("block"), "witness", "subroot"))
                rows = tables[i] if i == 0 else tables[i].where("n > 1")
                found = _witnesses(rows, ends, arity, size)
                if i:
                    found = written(found, "witnesses")
            return found

        nothing = F.lit(b"").alias("witness")
        tip = down(above, above[-1].where("n = 1").select("g", nothing, F.lit(None).cast("binary").alias("subroot")))
        tip = written(tip.select(F.col("k").alias("g"), "witness", F.col("digest").alias("subroot")), "subroots")
        out = written(down(own, tip), "manifest", keep=True)
    return out.select(
        F.col("k").alias(key), F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(group), F.col("digest").alias("leaf"),
        "carried", F.col("pos").alias("position"), "witness", "subroot", root.alias("root"),
    )


def audited(found: DataFrame, key: str) -> DataFrame:
    """Rows of ``manifest`` with the proof's digest and the root that the carried digest
    (the leaf, where there is none) leads to; digests as lowercase hex."""
    rows = found.select(key, "leaf", "carried", "witness", "subroot", "root")
    text = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = rows.select(key).schema
    for f in rows.sparkSession.createDataFrame([], text).schema.fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, carried, witness, subroot, root = (batch.column(i).to_pylist() for i in range(1, 6))
            folded = [fold(own if c is None else c, w) for own, c, w in zip(leaf, carried, witness, strict=True)]
            columns = [
                [d.hex() for d in leaf], [d.hex() for d in subroot], [d.hex() for d in root], [proof_hash(w) for w in witness],
                [d.hex() for d in folded], [a == b for a, b in zip(folded, root, strict=True)],
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns]], names=schema.names)

    return map_batches(rows, run, schema)
