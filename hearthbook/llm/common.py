"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import SparkContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII upper case to lower case; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = UPPER_ASCII.lower()


ROWS = 1000

_SHIPPED: WeakSet[SparkContext] = WeakSet()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, and texts in
    batches of ROWS: a batch is held several times over, in Spark and in Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    if spark.sparkContext not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = Path(tempfile.mkdtemp(prefix="hearthbook-package-"))
        with zipfile.ZipFile(folder / "hearthbook.zip", "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(folder / "hearthbook.zip"))
        _SHIPPED.add(spark.sparkContext)


def give_back() -> None:
    """Free memory of Arrow and, where the C library can (glibc), of numpy and Python
    goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` on workers that know this package. A worker lives on, so it gives
    back what a partition took."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share. Only a local
    session without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="hearthbook-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


_TEMPORARY: list[list[str]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end, but for those to
    keep. What leaves the block must not read the others any more. On a file system
    that pyarrow does not know they stay until the shared folder is emptied."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in _TEMPORARY.pop():
            try:
                system, inner = store(path)
                system.delete_dir(inner)
            except (OSError, pa.ArrowInvalid, NotImplementedError):
                continue


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. ``keep``:
    the table outlives the innermost ``temporary`` block."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    blocks_ = _TEMPORARY[:-1] if keep else _TEMPORARY
    if blocks_:
        blocks_[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on: list[str], rows: int = 1_000_000) -> DataFrame:
    """An inner join that keeps ``left`` where it lies if ``right``, a table of few
    narrow columns, is counted to be of ``rows`` rows at most; else both are shuffled."""
    few = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if few else right.hint("merge"), on)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in the group by ``order`` from 0, and ``n``, the
    size of the group (text, not null); a written table. A range sort numbers the rows
    of each partition, and the totals, one row per group and partition, shift them. Rows
    that agree in group and order lie in one partition and follow in any order."""
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    schema = ordered.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            g = batch.column(batch.schema.get_field_index(group))
            if not len(g):
                continue
            new = np.ones(len(g), bool)
            new[0] = g[0].as_py() != last
            new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
            at = np.arange(len(g))
            seq = at - np.maximum.accumulate(np.where(new, at, -count))
            last, count = g[len(g) - 1].as_py(), int(seq[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(seq)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "seq"])

    table = written(map_batches(ordered, number, schema), "numbered")
    own = Window.partitionBy(group)
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy(group, "part").agg(F.count("*").alias("m")).select(
        group, "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(own).alias("n")
    )
    return table.join(totals, [group, "part"]).withColumn("pos", F.col("seq") + F.col("before")).drop("part", "seq", "before")


def group_key(value: Column) -> Column:
    """Any value as text that is not null; sorted, null comes first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def field(value: Column) -> Column:
    """A value as text that cannot run into the next one: byte count, colon, value; a
    dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER_ASCII, LOWER_ASCII)


def text_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key written as text, modulo ``divisor``; a null key counts as
    the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % divisor


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column on end, and the n + 1 offsets of its rows. A null
    is as long as an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows that hold about ``size`` bytes; a longer row is
    alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        stop = min(n, start + rows, max(stop, start + 1))
        yield start, stop
        start = stop


def add_columns(
    df: DataFrame,
    text: str,
    fn: Callable[[pa.Array], dict[str, list]],
    added: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its ``keep`` columns) with the columns ``added`` (DDL), which
    ``fn`` computes from a batch of the text column. An added column replaces one of
    its name."""
    kind = df.sparkSession.createDataFrame([], added).schema
    new = {f.name.lower() for f in kind.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    own = text in kept  # else it travels behind the kept columns
    source = df.select(*[df[c] for c in kept], *([] if own else [df[text].alias("__text")]))
    at = kept.index(text) if own else len(kept)
    schema = source.select(*kept).schema
    for field in kind.fields:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.column(at))
            columns = [batch.column(i) for i in range(len(kept))]
            arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
            for field in kind.fields:
                columns.append(pa.array(out[field.name], arrow[field.dataType.simpleString()]))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[f.name for f in kind.fields]])

    return map_batches(source, run, schema)
