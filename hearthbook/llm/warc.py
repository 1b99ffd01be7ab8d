"""WARC archives as seekable Zstandard bundles.

Records lie one behind the other in independent Zstandard frames of about
``FRAME_BYTES``; a bundle ends with a seek table (a skippable frame with the sizes of
all frames), so any reader can jump to a frame, and an ordinary one can stream the
file. The index maps a record identifier to bundle, frame, and offset and length
within the frame. Equal payloads are stored once: one record is the response, the
others are revisits that refer to it.

A task sorts its records, writes a bundle under a temporary name and then renames it;
name and content depend on the rows alone, so an attempt that is repeated after a lost
executor writes the same file again. A task holds one frame and one Arrow batch.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared_folder, store

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
LEVEL = 3

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_TABLE_MAGIC = 0x8F92EAB1

#: Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"
RECORD = "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint"


def _urn(key: str | None, copy: int) -> str:
    return f"<urn:page:{'' if key is None else quote(key, safe='')}:{copy}>"


def page_of(urn: str) -> str | None:
    """The page id in a record identifier, None for a page without id."""
    key = urn.split(":")[2]
    return unquote(key) if key else None


def record(key: str | None, copy: int, url: str | None, date: str, digest: str, payload: bytes, refers_to: str | None, is_revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the length of the
    payload, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_urn(key, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, payload, end) of the record that starts at ``at``."""
    head_end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:head_end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in rest)
    start = head_end + 4
    end = start + int(headers["Content-Length"])
    http_end = data.index(b"\r\n\r\n", start) + 4
    for line in data[start:http_end].split(b"\r\n"):
        if line.startswith(b"Content-Length: "):
            headers["payload_bytes"] = int(line[16:])
    return headers, data[http_end:end], end + 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_roles(pages: DataFrame, key: str, payload: str, least_bytes: int) -> DataFrame:
    """Rows (page, url, payload, response): ``response`` is the key of the record that
    holds the payload, null for those that are none's copy. Only keys and digests are
    grouped; a hot payload is one row per task before the shuffle."""
    # a key that is never null, so that one shuffle of the payloads serves the join and
    # brings repeated rows of a page into one task
    own = pages.select(
        F.col(key).alias("page"), F.concat(F.lit("k"), F.col(key).cast("string")).alias("k"), "url", F.coalesce(F.col(payload), F.lit("")).alias("payload")
    ).withColumns({"k": F.coalesce("k", F.lit("")), "digest": F.sha1("payload")})
    ids = own.where(F.octet_length("payload") >= least_bytes).select("k", "page", "digest").distinct()
    largest = ids.groupBy("digest").agg(F.max("page").alias("response"), F.count("*").alias("pages")).where("pages > 1")
    roles = ids.join(largest, "digest").where(~F.col("page").eqNullSafe(F.col("response"))).select("k", "digest", "response")
    return own.repartition("k", "digest").join(roles, ["k", "digest"], "left").select("page", "url", "payload", "digest", "response")


def write(pages: DataFrame, folder: str, date: str, key: str = "page_id", payload: str = "html", url: str = "url", least_bytes: int = 0) -> DataFrame:
    """Write every row as a record into bundles below ``folder`` and return the index,
    itself a table in ``folder``/index.

    Of records with equal payloads of at least ``least_bytes`` bytes, those with the
    largest key are responses and the others revisits of it. A null payload is empty;
    a null key is smaller than any other and identifies no page. Repeated rows are
    records of their own, numbered by copy. Other columns are ignored."""
    narrow = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("url"), F.col(payload).alias("__payload"))
    rows = with_roles(narrow, "__key", "__payload", least_bytes)
    rows = rows.select(
        F.col("page").cast("string").alias("page"), "url", F.col("payload").cast("binary").alias("payload"),
        F.col("response").cast("string").alias("response"), "digest",
    )
    # a page and its copies meet in one task, in an order that the rows alone decide
    rows = rows.sortWithinPartitions("page", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        task = TaskContext.get().partitionId()
        state: dict = {"out": None, "bundle": 0, "frame": bytearray(), "rows": [], "sizes": []}

        def end_frame() -> None:
            if not state["frame"]:
                return
            if state["out"] is None:
                state["name"] = f"part-{task:05d}-{state['bundle']:04d}.warc.zst"
                state["temp"] = f"{root}/.{state['name']}.{uuid.uuid4().hex}"
                system.create_dir(root, recursive=True)
                state["out"], state["sizes"] = system.open_output_stream(state["temp"], compression=None), []
            packed = compress(bytes(state["frame"]))
            state["out"].write(packed)
            state["sizes"].append((len(packed), len(state["frame"])))
            state["frame"].clear()

        def end_bundle() -> None:
            end_frame()
            if state["out"] is None:
                return
            table = b"".join(struct.pack("<II", *s) for s in state["sizes"])
            table += struct.pack("<IBI", len(state["sizes"]), 0, SEEK_TABLE_MAGIC)
            state["out"].write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
            state["out"].close()
            system.move(state["temp"], f"{root}/{state['name']}")
            state["out"], state["bundle"] = None, state["bundle"] + 1

        last, copy = None, 0
        for batch in batches:
            index = []
            for page, url_, payload_, response, sha1 in zip(*[c for c in batch.columns], strict=True):
                page, url_, body, response, sha1 = page.as_py(), url_.as_py(), payload_.as_py(), response.as_py(), sha1.as_py()
                copy = copy + 1 if (page, 0) == last else 0
                last = (page, 0)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                raw = record(page, copy, url_, date, digest, body, response, response is not None)
                if state["frame"] and len(state["frame"]) + len(raw) > FRAME_BYTES:
                    end_frame()
                    if state["out"] is not None and state["out"].tell() >= BUNDLE_BYTES:
                        end_bundle()
                frame = len(state["sizes"]) if state["out"] is not None else 0
                name = f"part-{task:05d}-{state['bundle']:04d}.warc.zst"
                index.append((_urn(page, copy), name, frame, len(state["frame"]), len(raw)))
                state["frame"] += raw
            columns = list(zip(*index, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "bundle", "frame", "offset", "length"])
        end_bundle()

    index = map_batches(rows, run, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


class Bundle:
    """Random access to the frames of one file by its seek table."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_TABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(end - 9 - 8 * count)
        sizes = struct.iter_unpack("<II", self.file.read(8 * count))
        self.frames, at = [], 0
        for packed, size in sizes:
            self.frames.append((at, packed, size))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, size = self.frames[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)


def _row(headers: dict, payload: bytes) -> tuple:
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest_of(payload) != digest:
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not have its digest")
    refers_to = headers.get("WARC-Refers-To")
    url = headers.get("WARC-Target-URI")
    return headers["WARC-Record-ID"], kind, refers_to, None if url is None else unquote(url), digest, headers["payload_bytes"]


_KINDS = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
_NAMES = [part.split()[0] for part in RECORD.split(", ")]


def read(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that ``index`` names, frame by frame, one task
    reading a bundle; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                bundle = Bundle(system, f"{root}/{name}")
                for i in range(len(bundle.frames)):
                    data, at, rows = bundle.frame(i), 0, []
                    while at < len(data):
                        headers, payload, at = parse(data, at)
                        rows.append(_row(headers, payload))
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    bundles = index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, min(bundles.count(), 10_000)))  # Spark would merge so few rows
    return map_batches(bundles, run, RECORD)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` point to, with their payloads: each is
    cut out of its one frame. Copy rows of the index give copy rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        bundle, opened, data, at_frame = None, None, b"", None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bundle"] != opened:
                    bundle, opened, at_frame = Bundle(system, f"{root}/{row['bundle']}"), row["bundle"], None
                if row["frame"] != at_frame:
                    data, at_frame = bundle.frame(row["frame"]), row["frame"]
                headers, payload, end = parse(data, row["offset"])
                if end - row["offset"] != row["length"] or headers["WARC-Record-ID"] != row["record_id"]:
                    raise ValueError(f"the index does not fit {row['bundle']}")
                rows.append((*_row(headers, payload), payload))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (*_KINDS, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_NAMES, "payload"])

    rows = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return map_batches(rows, run, RECORD + ", payload binary")


def archive_folder(spark) -> str:
    return f"{shared_folder(spark)}/warc"
