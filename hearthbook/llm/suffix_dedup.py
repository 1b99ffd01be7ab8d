"""Repeated passages by a run-length compressed suffix index.

A byte is repeated when a string of ``least`` bytes that covers it also starts
somewhere else in the corpus. No task can hold a suffix array of the corpus, so equal
strings first have to meet:

1. *Anchors.* Of the k-byte strings inside a window of ``least`` bytes the one with
   the smallest hash is its anchor, so equal windows have equal anchors at equal
   places. Neighbouring windows with the same anchor form an occurrence: the anchor's
   hash, a 128-bit hash of its context (all bytes of its windows), and its place.
2. *Whole contexts.* A context that occurs twice is repeated throughout. This is a
   count per (anchor, context), so copies collapse before the shuffle.
3. *Run-length index.* Anchors with several contexts, one of them unique, are matched
   byte by byte: their distinct contexts are sorted by suffix and turned into the
   Burrows-Wheeler transform, of which only the run ends keep a suffix sample and a
   longest common prefix. Streaming over the text from left to right, the matching
   statistic of a position is that of its left neighbour less one unless a run ends
   there; positions with at least ``least`` are repeated. Between run ends nothing is
   stored, so copies with few edits cost next to nothing.
4. An anchor with more than ``HOT`` distinct contexts (a line that a third of the
   corpus shares; WORD_BYTES times as many of words) is not gathered: its windows go round again with a longer anchor,
   at last as long as the window, where a context is its anchor.

Strings of equal words are found in the same way: a text becomes eight bytes a word.
Copies of a text are counted first, by its hash, and one document stands for them.

Every step is exact for all inputs, words by 64-bit hashes; the text is shuffled once for the contexts of
step 3 and once for the result, and all that lies between is narrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, map_batches, temporary, utf8, written

LEAST = 400
HOT = 2048
FEW = 500_000  # keys of 16 bytes that may be broadcast
# about a hundred bytes are held per byte of a chunk or piece; a chunk ends with an
# anchor, which has up to HOT contexts of at most twice the window
CHUNK_BYTES = 1 << 19
PIECE_BYTES = 1 << 18
PLACE_BITS = 23
WORD_BYTES = 8

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

OCCURRENCE = "anchor bigint, context binary, key binary, doc string, first bigint, last bigint, weight bigint"


def anchor_sizes(least: int) -> list[int]:
    """The anchor length of each round; the last is the window itself."""
    return sorted({max(1, least // 6), max(1, least * 5 // 8), least})


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a value per byte."""
    n, base = 2 * PIECE_BYTES + 1, 0x9E3779B97F4A7C15
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = base, pow(base, -1, 1 << 64)
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    value = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return up, down, value ^ (value >> np.uint64(31))


def anchored(data: np.ndarray, offsets: np.ndarray, k: int, least: int, unit: int = 1) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor hash): for every maximal range first..last of window
    starts of a row with the same anchor. ``data`` is of 2 * PIECE_BYTES at most.
    ``unit``: WORD_BYTES if the data are codes of words; windows start with a word."""
    if unit > 1:
        data, offsets, k, least = data.view("<u8"), offsets // unit, max(1, k // unit), least // unit
    n, width = len(data), least - k + 1
    nothing = (np.zeros(0, np.int64),) * 4
    if n < least:
        return nothing
    up, down, value = _powers()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((value[data] if unit == 1 else data) * up[:n], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # least of each `width` in a row: a suffix minimum of one block and a prefix
    # minimum of the next
    fill = -len(packed) % width
    grid = np.concatenate([packed, np.full(fill, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[: n - least + 1], ahead[width - 1 : n - least + width]) & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - least + 1]
    start = np.flatnonzero(np.arange(n - least + 1) + least <= offsets[1:][row])
    if not len(start):
        return nothing
    row, at = row[start], at[start]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(row) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    return row[first], start[first] * unit, start[last] * unit, h[at[first]].view(np.int64)


def _pieces(offsets: np.ndarray, least: int, unit: int = 1) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """(rows, starts, ends) of about PIECE_BYTES; a longer row goes in pieces that
    overlap so that each window lies in just one."""
    rows, starts, ends, size = [], [], [], 0
    for r in range(len(offsets) - 1):
        a, b = int(offsets[r]), int(offsets[r + 1])
        while b - a >= least:
            stop = min(b, a + PIECE_BYTES // unit * unit + least - unit)
            if rows and size + stop - a > PIECE_BYTES:
                yield rows, starts, ends
                rows, starts, ends, size = [], [], [], 0
            rows.append(r)
            starts.append(a)
            ends.append(stop)
            size += stop - a
            if stop == b:
                break
            a = stop - least + unit
    if rows:
        yield rows, starts, ends


def occurrences(texts: DataFrame, k: int, least: int, in_words: bool = False, unit: int = 1) -> DataFrame:
    """The occurrences of ``texts`` (key, doc, base, weight, group, body); ``group``
    is mixed into the anchor, ``base`` is the place of the body in its text.
    ``in_words``: the bodies are still text, to be searched by words; then ``unit`` is
    WORD_BYTES, as it is for bodies of such codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("body"))
            if in_words:
                data, offsets = coded(data, offsets)
            base = batch.column("base").to_numpy()
            group = batch.column("group").to_numpy()
            for rows, starts, ends in _pieces(offsets, least, unit):
                part = np.concatenate([data[a:b] for a, b in zip(starts, ends, strict=True)])
                raw = part.tobytes()
                inner = np.concatenate([[0], np.cumsum(np.array(ends) - np.array(starts))])
                row, first, last, anchor = anchored(part, inner, k, least, unit)
                own = np.array(rows)[row]
                shift = (np.array(starts) - inner[:-1] - offsets[np.array(rows)])[row] + base[own]
                context = [blake2b(raw[a : b + least], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor ^ group[own]), pa.array(context, pa.binary()),
                        batch.column("key").take(take), batch.column("doc").take(take),
                        pa.array(first + shift), pa.array(last + shift), batch.column("weight").take(take),
                    ],
                    names=["anchor", "context", "key", "doc", "first", "last", "weight"],
                )

    return map_batches(texts.select("key", "doc", "base", "weight", "group", "body"), run, OCCURRENCE)


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array by prefix doubling, or rather by as many ranks side by side as a
    key of 63 bits has room for, and the ranks by prefixes of 7, 21, 63, ... symbols on
    the way (up to two million symbols; of fewer if a symbol takes more than nine bits)."""
    n = len(text)
    bits = max(9, int(text.max() + 1).bit_length())
    symbols, h, levels = text, 1, []
    while True:
        together = max(2, 63 // bits)
        wide = np.zeros(n + (together - 1) * h, np.int64)  # 0 is past the end
        wide[:n] = symbols
        wide[:n] += 1
        key = wide[:n].copy()
        for j in range(1, together):
            key <<= bits
            key |= wide[j * h : j * h + n]
        h *= together
        order = np.argsort(key)
        ordered = key[order]
        step = np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int32)])
        symbols = np.empty(n, np.int32)
        symbols[order] = np.cumsum(step, dtype=np.int32)
        levels.append((h, symbols))
        if h >= n or int(symbols[order[-1]]) == n - 1:
            return order, levels
        bits = n.bit_length()


def common_prefix(levels: list[tuple[int, np.ndarray]], text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffix pairs, from the ranks on the way."""
    n, out = len(text), np.zeros(len(a), np.int64)
    a, b = a.copy(), b.copy()

    def forward(size: int, symbols: np.ndarray) -> None:
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[symbols[a[inside]] == symbols[b[inside]]]
        out[same] += size
        a[same] += size
        b[same] += size

    above = levels[-1][0]
    for size, rank in reversed(levels):
        for _ in range(max(1, above // size - 1)):
            forward(size, rank)
        above = size
    for _ in range(2 * levels[0][0]):
        forward(1, text)
    return out


def matching_statistics(text: np.ndarray) -> np.ndarray:
    """For each position, the longest string that starts there and at some other
    position of ``text``."""
    n = len(text)
    order, levels = suffix_order(text)
    transform = np.where(order > 0, text[order - 1], -1)
    ends = np.flatnonzero(transform[1:] != transform[:-1])  # a run ends at i, one begins at i + 1
    shared = common_prefix(levels, text, order[ends], order[ends + 1])
    out = np.zeros(n, np.int64)
    for sample in (order[ends + 1], order[ends]):  # run heads look up, run tails look down
        reach = np.zeros(n, np.int64)
        reach[sample] = shared + sample
        out = np.maximum(out, np.maximum.accumulate(reach) - np.arange(n))
    return out


def repeated_windows(bodies: list[bytes], unique: np.ndarray, least: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first, last): ranges of window starts of the unique bodies that occur in
    another body as well. ``unit``: WORD_BYTES if a symbol is the code of a word."""
    least //= unit
    size = np.array([len(b) // unit for b in bodies])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    symbols = np.frombuffer(b"".join(bodies), np.uint8 if unit == 1 else "<u8")
    if unit > 1:
        symbols = np.unique(symbols, return_inverse=True)[1]
    inside = np.ones(start[-1], bool)
    inside[start[1:] - 1] = False
    text = np.zeros(len(inside), np.int16 if unit == 1 else np.int32)
    text[inside] = symbols
    text[inside] += 1
    own = np.zeros(len(text) + 1, np.int32)
    np.add.at(own, start[:-1][unique], 1)
    np.add.at(own, (start[:-1] + size - least + 1)[unique], -1)
    hit = (matching_statistics(text) >= least) & (np.cumsum(own[:-1]) > 0)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    body = np.searchsorted(start, first, "right") - 1
    return body, (first - start[body]) * unit, (last - start[body]) * unit


def _index_matches(contexts: DataFrame, least: int, unit: int = 1) -> DataFrame:
    """(key, first, last) of the repeated windows of unique contexts, by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last_anchor, last_context = 0, None, None

        def flush() -> pa.RecordBatch:
            unique = np.array([r[0] < 2 for r in rows])
            body, first, last = repeated_windows([r[3] for r in rows], unique, least, unit)
            base = np.array([r[2] for r in rows], np.int64)[body]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in body], pa.binary()), pa.array(base + first), pa.array(base + last)],
                names=["key", "first", "last"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for anchor, context, weight, key, base, body in zip(*columns, strict=True):
                if anchor == last_anchor and context == last_context:
                    continue  # the same row of a repeated document
                if anchor != last_anchor and held >= CHUNK_BYTES:
                    yield flush()
                    rows, held = [], 0
                rows.append((weight, key, base, body))
                held += len(body)
                last_anchor, last_context = anchor, context
        if rows:
            yield flush()

    rows = contexts.select("anchor", "context", "weight", "key", "base", "body")
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "context")
    return map_batches(rows, run, "key binary, first bigint, last bigint")


def text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def _only(texts: DataFrame, keys: DataFrame, few: int = FEW) -> DataFrame:
    """Those ``texts`` whose key is among ``keys``, where they lie, if the keys are
    counted to be few; else all, and the join to come sorts them out."""
    if keys.limit(few + 1).count() > few:
        return texts
    return texts.join(F.broadcast(keys.select(F.col("key").alias("__k"))), F.col("key") == F.col("__k"), "left_semi")


def _bodies(documents: DataFrame, wanted: DataFrame, least: int, in_words: bool = False) -> DataFrame:
    """``wanted`` (anchor, context, weight, key, doc, first, last) with the bytes of
    each context, or the codes of its words. The places of one text come together in
    one row; what is shuffled is the text."""
    places = wanted.groupBy("key", "doc").agg(F.collect_list(F.struct("anchor", "context", "weight", "first", "last")).alias("places"))
    documents = _only(documents, places.select("key").distinct())
    joined = documents.join(places.withColumnsRenamed({"key": "k", "doc": "d"}), (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")))
    place = "anchor bigint, context binary, weight bigint, key binary, doc string, base bigint, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [p.split()[0] for p in place.split(", ")]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            data, offsets = utf8(batch.column("body"))
            if in_words:
                data, offsets = coded(data, offsets)
            for row in range(batch.num_rows):
                key, doc = batch.column("key")[row].as_py(), batch.column("doc")[row].as_py()
                raw = data[offsets[row] : offsets[row + 1]].tobytes()
                own = [
                    (p["anchor"], p["context"], p["weight"], key, doc, p["first"], raw[p["first"] : p["last"] + least])
                    for p in batch.column("places")[row].as_py()
                ]
                columns = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return map_batches(joined.select("key", "doc", "body", "places"), run, place)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the rows begin and end; words stand between ASCII blanks."""
    word = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])[: len(data)]))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]])[: len(data)])) + 1
    return begins, ends


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the n + 1 places where the rows' words begin."""
    begins, ends = word_bounds(data, offsets)
    size = ends - begins
    first = np.concatenate([[0], np.cumsum(size)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], size)  # place in the own word
    up = np.full(max(1, int(size.max(initial=0))), 0x9E3779B97F4A7C15, np.uint64)
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    value = _powers()[2][data[np.repeat(begins, size) + inside]] * up[inside]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    code = total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)
    code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return code ^ (code >> np.uint64(29)), np.searchsorted(begins, offsets)


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as codes of their words, WORD_BYTES each, and the n + 1 offsets. Pieces
    of about PIECE_BYTES are coded at a time, long rows being cut at blanks."""
    cuts = [offsets]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a > PIECE_BYTES:
            blank = np.flatnonzero(BLANK[data[a:b]]) + a
            at = np.searchsorted(blank, np.arange(a + PIECE_BYTES, b, PIECE_BYTES))
            cuts.append(blank[at[at < len(blank)]])
    cut = np.unique(np.concatenate(cuts))
    codes, begins = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in blocks(cut, PIECE_BYTES, rows=len(cut)):
        own, begin = word_codes(data[cut[a] : cut[b]], cut[a : b + 1] - cut[a])
        codes.append(own)
        begins.append(begins[-1][-1] + begin[1:])
    raw = np.concatenate(codes).astype("<u8").view(np.uint8)
    return raw, np.concatenate(begins)[np.searchsorted(cut, offsets)] * WORD_BYTES


def one_per_text(texts: DataFrame, few: int = FEW) -> DataFrame:
    """Of the ``texts`` (key, doc, body) with one key those with the smallest doc, each
    with the number of them all as its ``weight``. Only keys travel if the texts that
    have copies are counted to be few."""
    copies = texts.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("copies"), F.min("doc").alias("d"))
    copies = written(copies.where("copies > 1"), "copies")
    small = copies.limit(few + 1).count() <= few
    joined = texts.join(F.broadcast(copies) if small else copies.hint("merge"), F.col("key") == F.col("k"), "left")
    own = joined.where(F.col("k").isNull() | F.col("doc").eqNullSafe(F.col("d")))
    return own.select("key", "doc", F.coalesce("copies", F.lit(1).cast("long")).alias("weight"), "body")


def find_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, hot: int = HOT, in_words: bool = False) -> DataFrame:
    """(key, places): for every distinct text with repeated bytes the ranges
    (first, last) of window starts that are repeated; the bytes from ``first`` up to
    ``last + least`` go. ``key`` is ``text_key`` of the text. ``in_words``: places and
    ``least`` are bytes of the text's words, WORD_BYTES each, and places begin with a word."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = documents.select(text_key(F.col(text)).alias("key"), F.col(doc_id).cast("string").alias("doc"), body.alias("body"))
    fewest = 2 * (least // WORD_BYTES) - 1 if in_words else least  # a word and a blank have two bytes
    zero, unit = F.lit(0).cast("long"), WORD_BYTES if in_words else 1
    hot *= unit  # what a task holds goes by symbols, and a word is one
    long_enough = one_per_text(texts.where(F.octet_length("body") >= fewest))
    now = long_enough.select("key", "doc", zero.alias("base"), "weight", zero.alias("group"), "body")
    found = []
    sizes = anchor_sizes(least)
    for k in sizes:
        seen = written(occurrences(now, k, least, in_words and k == sizes[0], unit), f"anchors-{k}")
        by_context = seen.groupBy("anchor", "context").agg(
            F.sum("weight").alias("weight"), F.min(F.struct("key", "doc", "first", "last")).alias("at")
        )
        by_context = written(by_context, f"contexts-{k}")
        whole = by_context.where("weight > 1").select("anchor", "context")
        found.append(seen.join(whole, ["anchor", "context"], "left_semi").select("key", "first", "last"))
        if k == least:
            break
        several = by_context.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("weight").alias("least"))
        several = several.where("contexts > 1 and least = 1").select("anchor", "contexts")
        wanted = by_context.join(several, "anchor").select("anchor", "context", "contexts", "weight", "at.*")
        wanted = written(wanted, f"wanted-{k}")
        contexts = _bodies(texts, wanted.drop("contexts"), least, in_words)
        crowded = wanted.where(F.col("contexts") > hot)
        n_crowded = crowded.select("anchor").distinct().limit(1).count()
        if not n_crowded:
            found.append(_index_matches(contexts, least, unit))
            break
        contexts = written(contexts, f"bodies-{k}")
        hot_anchors = crowded.select("anchor").distinct()
        found.append(_index_matches(contexts.join(hot_anchors, "anchor", "left_anti"), least, unit))
        now = contexts.join(hot_anchors, "anchor", "left_semi").select("key", "doc", "base", "weight", F.col("anchor").alias("group"), "body")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("places"))


def removed(size: int, places, least: int) -> np.ndarray:
    """Which of ``size`` bytes the ranges of window starts cover."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, places[0], 1)
    np.add.at(change, places[1] + least, -1)
    return np.cumsum(change[:-1]) > 0


def _with_places(documents: DataFrame, doc_id: str, text: str, least: int, hot: int, few: int = FEW, words: int = 0) -> DataFrame:
    """``documents`` with ``__places``, and ``__words`` if strings of ``words`` words are
    asked. If few texts have any, only those are shuffled."""
    with temporary():
        places = written(find_repeats(documents, doc_id, text, least, hot), "places", keep=True)
    added = ["__places"]
    places = places.withColumnsRenamed({"key": "__k", "places": "__places"})
    if words:
        with temporary():
            more = written(find_repeats(documents, doc_id, text, words * WORD_BYTES, hot, in_words=True), "word-places", keep=True)
        added.append("__words")
        places = written(places.join(more.withColumnsRenamed({"key": "__k", "places": "__words"}), "__k", "full"), "all-places")
    keyed = documents.withColumn("__key", text_key(F.col(text)))
    same = F.col("__key") == F.col("__k")
    if places.limit(few + 1).count() > few:
        return keyed.join(places, same, "left").drop("__key", "__k")
    marked = F.broadcast(places.select(F.col("__k").alias("__m")))
    one = F.col("__key") == F.col("__m")
    hit = keyed.join(marked, one, "left_semi").hint("merge").join(places, same).drop("__key", "__k")
    rest = keyed.join(marked, one, "left_anti").drop("__key")
    return hit.unionByName(rest.withColumns({c: F.lit(None).cast(dict(places.dtypes)[c]) for c in added}))


def _ranges(places: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (first, last) of every row; a null has none."""
    first, last = places.values.field("first").to_numpy(), places.values.field("last").to_numpy()
    bounds = places.offsets.to_numpy()
    for i in range(len(places)):
        x, y = (bounds[i], bounds[i + 1]) if places[i].is_valid else (0, 0)
        yield first[x:y], last[x:y]


def repeated_words(size: int, places, words: int) -> np.ndarray:
    """Which of ``size`` words lie in repeated strings of ``words`` words."""
    first, last = -(-places[0] // WORD_BYTES), places[1] // WORD_BYTES  # whole words
    whole = first <= last
    return removed(size, (first[whole], last[whole]), words)


def removed_words(data: np.ndarray, places, words: int) -> np.ndarray:
    """Which bytes lie in repeated strings of ``words`` words, blanks between included."""
    begins, ends = word_bounds(data, np.array([0, len(data)]))
    gone = repeated_words(len(begins), places, words)
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    change = np.zeros(len(data) + 1, np.int8)
    change[begins[np.flatnonzero(edge == 1)]] = 1
    change[ends[np.flatnonzero(edge == -1) - 1]] -= 1
    return np.cumsum(change[:-1]) > 0


def _runs(mask: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1))


def _masks(batch: pa.RecordBatch, least: int, words: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
    data, offsets = utf8(batch.column("__text"))
    in_words = _ranges(batch.column("__words")) if words else repeat(None)
    for a, b, places, more in zip(offsets[:-1], offsets[1:], _ranges(batch.column("__places")), in_words, strict=False):
        gone = removed(b - a, places, least)
        if more is not None and len(more[0]):
            gone |= removed_words(data[a:b], more, words)
        yield data[a:b], gone


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, hot: int = HOT, words: int = 0) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and repeated (whether anything is removed).

    A null text is empty; a text shorter than ``least`` loses nothing. Copies of a
    text, repeated rows included, occur elsewhere and so lose everything. Other
    columns are left out, so none can clash.

    ``words``: also n_passage_words and n_passages, the words in strings of so many equal
    words that also start elsewhere, however few their bytes, and the maximal runs of
    them. They are only counted: what is removed is decided by bytes alone."""
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    joined = _with_places(own, "doc_id", "__text", least, hot, words=words)
    fields = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("repeated", "boolean")]
    fields += [("n_passage_words", "bigint"), ("n_passages", "bigint")] if words else []
    arrow = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            in_words = _ranges(batch.column("__words")) if words else repeat(None)
            for (data, gone), places in zip(_masks(batch, least), in_words, strict=False):
                spans = _runs(gone)
                row = (len(data), int(gone.sum()), spans, sha256(data[~gone].tobytes()).hexdigest(), spans > 0)
                if places is not None:
                    size = len(word_bounds(data, np.array([0, len(data)]))[0]) if len(places[0]) else 0
                    inside = repeated_words(size, places, words)
                    row += (int(inside.sum()), _runs(inside))
                out.append(row)
            columns = list(zip(*out, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, arrow[t]) for c, (_, t) in zip(columns, fields, strict=True)]],
                names=["doc_id", *[name for name, _ in fields]],
            )

    schema = ", ".join(f"{name} {kind}" for name, kind in [("doc_id", dict(documents.dtypes)[doc_id]), *fields])
    return map_batches(joined.select("doc_id", "__text", "__places", *(["__words"] if words else [])), run, schema)


def cut_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, hot: int = HOT, words: int = 0) -> DataFrame:
    """All rows and columns, with the repeated bytes cut out of the text. A character
    of which any byte stays is kept whole, so the text remains UTF-8; a null text
    stays null. ``words``: strings of so many equal words that also start elsewhere are
    cut as well, however few their bytes and whatever blanks are between."""
    names, at = documents.columns, documents.columns.index(text)
    own = documents.withColumn("__text", F.col(text))
    added = ["__places", "__words"] if words else ["__places"]
    joined = _with_places(own, doc_id, "__text", least, hot, words=words).select(*names, "__text", *added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for i, (data, gone) in enumerate(_masks(batch, least, words)):
                if not batch.column(at)[i].is_valid:
                    new.append(None)
                    continue
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                if len(lead):
                    size = np.diff(np.concatenate([lead, [len(data)]]))
                    gone = np.repeat(np.logical_and.reduceat(gone, lead), size)
                new.append(data[~gone].tobytes().decode("utf-8", "replace") if len(lead) else "")
            columns = [pa.array(new, pa.string()) if j == at else batch.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(joined, run, documents.schema)
