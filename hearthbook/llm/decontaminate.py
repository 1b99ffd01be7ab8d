"""Benchmark decontamination, in DataFrame operations only.

Every benchmark item becomes windows of ``size`` normalised words (a shorter item is
one window). The set of window hashes is broadcast when it is counted to be of
``few`` rows at most and joined by a shuffle otherwise. Each text is scanned once for
windows whose hash is in the set; these hits, one row per distinct text and position,
are then verified word by word. Texts are told apart by SHA-256, so a hot group of
copies is one text, and no text is ever shuffled unless the hits are too many to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: What separates words: every ASCII character but digits and lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The normalised words of a text; null has none."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), BREAK), ""), F.array().cast("array<string>"))


def _starts(n_words: Column, size: int) -> Column:
    return F.when(n_words >= size, F.sequence(F.lit(1), F.greatest(n_words - size + 1, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )


def _hashes(words: Column, size: int) -> Column:
    return F.transform(_starts(F.size(words), size), lambda i: F.xxhash64(F.lit(size), F.slice(words, i, size)))


def benchmark_windows(benchmark: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id as text, n, window) for each distinct window of each item. Items
    without words have none; those without an id share a null."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    windows = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    return items.select("item_id", "n", F.explode_outer(F.array_distinct(windows)).alias("window")).distinct()


def find_hits(
    documents: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", few: int = 1_000_000,
) -> DataFrame:
    """(key, start, n, item_id): the verified occurrences, ``key`` being the SHA-256 of
    the text, ``start`` the word (from 1) and ``n`` the words of the window."""
    windows = written(benchmark_windows(benchmark, size, item_id, item_text), "windows")
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())  # 1..size
    hashes = windows.select(F.xxhash64("n", F.split("window", " ")).alias("h")).distinct()
    own = documents.select(F.sha2(F.col(text), 256).alias("key"), words_of(F.col(text)).alias("w"))
    if not sizes:
        return own.limit(0).select("key", F.lit(1).alias("start"), F.lit(1).alias("n"), F.lit("").alias("item_id"))
    # the window hashes of all sizes on end; a place in that list tells start and size
    found = own.select("key", F.size("w").alias("n_words"), F.concat(*[_hashes(F.col("w"), n) for n in sizes]).alias("hs"))
    # the outer form, as Spark puts a filter on the array below the inner one, which
    # would split the text anew for every window
    found = found.select("key", "n_words", F.posexplode_outer("hs").alias("at", "h"))
    is_few = hashes.limit(few + 1).count() <= few
    found = found.join(F.broadcast(hashes) if is_few else hashes.hint("shuffle_hash"), "h")
    start, n, before = F.col("at") + 1, F.lit(sizes[-1]), F.lit(0)
    for k in sizes:
        count = F.greatest(F.col("n_words") - (k - 1), F.lit(0))
        here = (F.col("at") >= before) & (F.col("at") < before + count)
        start = F.when(here, F.col("at") - before + 1).otherwise(start)
        n = F.when(here, F.lit(k)).otherwise(n)
        before = before + count
    found = found.select("key", start.alias("start"), n.alias("n")).distinct()
    places = written(found.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("places")), "places")

    texts = documents.select(F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("t"))
    is_few = places.limit(few // 10 + 1).count() <= few // 10 and (
        places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= few
    )
    texts = texts.join(F.broadcast(places) if is_few else places, "key")
    texts = texts.withColumn("w", words_of(F.col("t")))
    windows_at = F.transform("places", lambda p: F.struct(p.start, p.n, F.array_join(F.slice("w", p.start, p.n), " ").alias("window")))
    hits = texts.select("key", windows_at.alias("p")).select("key", F.explode_outer("p").alias("p"))
    hits = hits.select("key", "p.*").distinct()
    return hits.join(windows, ["n", "window"]).select("key", "start", "n", "item_id")


def covered(places: Column) -> Column:
    """The number of words inside any of the (start, n) of an array."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto"))

    def add(state: Column, p: Column) -> Column:
        end = p.start + p.n - 1
        new = F.greatest(end - F.greatest(state.upto, p.start - 1), F.lit(0))
        return F.struct((state.words + new).alias("words"), F.greatest(state.upto, end).alias("upto"))

    return F.aggregate(F.sort_array(places), zero, add, lambda s: s.words)


def report(
    documents: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text",
    few: int = 1_000_000, **options,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_hit (words inside any
    occurrence), n_items, items (ids in text order), contaminated.

    A null or empty text has no words and no hits. Repeated rows each get their row.
    Windows of an item with a null id are hits, but there is no item to name or count.
    Copies of a hit text lie where they are if the hit texts are counted to be few; else
    null texts are spread by their doc_id, and the rest is a join by text. Other columns are left out, so none can clash. A document's occurrences and items
    are gathered in one row, which its own length and the benchmark bound."""
    hits = find_hits(documents, benchmark, size, text, few=few, **options)
    found = hits.groupBy(F.col("key").alias("k")).agg(
        covered(F.collect_set(F.struct("start", "n"))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    found = written(found, "found")
    texts, named = found.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    is_few = texts <= few // 10 and named <= few
    spread = F.concat(F.lit("null "), F.xxhash64(doc_id).cast("string"))  # no text's SHA-256
    own = documents.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.sha2(F.col(text), 256), spread).alias("key"),
        F.size(words_of(F.col(text))).cast("long").alias("n_words"),
    )
    none = F.array().cast("array<string>")
    out = own.join(F.broadcast(found) if is_few else found, F.col("key") == F.col("k"), "left")
    out = out.withColumn("items", F.coalesce("items", none))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items",
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` without an occurrence, with all their columns. A null
    text stays."""
    hits = written(find_hits(documents, benchmark, size, text, **options).select("key").distinct(), "hits")
    keyed = documents.withColumn("__key", F.sha2(F.col(text), 256))
    return keyed.join(hits.withColumnRenamed("key", "__key"), "__key", "left_anti").select(*[keyed[c] for c in documents.columns])


def cut_spans(documents: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", **options) -> DataFrame:
    """All rows, with the words of every occurrence cut out of the text, together with
    the separators behind them."""
    hits = find_hits(documents, benchmark, size, text, **options)
    hits = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("__places"))
    keyed = documents.withColumn("__key", F.sha2(F.col(text), 256))
    out = keyed.join(hits.withColumnRenamed("key", "__key"), "__key", "left")
    piece = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"
    pieces = F.regexp_extract_all(F.col(text), F.lit(piece), F.lit(0))
    head = F.regexp_extract(F.col(text), r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]*", 0)
    hit = F.flatten(F.transform("__places", lambda p: F.sequence(p.start, p.start + p.n - 1)))
    at = F.array_except(F.sequence(F.lit(1), F.size(pieces)), hit)
    cut = F.concat(head, F.array_join(F.transform(at, lambda i: F.element_at(pieces, i)), ""))
    new = F.when(F.col("__places").isNull(), F.col(text)).otherwise(cut)
    return out.select(*[new.alias(c) if c == text else keyed[c] for c in documents.columns])
