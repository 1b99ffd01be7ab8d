"""Duplicates, overlaps and commit of staged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_blanks, dedupe_hash
from .ordering import lookup, positions


def occurrence_index(rows: DataFrame, scope: list[str], id_col: str = "id") -> DataFrame:
    """The how-manieth identical line this is: walls of equal lines are genuine."""
    keyed = rows.withColumn("_text", F.upper(collapse_blanks(F.col("description"))))
    return positions(
        keyed, [*scope, "date", "amount_cents", "_text"], id_col, name="occurrence"
    ).drop("_text")


def with_dedupe_key(rows: DataFrame, scope: list[str], id_col: str = "id") -> DataFrame:
    """Add the per-account hash under which a second import of a row collides."""
    return occurrence_index(rows, scope, id_col).withColumn(
        "dedupe_hash",
        dedupe_hash(F.col("date"), F.col("amount_cents"), F.col("description"), F.col("occurrence")),
    )


def exact_dedupe(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """Staged rows whose (account, hash) is in the books. Both sides hashed."""
    held = ledger.groupBy("account_id", "dedupe_hash").agg(F.min("id").alias("duplicate_of_id"))
    return staged.join(held, ["account_id", "dedupe_hash"], "left")


def classify_staged(staged: DataFrame, ledger: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """duplicate: the same line is in the books; possible_duplicate: same account,
    day and amount under another wording (still included); else new. ``ledger`` and
    ``days`` may be the two parts of a stored index (`sources.index`)."""
    near = (ledger if days is None else days).groupBy("account_id", "date", "amount_cents").agg(F.min("id").alias("near_id"))
    return (
        exact_dedupe(staged, ledger)
        .join(near, ["account_id", "date", "amount_cents"], "left")
        .withColumn(
            "status",
            F.when(F.col("duplicate_of_id").isNotNull(), F.lit("duplicate"))
            .when(F.col("near_id").isNotNull(), F.lit("possible_duplicate"))
            .otherwise(F.lit("new")),
        )
        .withColumn("duplicate_of_id", F.coalesce("duplicate_of_id", "near_id"))
        .drop("near_id")
    )


def soft_dedupe(classified: DataFrame) -> DataFrame:
    return classified.where("status = 'possible_duplicate'")


def file_reliability() -> Column:
    """Smallest first: statements, then fuller files, then earlier ones."""
    return F.struct(
        F.when(F.col("kind") == "statement", 0).otherwise(1).alias("rank"),
        (-F.col("row_count")).alias("fullness"),
        F.col("batch_id").alias("winner"),
    )


def cross_file_supersede(staged: DataFrame, batches: DataFrame, unknown: bool = False) -> DataFrame:
    """Of equal rows in several files of one session and account only the most
    reliable file's counts; the others name it in superseded_by_batch_id. The
    winner is a partial aggregate, not a window, so a row copied into very many
    files stays cheap. Rows outside a session are left alone. With ``unknown`` rows of
    files that ``batches`` does not have stay, such a file being the least reliable."""
    facts = batches.select(F.col("id").alias("batch_id"), "kind", "row_count")
    known = staged.join(facts, "batch_id", "left" if unknown else "inner")
    if unknown:
        known = known.withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("long")))
    winners = (
        known.where(F.col("session_id").isNotNull())
        .groupBy("account_id", "dedupe_hash", "session_id")
        .agg(F.min(file_reliability()).alias("best"))
        .select("account_id", "dedupe_hash", "session_id", F.col("best.winner").alias("winner"))
    )
    return known.join(winners, ["account_id", "dedupe_hash", "session_id"], "left").select(
        *[known[c] for c in staged.columns],
        F.when(F.col("winner") != F.col("batch_id"), F.col("winner")).alias("superseded_by_batch_id"),
    )


def staged_included(staged: DataFrame) -> DataFrame:
    return staged.where(
        F.col("status").isin("new", "possible_duplicate") & F.col("superseded_by_batch_id").isNull()
    )


def staged_counts(staged: DataFrame, batches: DataFrame) -> DataFrame:
    """Per file: rows to add, known, left out, balances, and rows another file
    provides, in all and by the name of that file (``superseded_by``, JSON in order of
    names). ``staged`` has row_kind, status and superseded_by_batch_id."""
    txn = F.col("row_kind") != "balance"
    own = txn & F.col("superseded_by_batch_id").isNull()
    status = F.col("status")
    counts = {
        "txn_new": own & status.isin("new", "possible_duplicate"),
        "txn_dupe": own & (status == "duplicate"),
        "txn_excluded": own & ~status.isin("new", "possible_duplicate", "duplicate"),
        "balances": ~txn & ~status.isin("excluded", "duplicate"),
        "superseded": txn & F.col("superseded_by_batch_id").isNotNull(),
    }
    provider = F.col("superseded_by_batch_id")
    per = staged.groupBy("batch_id", provider).agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    names = batches.where("id is not null").select("id", "filename")
    per = lookup(per, names, "superseded_by_batch_id", "id", "batch_id").withColumn(
        "filename", F.when(F.col("superseded") > 0, F.coalesce("filename", F.concat(F.lit("#"), provider.cast("string"))))
    )
    # files of one name are one
    per = per.groupBy("batch_id", "filename").agg(*[F.sum(name).alias(name) for name in counts])
    file = F.when(F.col("filename").isNotNull(), F.struct("filename", F.col("superseded").alias("count")))
    return per.groupBy("batch_id").agg(
        *[F.sum(name).alias(name) for name in counts], F.to_json(F.sort_array(F.collect_list(file))).alias("superseded_by")
    )


def superseded_by_file(staged: DataFrame, batches: DataFrame) -> DataFrame:
    """How many of a file's rows each other file provides, by name."""
    names = batches.select(F.col("id").alias("superseded_by_batch_id"), "filename")
    return (
        staged.where(F.col("superseded_by_batch_id").isNotNull() & (F.col("row_kind") != "balance"))
        .groupBy("batch_id", "superseded_by_batch_id")
        .agg(F.count("*").alias("rows"))
        .join(names, "superseded_by_batch_id", "left")
        .select("batch_id", F.coalesce("filename", F.concat(F.lit("#"), F.col("superseded_by_batch_id").cast("string"))).alias("filename"), "rows")
    )


def owned_rows(staged: DataFrame, batches: DataFrame) -> DataFrame:
    """Staged rows that belong to a session through their file."""
    inside = batches.where(F.col("session_id").isNotNull()).select(F.col("id").alias("batch_id"))
    return staged.join(inside, "batch_id", "left_semi")


def overlap_counts(batches: DataFrame) -> DataFrame:
    """For each file under review, how many committed files of its account cover
    some of the same days.

    A period meets [start, end] unless it ends before start or begins after end,
    so the count is (begun by end) - (ended before start): two running counts
    over days, no pair of files is ever formed."""
    held = batches.where("status = 'committed' and account_id is not null")
    begun = held.select("account_id", F.col("period_start").alias("date"), F.lit(1).alias("b"), F.lit(0).alias("e"))
    ended = held.select(
        "account_id", F.date_add("period_end", 1).alias("date"), F.lit(0).alias("b"), F.lit(1).alias("e")
    )
    asked = batches.where("status = 'review' and account_id is not null")
    nothing = [F.lit(0).alias("b"), F.lit(0).alias("e")]
    points = asked.select("account_id", F.col("period_start").alias("date"), *nothing).unionByName(
        asked.select("account_id", F.col("period_end").alias("date"), *nothing)
    )
    days = (
        begun.unionByName(ended)
        .unionByName(points)
        .groupBy("account_id", "date")
        .agg(F.sum("b").alias("b"), F.sum("e").alias("e"))
    )
    upto = Window.partitionBy("account_id").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    days = days.select(
        "account_id", "date", F.sum("b").over(upto).alias("begun"), F.sum("e").over(upto).alias("ended")
    )
    at_end = days.select("account_id", F.col("date").alias("period_end"), "begun")
    at_start = days.select("account_id", F.col("date").alias("period_start"), "ended")
    return (
        asked.join(at_end, ["account_id", "period_end"])
        .join(at_start, ["account_id", "period_start"])
        .select(
            "id",
            "account_id",
            "filename",
            "period_start",
            "period_end",
            (F.col("begun") - F.col("ended")).alias("overlapping"),
        )
    )


SPAN_LEVELS = 16  # aligned blocks of up to 2^16 days


def _spans(files: DataFrame) -> DataFrame:
    """``files`` (day numbers first_day, last_day) with ``level`` and ``block``: the
    aligned blocks of 2^level days that make up the period, two a level at most."""
    parts = []
    for level in range(SPAN_LEVELS + 1):
        width = F.lit(1 << level)
        head = F.ceil(F.col("first_day") / width)
        tail = F.floor((F.col("last_day") + 1) / width) - 1
        # a block whose neighbour is inside as well is part of a wider one
        top = F.lit(level == SPAN_LEVELS)
        for block, outer in ((head, F.pmod(head, F.lit(2)) == 1), (tail, F.pmod(tail, F.lit(2)) == 0)):
            parts.append(F.when((head <= tail) & (outer | top), F.struct(F.lit(level).alias("level"), block.alias("block"))))
    spans = F.explode(F.array_distinct(F.array_compact(F.array(*parts))))
    return files.withColumn("_span", spans).select("*", "_span.*").drop("_span")


def _wider(spans: DataFrame) -> DataFrame:
    """Every span with all the blocks that hold it."""
    up = spans.withColumn("_up", F.explode(F.sequence("level", F.lit(SPAN_LEVELS))))
    return up.withColumn("block", F.expr("shiftright(block, _up - level)")).withColumn("level", F.col("_up")).drop("_up")


def overlapping_files(batches: DataFrame) -> DataFrame:
    """For each file under review the committed files of its account that cover some of
    the same days: id, other_id.

    Two periods share a day if and only if a span of one holds a span of the other, so
    this is an equality join on spans whose rows are overlaps, a few for each, and
    no pair of files apart is ever formed. A period that ends before it starts has none."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    known = batches.where("account_id is not null").select(
        "id", "account_id", "status", day("period_start").alias("first_day"), day("period_end").alias("last_day")
    )
    asked = _spans(known.where("status = 'review'")).select("account_id", "level", "block", "id")
    held = _spans(known.where("status = 'committed'")).select("account_id", "level", "block", F.col("id").alias("other_id"))
    keys = ["account_id", "level", "block"]
    both = asked.join(_wider(held), keys).unionByName(_wider(asked).join(held, keys))
    return both.select("id", "other_id").distinct()


def overlaps_of(batches: DataFrame, asked: DataFrame) -> DataFrame:
    """The committed files themselves for the few files somebody is looking at."""
    wanted = asked.select(
        F.col("id").alias("asked_id"),
        "account_id",
        F.col("period_start").alias("asked_start"),
        F.col("period_end").alias("asked_end"),
    )
    held = batches.where("status = 'committed'")
    return held.join(wanted, "account_id").where(
        "period_start <= asked_end and asked_start <= period_end and id != asked_id"
    )


def prior_file_warning(batches: DataFrame) -> DataFrame:
    """Files whose bytes came in before, with the first time they did."""
    seen = batches.groupBy("file_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return (
        batches.join(seen.where("copies > 1"), "file_hash")
        .where("id > first_id")
        .select("id", "file_hash", "first_id")
    )


def import_history(batches: DataFrame, accounts: DataFrame, sessions: DataFrame, shown: int) -> DataFrame:
    """Latest files of plain imports (no session, or one whose purpose is import)."""
    names = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    imports = sessions.where("purpose = 'import'").select(F.col("id").alias("session_id"))
    loose = batches.where("session_id is null")
    inside = batches.join(imports, "session_id", "left_semi").select(*batches.columns)
    latest = loose.unionByName(inside).orderBy(F.col("id").desc()).limit(shown)
    return latest.join(names, "account_id", "left").select(
        "id", "session_id", "filename", "kind", "status", "period_start", "period_end", "row_count", "account_name"
    )


def commit_rows(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows that would be inserted: included, and not in the books by hash even if
    they were staged before the books got them (so committing twice adds nothing)."""
    held = ledger.select("account_id", "dedupe_hash")
    return staged_included(staged).join(held, ["account_id", "dedupe_hash"], "left_anti")
