"""Which account does a text speak of?

Signals by strength: the last four digits as a run of their own (or the tail of
a longer number), the account's name, its institution. A tie at any level is
ambiguous and ends the search. Names and institutions may stand anywhere in the
text; instead of comparing every text with every name, each distinct name is
filed under one of its character runs -- the rarest -- and a text only meets the
names whose run it contains. That is exact: a text holding the name holds all
of its runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import reads_like_movement

NAME_MIN = 4
INSTITUTION_MIN = 3


def _runs(text: Column, size: int) -> Column:
    """All distinct character runs of one length."""
    last = F.length(text) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def _run_size(text: Column, sizes: Sequence[int]) -> Column:
    """The longest run length a phrase can offer."""
    return F.coalesce(*[F.when(F.length(text) >= s, F.lit(s)) for s in sorted(sizes, reverse=True)])


def _meet(exploded: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Join exploded rows. Spark takes them to be as small as the rows they came from and
    would send all of them to every executor, by way of the driver; merged, they never
    leave the shuffle."""
    return exploded.hint("merge").join(other, key)


def contained_phrases(texts: DataFrame, phrases: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(text, phrase, accounts, account_id) for every phrase a text contains.
    ``phrases``: phrase, accounts (how many share it), account_id (the lowest)."""
    sized = phrases.withColumn("_size", _run_size(F.col("phrase"), sizes)).where("_size is not null")
    per_size = [
        sized.where(F.col("_size") == s).withColumn("run", F.explode(_runs(F.col("phrase"), s)))
        for s in sizes
    ]
    spread = per_size[0]
    for more in per_size[1:]:
        spread = spread.unionByName(more)
    frequency = spread.groupBy("run").agg(F.count("*").alias("common"))
    signature = (
        _meet(spread, frequency, "run")
        .groupBy("phrase", "accounts", "account_id")
        .agg(F.min_by("run", F.struct("common", "run")).alias("run"))
    )
    text_runs = texts.select(
        "text", F.explode(F.array_union(_runs(F.col("text"), sizes[0]), F.flatten(F.array(*[_runs(F.col("text"), s) for s in sizes[1:]])))).alias("run")
    )
    return (
        _meet(text_runs, signature, "run")
        .where(F.contains(F.col("text"), F.col("phrase")))
        .select("text", "phrase", "accounts", "account_id")
    )


def _level(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("text").agg(
        F.sum("accounts").alias(f"{name}_n"), F.min("account_id").alias(f"{name}_id")
    )


def account_hint_match(hints: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per distinct ``text``: outcome (match, ambiguous, none), strength, account."""
    texts = hints.select(F.lower("text").alias("text")).distinct()
    runs = F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))
    tails = F.array_distinct(
        F.transform(F.filter(runs, lambda r: F.length(r) >= 4), lambda r: F.right(r, F.lit(4)))
    )
    fours = (
        accounts.where(F.col("last_four").rlike(r"\A[0-9]{4}\z"))
        .groupBy("last_four")
        .agg(F.count("*").alias("accounts"), F.min("id").alias("account_id"))
    )
    by_four = _level(
        _meet(texts.select("text", F.explode(tails).alias("last_four")), fours, "last_four"), "four"
    )

    def grouped(column: str, least: int) -> DataFrame:
        return (
            accounts.where(F.length(column) >= least)
            .groupBy(F.lower(column).alias("phrase"))
            .agg(F.count("*").alias("accounts"), F.min("id").alias("account_id"))
        )

    by_name = _level(contained_phrases(texts, grouped("name", NAME_MIN), [4, 8, 16]), "name")
    by_inst = _level(
        contained_phrases(texts, grouped("institution", INSTITUTION_MIN), [3, 6, 12]), "institution"
    )
    levels = ["four", "name", "institution"]
    strength = F.coalesce(
        *[
            F.when(F.col(f"{lv}_n") > 0, F.lit("last_four" if lv == "four" else lv))
            for lv in levels
        ]
    )
    count = F.coalesce(*[F.col(f"{lv}_n") for lv in levels])
    account = F.coalesce(
        F.when(F.col("four_n").isNotNull(), F.col("four_id")),
        F.when(F.col("name_n").isNotNull(), F.col("name_id")),
        F.col("institution_id"),
    )
    return (
        texts.join(by_four, "text", "left")
        .join(by_name, "text", "left")
        .join(by_inst, "text", "left")
        .select(
            "text",
            F.when(count == 1, F.lit("match")).when(count > 1, F.lit("ambiguous")).otherwise(F.lit("none")).alias("outcome"),
            strength.alias("strength"),
            F.when(count == 1, account).alias("account_id"),
        )
    )


def account_links(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Unlinked rows that speak of a balance-only account. ``link`` is set where
    that is safe without asking: the same merchant of this account was pointed
    there before, or the account is named (not merely its institution) in wording
    that says money moves. The rest are suggestions, with the reason."""
    valued = accounts.where("kind = 'balance'")
    free = transactions.where("transfer_peer_id is null and transfer_account_id is null").select("id", "account_id", "date", "amount_cents", "description", "merchant")
    texts = free.select(F.lower("description").alias("text")).distinct()
    hits = account_hint_match(texts, valued).where("outcome = 'match'").select(
        "text", "strength", F.col("account_id").alias("hint_account_id")
    )
    history = (
        transactions.where("transfer_account_id is not null")
        .groupBy("account_id", "merchant")
        .agg(
            F.count_distinct("transfer_account_id").alias("targets"),
            F.min("transfer_account_id").alias("history_account_id"),
        )
        .where("targets = 1")
        .drop("targets")
    )
    named = F.col("strength").isin("last_four", "name")
    moving = reads_like_movement(F.col("description"))
    reason = (
        F.when(F.col("history_account_id").isNotNull(), F.lit("merchant pointed there before"))
        .when(named & moving, F.lit("named and reads like money moving"))
        .when(named, F.lit("wording does not read like money moving"))
        .otherwise(F.lit("only the institution matched"))
    )
    return (
        free.withColumn("text", F.lower("description"))
        .join(hits, "text", "left")
        .join(history, ["account_id", "merchant"], "left")
        .where("hint_account_id is not null or history_account_id is not null")
        .select(
            "id",
            "account_id",
            "date",
            "amount_cents",
            F.coalesce("history_account_id", "hint_account_id").alias("target_account_id"),
            reason.alias("reason"),
            (F.col("history_account_id").isNotNull() | (named & moving)).alias("link"),
        )
    )


def folder_account_assign(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """Statement files (file_id, hint) to accounts: a match is assigned, a tie asks,
    and no match proposes a new account."""
    found = account_hint_match(files.select(F.col("hint").alias("text")), accounts)
    return files.withColumn("text", F.lower("hint")).join(found, "text").select(
        "file_id",
        "hint",
        F.when(F.col("outcome") == "match", F.lit("assigned"))
        .when(F.col("outcome") == "ambiguous", F.lit("question"))
        .otherwise(F.lit("new_account"))
        .alias("assignment"),
        "strength",
        "account_id",
    )
