"""Filing rows under categories, and what is remembered of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.accounts import is_liability, payment_category
from ..functions.text import reads_like_payment


def guard_blocks(amount: Column, account_type: Column, spending_class: Column) -> Column:
    """Money coming off a debt is a payment or a credit, never income. Holds for
    remembered and suggested categories, not for the user's own choice."""
    return (amount > 0) & is_liability(account_type) & (spending_class == "income")


def memory_join(transactions: DataFrame, memory: DataFrame) -> DataFrame:
    """Uncategorized rows with what is remembered of their merchant. Memory holds
    a merchant once, so a merchant with very many rows only widens one side."""
    known = memory.select(
        "merchant", F.col("category_id").alias("memory_category_id"), F.col("source").alias("memory_source")
    )
    return transactions.where("category_id is null").join(known, "merchant", "left")


def categorize_layers(
    transactions: DataFrame,
    accounts: DataFrame,
    categories: DataFrame,
    memory: DataFrame,
    suggestions: DataFrame,
    least_confidence: int = 5,
) -> DataFrame:
    """Uncategorized rows and which layer files them: the debt-payment rule, then
    memory, then suggestions (confidence in tenths). A guarded answer is not
    used; what no layer files stays open, with the reason."""
    classes = categories.select(F.col("id").alias("cat"), F.col("spending_class").alias("class"))
    payments = categories.select(F.col("id").alias("payment_id"), F.col("name").alias("payment_name"))
    types = (
        accounts.select(
            F.col("id").alias("account_id"),
            "account_type",
            F.coalesce(payment_category(F.col("account_type")), F.lit("")).alias("payment_name"),
        )
        .join(payments, "payment_name", "left")
        .drop("payment_name")
    )

    def with_class(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(
            classes.select(F.col("cat").alias(column), F.col("class").alias(out)), column, "left"
        )

    # classes are attached to the per-merchant and per-account tables, not to rows
    remembered = with_class(
        memory.select("merchant", F.col("category_id").alias("memory_id")), "memory_id", "memory_class"
    )
    suggested = with_class(
        suggestions.select(
            "merchant", F.col("category_id").alias("suggested_id"), "confidence_tenths"
        ),
        "suggested_id",
        "suggested_class",
    )
    rows = (
        transactions.where("category_id is null")
        .select("id", "account_id", "date", "amount_cents", "description", "merchant")
        .join(types, "account_id")
        .join(remembered, "merchant", "left")
        .join(suggested, "merchant", "left")
    )
    amount, kind = F.col("amount_cents"), F.col("account_type")
    rule = (amount > 0) & is_liability(kind) & reads_like_payment(F.col("description"))
    memory_blocked = guard_blocks(amount, kind, F.coalesce("memory_class", F.lit("")))
    ai_blocked = guard_blocks(amount, kind, F.coalesce("suggested_class", F.lit("")))
    sure = F.coalesce(F.col("confidence_tenths") >= least_confidence, F.lit(False))
    outcome = (
        F.when(rule, F.lit("rule"))
        .when(F.col("memory_id").isNotNull() & ~memory_blocked, F.lit("memory"))
        .when(sure & ~ai_blocked, F.lit("ai"))
        .when(memory_blocked | (sure & ai_blocked), F.lit("blocked"))
        .when(F.col("suggested_id").isNotNull(), F.lit("low_confidence"))
        .otherwise(F.lit("unknown"))
    )
    return rows.withColumn("outcome", outcome).select(
        "id",
        "account_id",
        "amount_cents",
        "merchant",
        "outcome",
        F.when(F.col("outcome") == "rule", F.col("payment_id"))
        .when(F.col("outcome") == "memory", F.col("memory_id"))
        .when(F.col("outcome") == "ai", F.col("suggested_id"))
        .alias("category_id"),
        F.when(F.col("outcome") == "rule", F.lit("auto"))
        .when(F.col("outcome") == "memory", F.lit("memory"))
        .when(F.col("outcome") == "ai", F.lit("ai"))
        .alias("category_source"),
    )


def categorize_tally(decided: DataFrame) -> DataFrame:
    return decided.groupBy("outcome").agg(F.count("*").alias("rows"))


def bulk_categorize(transactions: DataFrame, selection: DataFrame) -> DataFrame:
    """The ledger after the user files a selection (id, new_category_id)."""
    chosen = selection.select("id", "new_category_id")
    return transactions.join(chosen, "id", "left").select(
        *[
            F.coalesce("new_category_id", c).alias(c)
            if c == "category_id"
            else F.when(F.col("new_category_id").isNotNull(), F.lit("user")).otherwise(F.col(c)).alias(c)
            if c == "category_source"
            else F.col(c)
            for c in transactions.columns
        ]
    )


def choices_of(transactions: DataFrame, selection: DataFrame) -> DataFrame:
    """What a bulk choice teaches: each distinct merchant of the selection."""
    return (
        transactions.join(selection.select("id", "new_category_id"), "id")
        .where("merchant != ''")
        .groupBy("merchant")
        .agg(F.max("new_category_id").alias("category_id"))
        .withColumn("source", F.lit("user"))
    )


def memory_upsert(memory: DataFrame, choices: DataFrame) -> DataFrame:
    """One rule per merchant. A user's choice replaces whatever was there; an AI
    answer replaces only an AI answer. Every write counts as one more use."""
    rank = F.when(F.col("source") == "user", 1).otherwise(0)
    both = memory.select("merchant", "category_id", "source", "use_count", F.lit(0).alias("fresh")).unionByName(
        choices.select(
            "merchant", "category_id", "source", F.lit(1).cast("long").alias("use_count"), F.lit(1).alias("fresh")
        )
    )
    return (
        both.groupBy("merchant")
        .agg(
            F.max_by(F.struct("category_id", "source"), F.struct(rank, F.col("fresh"), F.col("category_id"))).alias("w"),
            F.sum("use_count").alias("use_count"),
        )
        .select("merchant", "w.category_id", "w.source", "use_count")
    )


def rules_export(categories: DataFrame, memory: DataFrame, user_only: bool = False) -> DataFrame:
    """Merchant rules with their category by name, ready to be written as JSON."""
    rules = memory.where("source = 'user'") if user_only else memory
    names = categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category"), "spending_class"
    )
    return rules.join(names, "category_id").select(
        "merchant", "category", "spending_class", "source", "use_count"
    )


def merge_categories(categories: DataFrame, incoming: DataFrame) -> DataFrame:
    """Categories are only added; one that exists keeps its own class."""
    wanted = incoming.groupBy(F.col("category").alias("name")).agg(
        F.min("spending_class").alias("file_class")
    )
    return categories.select("name", "spending_class", F.lit(True).alias("on_file")).join(
        wanted, "name", "full"
    ).select(
        "name",
        F.coalesce("spending_class", "file_class").alias("spending_class"),
        F.when(F.col("on_file").isNull(), F.lit("created"))
        .when(F.col("file_class").isNotNull(), F.lit("matched"))
        .otherwise(F.lit("untouched"))
        .alias("outcome"),
    )


def rules_merge(
    memory: DataFrame, categories: DataFrame, incoming: DataFrame, replace: bool = False
) -> DataFrame:
    """Merge a rules file (merchant, category, source) into memory by name. The
    user's own choices beat the file; in replace mode the file is the whole list. A
    rule is there if its row is, even when its category is gone. Use counts stay."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("mine"))
    current = memory.join(names, "category_id", "left").select(
        "merchant", "mine", F.col("source").alias("my_source"), "use_count", F.lit(True).alias("held")
    )
    given = incoming.select(
        "merchant", F.col("category").alias("theirs"), F.col("source").alias("their_source"), F.lit(True).alias("given")
    )
    both = current.join(given, "merchant", "full")
    mine, theirs = F.col("mine"), F.col("theirs")
    new, absent, same = F.col("held").isNull(), F.col("given").isNull(), mine.eqNullSafe(theirs)
    if replace:
        outcome = F.when(absent, F.lit("removed")).when(new, F.lit("added")).otherwise(F.lit("replaced"))
        keep_mine = F.lit(False)
    else:
        own_choice = F.coalesce(F.col("my_source") == "user", F.lit(False))
        keep_mine = ~new & (absent | same | own_choice)
        outcome = (
            F.when(new, F.lit("added"))
            .when(absent, F.lit("untouched"))
            .when(same, F.lit("unchanged"))
            .when(own_choice, F.lit("kept_user"))
            .otherwise(F.lit("updated"))
        )
    return both.select(
        "merchant",
        F.when(keep_mine, mine).otherwise(theirs).alias("category"),
        F.when(keep_mine, F.col("my_source")).otherwise(F.col("their_source")).alias("source"),
        F.coalesce("use_count", F.lit(0).cast("long")).alias("use_count"),
        outcome.alias("outcome"),
    )


def outcome_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("outcome").agg(F.count("*").alias("rules"))
