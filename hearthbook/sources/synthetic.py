"""A deterministic ledger for trials at any size: one spend per given key, over
the merchant templates, with a salary beside every 120th."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: description, merchant, least and most cents, category
MERCHANT_TEMPLATES = [
    ("KROGER #442 SPRINGFIELD", "KROGER", 2500, 24000, "Groceries"),
    ("COSTCO WHSE #1121", "COSTCO WHSE", 8000, 42000, "Groceries"),
    ("SHELL OIL 57442199", "SHELL OIL", 2800, 8500, "Gas & Auto"),
    ("CHIPOTLE 2211", "CHIPOTLE", 1100, 4200, "Restaurants"),
    ("TST* THE GREEN FORK", "THE GREEN FORK", 3500, 12000, "Restaurants"),
    ("NETFLIX.COM", "NETFLIX", 1599, 1599, "Subscriptions"),
    ("SPOTIFY USA", "SPOTIFY USA", 1199, 1199, "Subscriptions"),
    ("AMZN MKTP US*Z128KJ3", "AMAZON", 900, 18000, "Shopping"),
    ("AMAZON.COM*MM2456", "AMAZON", 1200, 26000, "Shopping"),
    ("CITY OF SPRINGFIELD UTIL", "CITY OF SPRINGFIELD UTIL", 9000, 26000, "Utilities"),
    ("AMERICAN ELECTRIC PWR", "AMERICAN ELECTRIC PWR", 7000, 21000, "Utilities"),
    ("WELLPOINT MORTGAGE PMT", "WELLPOINT MORTGAGE PMT", 214500, 214500, "Mortgage"),
    ("SQ *CORNER COFFEE", "CORNER COFFEE", 450, 1600, "Restaurants"),
    ("TARGET 00021221", "TARGET", 1500, 22000, "Household Supplies"),
    ("WALGREENS #5521", "WALGREENS", 600, 9000, "Health"),
    ("AMC THEATRES 4422", "AMC THEATRES", 2400, 8800, "Entertainment"),
]
SALARY_EVERY = 120
DAYS = 1277  # 2023-01-01 up to 2026-07-01


def scatter(key: Column, stream: int) -> Column:
    """A number in 0..65535 that looks unrelated from key to key and stream to
    stream."""
    mixed = (key % 1_000_003) * 7919 + (key % 65_537) * 31 + stream * 104_729
    return (mixed * 40_503 % 16_777_216 / 256).cast("long")


def synthetic_ledger(keys: DataFrame, key: str = "id") -> DataFrame:
    """id, account_id (1 checking, 2 card), date, amount_cents, description,
    merchant, category (70% known)."""
    k = F.col(key)
    templates = F.array(
        *[
            F.struct(
                F.lit(d).alias("description"),
                F.lit(m).alias("merchant"),
                F.lit(lo).cast("long").alias("lo"),
                F.lit(hi).cast("long").alias("hi"),
                F.lit(c).alias("category"),
            )
            for d, m, lo, hi, c in MERCHANT_TEMPLATES
        ]
    )
    spend = keys.select(
        k.alias("id"),
        F.element_at(templates, (scatter(k, 1) % len(MERCHANT_TEMPLATES) + 1).cast("int")).alias("t"),
        F.date_add(F.lit("2023-01-01").cast("date"), (scatter(k, 2) % DAYS).cast("int")).alias("date"),
        scatter(k, 3).alias("r"),
        (scatter(k, 4) % 10 < 7).alias("known"),
        (1 + scatter(k, 5) % 2).alias("account_id"),
    )
    kinds = F.explode(F.array_compact(F.array(F.lit("spend"), F.when(F.col("id") % SALARY_EVERY == 0, F.lit("salary")))))
    pay = F.col("kind") == "salary"
    return spend.withColumn("kind", kinds).select(
        "id",
        "kind",
        F.when(pay, F.lit(1).cast("long")).otherwise(F.col("account_id")).alias("account_id"),
        "date",
        F.when(pay, 650_000 + F.col("r") % 50_000)
        .otherwise(-(F.col("t.lo") + F.col("r") % (F.col("t.hi") - F.col("t.lo") + 1)))
        .alias("amount_cents"),
        F.when(pay, F.lit("DIRECT DEP EMPLOYER PAYROLL")).otherwise(F.col("t.description")).alias("description"),
        F.when(pay, F.lit("EMPLOYER PAYROLL")).otherwise(F.col("t.merchant")).alias("merchant"),
        F.when(pay, F.lit("Salary")).when(F.col("known"), F.col("t.category")).alias("category"),
    )
