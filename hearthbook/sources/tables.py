"""The ledger that stands behind the registered queries, derived from the
star-schema tables: customers keep ledgers, suppliers are balance-only accounts,
every order is a transaction and line items are order items. The remainders and
attributes below only decide which *case* a row plays; no row is left out.

`plans/views_sql.py` states the same definitions in SQL for the comparison.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import AMOUNT_STYLES, BULK_FILE_STATUSES, DATE_FORMATS, STARTER_CATEGORIES
from ..functions.accounts import account_label
from ..functions.money import to_cents
from ..operators.ingest import header_signature_of, saved_mapping_lookup
from ..session import cut_lineage

BALANCE_ACCOUNT_BASE = 1_000_000_000_000
COPY_BASE = 10_000_000_000_000
SUBSCRIPTION_CENTS = 1599


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list[str], key: Column) -> Column:
    """One of ``names`` by remainder."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


def categories(spark: SparkSession) -> DataFrame:
    """The starter dimension. As literal rows of the plan its size is known, so
    joins with it never move the other side."""
    rows = ", ".join(
        f"({i}L, '{name}', '{klass}', {order}L)"
        for i, (name, klass, order) in enumerate(STARTER_CATEGORIES, start=1)
    )
    return spark.sql(f"select * from values {rows} as t(id, name, spending_class, sort_order)")


class Ledger:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def part_count(self) -> int:
        return self.table("part").count()  # answered from parquet footers

    @cached_property
    def supplier_count(self) -> int:
        return self.table("supplier").count()

    @cached_property
    def categories(self) -> DataFrame:
        return categories(self.spark)

    @cached_property
    def accounts(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_name")

        ledgers = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        ledgers = ledgers.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("institution"),
            F.lit("transaction").alias("kind"),
            pick(
                ["checking", "savings", "credit_card", "line_of_credit", "other"], F.col("c_custkey")
            ).alias("account_type"),
            F.when(F.col("c_nationkey") % 3 != 0, F.right("c_name", F.lit(4))).alias("last_four"),
            (F.col("c_mktsegment") != "MACHINERY").alias("is_active"),
            F.col("c_nationkey").cast("long").alias("sort_order"),
        )
        valued = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        valued = valued.select(
            (F.col("s_suppkey") + BALANCE_ACCOUNT_BASE).alias("id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("institution"),
            F.lit("balance").alias("kind"),
            pick(["mortgage", "loan", "investment", "retirement"], F.col("s_suppkey")).alias(
                "account_type"
            ),
            F.right("s_name", F.lit(4)).alias("last_four"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
            F.col("s_nationkey").cast("long").alias("sort_order"),
        )
        return ledgers.unionByName(valued)

    @cached_property
    def base(self) -> DataFrame:
        """One row per order with the flags that say which case it plays."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("account_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            to_cents(F.col("o_totalprice")).alias("price"),
            (F.col("o_orderkey") % self.part_count).alias("part_key"),
        )
        part = self.table("part").select("p_partkey", F.upper("p_name").alias("part_name"))
        rows = orders.join(part, F.col("part_key") == F.col("p_partkey"))
        priority, status, oid = F.col("priority"), F.col("status"), F.col("id")
        supplier_name = F.concat(
            F.lit("SUPPLIER#"), F.lpad((oid % self.supplier_count).cast("string"), 9, "0")
        )
        open_note = (status == "P") & (priority == "4-NOT SPECIFIED")
        rows = rows.withColumns(
            {
                "amount_cents": F.when(priority == "1-URGENT", -SUBSCRIPTION_CENTS)
                .when((priority == "2-HIGH") & (oid % 7 == 0), SUBSCRIPTION_CENTS)
                .when(priority == "2-HIGH", F.col("price"))
                .otherwise(-F.col("price"))
                .cast("long"),
                "description": F.when(
                    open_note & (oid % 3 == 0), F.concat(F.lit("PAYMENT TO "), supplier_name)
                )
                .when(open_note & (oid % 3 == 1), F.concat(F.lit("FEE "), supplier_name))
                .otherwise(F.concat("part_name", F.lit(" #"), (oid % 1000).cast("string"))),
                "merchant": F.when(open_note & (oid % 3 == 0), F.lit("PAYMENT TO SUPPLIER"))
                .when(open_note & (oid % 3 == 1), F.lit("FEE SUPPLIER"))
                .otherwise(F.col("part_name")),
                "category_id": F.when(status != "P", 1 + oid % 23),
                "category_source": F.when(status == "F", F.lit("user")).when(
                    status == "O", F.lit("ai")
                ),
            }
        )
        is_transfer = F.coalesce(F.col("category_id") >= 21, F.lit(False))
        return rows.withColumns(
            {
                "mirrored": (status == "P") & (priority == "5-LOW"),
                "paired": is_transfer & (priority == "4-NOT SPECIFIED"),
                "transfer_account_id": F.when(
                    is_transfer & (priority == "3-MEDIUM"),
                    BALANCE_ACCOUNT_BASE + oid % self.supplier_count,
                ),
                "import_batch_id": F.col("account_id") * 100 + F.year("date") - 1990,
            }
        )

    def hold_base(self) -> None:
        """Write ``base`` out, for a query that reads it by several views: each of them
        would join the orders with their parts again. To be called before the views."""
        if "base" not in self.__dict__:
            self.base = cut_lineage(self.base)

    @cached_property
    def transactions(self) -> DataFrame:
        """Orders and their echoes: transfer legs 1-3, exact repeats 4, drifted
        repeats 5. One explode, so the orders are read once."""
        copies = F.array_compact(
            F.array(
                F.lit(0),
                F.when(F.col("mirrored"), 1),
                F.when(F.col("mirrored") & (F.col("id") % 4 == 0), 2),
                F.when(F.col("paired"), 3),
                F.when((F.col("status") == "F") & (F.col("priority") == "3-MEDIUM"), 4),
                F.when((F.col("status") == "O") & (F.col("priority") == "3-MEDIUM"), 5),
            )
        )
        copy, oid, account = F.col("copy"), F.col("id"), F.col("account_id")
        leg = copy.isin(1, 2, 3)
        return self.base.withColumn("copy", F.explode(copies)).select(
            (oid + copy * F.lit(COPY_BASE)).alias("id"),
            F.when(copy.isin(1, 3), account.bitwiseXOR(F.lit(1).cast("long")))
            .when(copy == 2, account - account % 10 + (account + 3) % 10)
            .otherwise(account)
            .alias("account_id"),
            F.date_add(
                "date",
                F.when(copy == 1, oid % 5).when(copy.isin(2, 3), 1).otherwise(0).cast("int"),
            ).alias("date"),
            F.when(leg, -F.col("amount_cents")).otherwise(F.col("amount_cents")).alias("amount_cents"),
            F.when(leg, F.concat(F.lit("TRANSFER "), "description"))
            .when(copy == 5, F.concat("description", F.lit(" POSTED")))
            .otherwise(F.col("description"))
            .alias("description"),
            "merchant",
            F.when(~copy.isin(1, 2), F.col("category_id")).alias("category_id"),
            F.when(copy == 3, F.lit("auto"))
            .when(~copy.isin(1, 2), F.col("category_source"))
            .alias("category_source"),
            F.when(copy == 3, oid)
            .when((copy == 0) & F.col("paired"), oid + 3 * COPY_BASE)
            .alias("transfer_peer_id"),
            F.when(copy.isin(0, 4, 5), F.col("transfer_account_id")).alias("transfer_account_id"),
            F.when(copy == 0, F.col("import_batch_id")).alias("import_batch_id"),
        )

    @cached_property
    def splits(self) -> DataFrame:
        """Two lines for every filed low-priority order."""
        parts = F.explode(F.array(F.lit(1), F.lit(2)))
        split = self.base.where("status = 'F' and priority = '5-LOW'").withColumn("line_no", parts)
        third = F.expr("amount_cents div 3")
        first = F.col("line_no") == 1
        return split.select(
            F.col("id").alias("transaction_id"),
            F.col("line_no").cast("long").alias("line_no"),
            F.when(first, 1 + F.col("id") % 23).otherwise(1 + (F.col("id") + 7) % 23).alias("category_id"),
            F.when(first, third).otherwise(F.col("amount_cents") - third).alias("amount_cents"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Month-end balances of ledgers (some off by a subscription or two, some accounts without
        any) and quarter-end valuations of balance accounts."""
        monthly = (
            self.transactions.where("account_id % 11 != 0")
            .groupBy("account_id", F.last_day("date").alias("date"))
            .agg(F.sum("amount_cents").alias("moved"))
        )
        upto = Window.partitionBy("account_id").orderBy("date").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        case = (F.col("account_id") + F.month("date")) % 7
        off = F.when(case == 0, SUBSCRIPTION_CENTS).when(case == 1, 2 * SUBSCRIPTION_CENTS).otherwise(0)
        ledgers = monthly.select(
            "account_id",
            "date",
            (F.sum("moved").over(upto) + off).cast("long").alias("balance_cents"),
            F.lit("import").alias("source"),
        )
        quarters = F.expr("sequence(date'1995-03-01', date'2001-12-01', interval 3 month)")
        key, quarter = F.col("s_suppkey"), F.col("q").cast("long")
        value = 10 * to_cents(F.abs("s_acctbal")) + quarter * (key % 97) * 100
        valued = (
            self.table("supplier")
            .select("s_suppkey", "s_acctbal", F.posexplode(quarters).alias("q", "start"))
            .select(
                (key + BALANCE_ACCOUNT_BASE).alias("account_id"),
                F.last_day("start").alias("date"),
                F.when(key % 4 < 2, -value).otherwise(value).alias("balance_cents"),
                F.lit("manual").alias("source"),
            )
        )
        return ledgers.unionByName(valued)

    @cached_property
    def rejections(self) -> DataFrame:
        """Dismissed transfer pairs: every first mirror whose order key ends in 7."""
        return self.base.where("mirrored and id % 10 = 7").select(
            F.least(F.col("id"), F.col("id") + COPY_BASE).alias("txn_a_id"),
            F.greatest(F.col("id"), F.col("id") + COPY_BASE).alias("txn_b_id"),
        )

    @cached_property
    def batches(self) -> DataFrame:
        """One file per account and year."""
        key, year = F.col("account_id"), F.col("year")
        grouped = self.base.groupBy("account_id", F.year("date").alias("year")).agg(
            F.min("date").alias("period_start"),
            F.max("date").alias("period_end"),
            F.count("*").alias("row_count"),
            F.sum("amount_cents").alias("net_cents"),
        )
        session = F.when(key % 4 != 0, F.floor(key / F.lit(10)))
        purpose = self.purpose(F.col("session_id"))
        return (
            grouped.withColumn("session_id", session)
            .withColumn("purpose", purpose)
            .select(
                (key * 100 + year - 1990).alias("id"),
                "session_id",
                "account_id",
                F.when(F.col("purpose").isin("reconcile", "bulk"), F.lit("statement"))
                .otherwise(F.lit("transactions"))
                .alias("kind"),
                F.format_string("stmt-%09d-%d.csv", key, year).alias("filename"),
                F.concat_ws("-", F.floor(key / F.lit(2)).cast("string"), year.cast("string")).alias(
                    "file_hash"
                ),
                F.when(key % 7 == 0, F.lit("discarded"))
                .when(year >= 2000, F.lit("review"))
                .otherwise(F.lit("committed"))
                .alias("status"),
                "period_start",
                # the printed period runs a few days past the last row
                F.date_add("period_end", (key % 30).cast("int")).alias("period_end"),
                "row_count",
                "net_cents",
            )
        )

    @staticmethod
    def purpose(session: Column) -> Column:
        return (
            F.when(session % 3 == 0, F.lit("import"))
            .when(session % 3 == 1, F.lit("reconcile"))
            .when(session % 3 == 2, F.lit("bulk"))
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return (
            self.batches.where("session_id is not null")
            .groupBy(F.col("session_id").alias("id"))
            .agg(
                F.when(F.count_if(F.col("status") == "review") > 0, F.lit("open"))
                .otherwise(F.lit("committed"))
                .alias("status")
            )
            .select("id", self.purpose(F.col("id")).alias("purpose"), "status")
        )

    @cached_property
    def bulk_files(self) -> DataFrame:
        """Files of folder runs, at all stages."""
        bulk = self.sessions.where("purpose = 'bulk'").select(F.col("id").alias("session_id"))
        return self.batches.join(bulk, "session_id", "left_semi").select(
            "id", "session_id", "filename", pick(BULK_FILE_STATUSES, F.col("id")).alias("status")
        )

    @cached_property
    def staged(self) -> DataFrame:
        """Every order once more as an uploaded row: filed ones unchanged, open
        ones reworded, pending ones shifted to days the books do not have. Low
        priority rows also arrive in a second file of the same account."""
        status = F.col("status")
        copies = F.array_compact(
            F.array(F.lit(0), F.when(F.col("priority") == "5-LOW", 1))
        )
        return self.base.withColumn("copy", F.explode(copies)).select(
            (F.col("id") + F.col("copy") * F.lit(COPY_BASE)).alias("id"),
            F.when(F.col("copy") == 0, F.col("import_batch_id"))
            .otherwise(F.col("account_id") * 100 + (F.year("date") - 1989) % 12)
            .alias("batch_id"),
            "account_id",
            F.when(F.col("account_id") % 4 != 0, F.floor(F.col("account_id") / F.lit(10))).alias(
                "session_id"
            ),
            F.when(status == "P", F.date_add("date", 4000)).otherwise(F.col("date")).alias("date"),
            F.when(status == "O", F.concat("description", F.lit(" PENDING")))
            .otherwise(F.col("description"))
            .alias("description"),
            "amount_cents",
        )

    @cached_property
    def statement_lines(self) -> DataFrame:
        """What the bank printed: every order a few days later, some with the sign
        turned round, and urgent high-value lines the books never saw."""
        copies = F.array_compact(
            F.array(
                F.lit(0),
                F.when((F.col("status") == "P") & (F.col("priority") == "2-HIGH"), 7),
            )
        )
        oid, copy = F.col("id"), F.col("copy")
        return self.base.withColumn("copy", F.explode(copies)).select(
            (oid + copy * F.lit(COPY_BASE)).alias("id"),
            F.col("import_batch_id").alias("batch_id"),
            "account_id",
            F.date_add("date", (oid % 6).cast("int")).alias("date"),
            "description",
            F.when(copy == 7, F.col("amount_cents") + 77)
            .when(oid % 31 == 0, -F.col("amount_cents"))
            .otherwise(F.col("amount_cents"))
            .alias("amount_cents"),
        )

    @cached_property
    def statement_balances(self) -> DataFrame:
        """Opening and closing balance printed on each file; every ninth account
        prints a closing balance that does not add up."""
        opening = F.col("account_id") * 100
        closing = opening + F.col("net_cents") + F.when(F.col("account_id") % 9 == 0, 5).otherwise(0)
        b = self.batches.withColumnRenamed("kind", "batch_kind").withColumn(
            "kind", F.explode(F.array(F.lit("opening"), F.lit("closing")))
        )
        first = F.col("kind") == "opening"
        return b.select(
            F.col("id").alias("batch_id"),
            "account_id",
            "kind",
            F.when(first, F.col("period_start")).otherwise(F.last_day("period_end")).alias("date"),
            F.when(first, opening).otherwise(closing).cast("long").alias("balance_cents"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        """Items of an order; equal lines of one part are one item, so that
        item_id is unique within its order."""
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").cast("long").alias("line_no"),
                F.col("l_partkey").alias("part_id"),
            )
            .agg(
                F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
                F.sum(to_cents(F.col("l_extendedprice"))).alias("total_cents"),
            )
            .withColumn("item_id", F.col("line_no") * 1_000_000_000_000 + F.col("part_id"))
        )

    @cached_property
    def shop_orders(self) -> DataFrame:
        """Every order that has items, tax and shipping on top; every third one
        with a sibling placed a few days later (the combined-charge case). Written
        out: orders and their charges are read many times, line items once."""
        items = self.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
            F.sum(to_cents(F.col("l_extendedprice"))).alias("items_cents")
        )
        orders = self.base.select("id", "account_id", "date").join(items, "id")
        oid, copy = F.col("id"), F.col("copy")
        total = F.col("items_cents") + oid % 500
        copies = F.array_compact(F.array(F.lit(0), F.when(oid % 3 == 2, 5)))
        placed = orders.withColumn("copy", F.explode(copies)).select(
            (oid + copy * F.lit(COPY_BASE)).alias("id"),
            "account_id",
            F.when(copy == 5, F.date_add("date", (oid % 3).cast("int")))
            .otherwise(F.col("date"))
            .alias("date"),
            F.when(copy == 5, 2 * total + 1).otherwise(total).cast("long").alias("total_cents"),
        )
        return cut_lineage(placed)

    @cached_property
    def charges(self) -> DataFrame:
        """What the card shows for the orders: whole, in two parts, or one charge
        for an order and its sibling."""
        originals = self.shop_orders.where(F.col("id") < COPY_BASE)
        oid, total, copy = F.col("id"), F.col("total_cents"), F.col("copy")
        part = F.expr("total_cents div 3")
        copies = F.when(oid % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        delay = (
            F.when(oid % 3 == 0, oid % 8)
            .when((oid % 3 == 1) & (copy == 0), 1)
            .otherwise(4)
        )
        return originals.withColumn("copy", F.explode(copies)).select(
            (oid + copy * F.lit(COPY_BASE)).alias("id"),
            "account_id",
            F.date_add("date", delay.cast("int")).alias("date"),
            F.when(oid % 3 == 0, -total)
            .when((oid % 3 == 1) & (copy == 0), -part)
            .when(oid % 3 == 1, part - total)
            .otherwise(-(total + 2 * total + 1))
            .cast("long")
            .alias("amount_cents"),
            F.when(oid % 2 == 0, F.lit("Amzn Mktp")).otherwise(F.lit("AMAZON")).alias("merchant"),
        )

    @cached_property
    def merchant_memory(self) -> DataFrame:
        """What earlier filing taught: half the merchants of filed rows."""
        size = F.length("merchant")
        return (
            self.base.where("status != 'P'")
            .groupBy("merchant")
            .agg(F.count("*").alias("use_count"))
            .where(size % 3 != 0)
            .select(
                "merchant",
                (1 + size % 23).cast("long").alias("category_id"),
                F.when(size % 2 == 0, F.lit("user")).otherwise(F.lit("ai")).alias("source"),
                "use_count",
            )
        )

    @cached_property
    def suggestions(self) -> DataFrame:
        """A model's answers per merchant, read as a table."""
        size = F.length("merchant")
        return (
            self.base.select("merchant")
            .distinct()
            .select(
                "merchant",
                (1 + (size * 7) % 23).cast("long").alias("category_id"),
                (size % 10).cast("long").alias("confidence_tenths"),
            )
        )

    @cached_property
    def labelled_accounts(self) -> DataFrame:
        return self.accounts.withColumn(
            "label", account_label(F.col("institution"), F.col("name"), F.col("last_four"))
        )

    # --- uploaded files as text ---------------------------------------------

    @cached_property
    def uploads(self) -> DataFrame:
        """Every order as an uploaded CSV row in the habits of its bank: six date
        formats, three amount styles, and the odd unreadable or blank row."""
        oid, account, amount = F.col("id"), F.col("account_id"), F.col("amount_cents")
        style = account % 3
        blank = oid % 101 == 0
        shown = F.when(oid % 103 == 0, 0).when(style == 1, -amount).otherwise(amount)
        dollars = F.concat(
            F.expr("cast(abs(shown) div 100 as string)"),
            F.lit("."),
            F.lpad((F.abs("shown") % 100).cast("string"), 2, "0"),
        )
        signed = (
            F.when(oid % 89 == 0, F.concat(dollars, F.lit(" CR")))
            .when((F.col("shown") < 0) & (oid % 3 == 0), F.concat(F.lit("-$"), dollars))
            .when((F.col("shown") < 0) & (oid % 3 == 1), F.concat(F.lit("("), dollars, F.lit(")")))
            .when(F.col("shown") < 0, F.concat(F.lit(" -"), dollars))
            .when(oid % 2 == 0, F.concat(F.lit("$"), dollars))
            .otherwise(dollars)
        )
        number = account % 6
        parts = {p: F.date_format("date", p) for p in ("yyyy", "MM", "dd", "M", "d", "MMM")}
        printed = (
            F.when(number == 0, F.concat(parts["yyyy"], F.lit("-"), parts["MM"], F.lit("-"), parts["dd"], F.lit(" 10:00")))
            .when(number == 1, F.concat(parts["MM"], F.lit("/"), parts["dd"], F.lit("/"), parts["yyyy"]))
            .when(number == 2, F.concat(parts["M"], F.lit("-"), parts["d"], F.lit("-"), parts["yyyy"]))
            .when(number == 3, F.concat(parts["dd"], F.lit("/"), parts["MM"], F.lit("/"), parts["yyyy"]))
            .when(number == 4, F.concat(parts["yyyy"], F.lit("/"), parts["M"], F.lit("/"), parts["d"]))
            .otherwise(F.concat(parts["MMM"], F.lit(" "), parts["d"], F.lit(", "), parts["yyyy"]))
        )
        return (
            self.base.withColumn("shown", shown)
            .withColumns(
                {
                    "raw_date": F.when(blank, F.lit("  "))
                    .when(oid % 97 == 0, F.lit("31/31/1999"))
                    .otherwise(printed),
                    "raw_details": F.when(blank | (oid % 103 == 0), F.lit("")).otherwise(
                        F.concat(F.lit("  "), F.regexp_replace("description", " ", "  "))
                    ),
                    "raw_memo": F.when(~blank & (oid % 103 != 0) & (oid % 5 == 0), F.lit(" ref ")).otherwise(""),
                    "raw_amount": F.when(blank, F.lit("")).otherwise(signed),
                    "raw_debit": F.when(~blank & (F.col("shown") < 0), dollars).otherwise(""),
                    "raw_credit": F.when(~blank & (F.col("shown") >= 0), dollars).otherwise(""),
                    "raw_balance": F.when(blank | (oid % 4 == 0), F.lit("")).otherwise(
                        F.concat((oid % 5000).cast("string"), F.lit(".5"))
                    ),
                }
            )
            .select(
                F.col("import_batch_id").alias("file_id"),
                oid.alias("row_index"),
                "account_id",
                style.alias("style_no"),
                number.alias("format_no"),
                *[F.col(f"raw_{c}") for c in ("date", "details", "memo", "amount", "debit", "credit", "balance")],
            )
        )

    @staticmethod
    def upload_headers(style_no: Column) -> Column:
        two = ["Posted Date", "Details", "Memo", "Debit", "Credit", "Balance"]
        one = ["Posted Date", "Details", "Memo", "Amount", "Balance"]

        def names(row: list[str]) -> Column:
            return F.array(*[F.lit(h) for h in row])

        return F.when(style_no == 2, names(two)).otherwise(names(one))

    @cached_property
    def records(self) -> DataFrame:
        """Uploads as header-keyed string maps."""
        common = [F.lit("Posted Date"), F.col("raw_date"), F.lit("Details"), F.col("raw_details"),
                  F.lit("Memo"), F.col("raw_memo"), F.lit("Balance"), F.col("raw_balance")]
        two = F.create_map(*common, F.lit("Debit"), F.col("raw_debit"), F.lit("Credit"), F.col("raw_credit"))
        one = F.create_map(*common, F.lit("Amount"), F.col("raw_amount"))
        return self.uploads.select(
            "file_id",
            "row_index",
            "account_id",
            "style_no",
            F.when(F.col("style_no") == 2, two).otherwise(one).alias("record"),
        )

    @cached_property
    def saved_mappings(self) -> DataFrame:
        """A confirmed mapping for every account that has uploaded."""

        account = F.col("account_id")

        two = account % 3 == 2
        return (
            self.base.select("account_id")
            .distinct()
            .select(
                "account_id",
                header_signature_of(self.upload_headers(account % 3)).alias("signature"),
                F.lit("Posted Date").alias("date_column"),
                pick(DATE_FORMATS, account).alias("date_format"),
                F.array(F.lit("Details"), F.lit("Memo")).alias("description_columns"),
                pick(AMOUNT_STYLES, account).alias("amount_style"),
                F.when(~two, F.lit("Amount")).alias("amount_column"),
                F.when(two, F.lit("Debit")).alias("debit_column"),
                F.when(two, F.lit("Credit")).alias("credit_column"),
                F.lit("Balance").alias("balance_column"),
            )
        )

    @cached_property
    def upload_files(self) -> DataFrame:
        """One row per uploaded file with its headers."""
        return (
            self.uploads.groupBy("file_id", "account_id")
            .agg(F.max("style_no").alias("style_no"))
            .withColumn("headers", self.upload_headers(F.col("style_no")))
            .withColumn("signature", header_signature_of(F.col("headers")))
            .drop("style_no")
        )

    @cached_property
    def mapped_records(self) -> DataFrame:
        """Records with the mapping saved for their account and headers."""
        signed = self.records.withColumn(
            "signature", header_signature_of(self.upload_headers(F.col("style_no")))
        )
        return saved_mapping_lookup(signed, self.saved_mappings)
