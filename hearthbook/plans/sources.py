"""Sources, sinks and streams. Each writes what the given tables hold in the form
a bank or shop would deliver, and reads it back through the real source."""

import uuid

from pyspark.sql import functions as F

from ..functions.money import to_cents
from ..operators import ingest as I
from ..operators import statements as St
from ..operators.staging import commit_rows
from ..session import cut_lineage
from ..sources import files, synthetic
from ..sources.commits import CommitLog, commit_import
from ..sources.index import DedupeIndex
from ..sources.rules import scratch
from ..sources.sink import append_rows, read_ledger
from ..streaming import incremental
from . import ingest as ingest_plans
from . import staging as staging_plans
from .registry import query

ONE = {"Posted Date": "raw_date", "Details": "raw_details", "Memo": "raw_memo", "Amount": "raw_amount", "Balance": "raw_balance"}
TWO = {
    "Posted Date": "raw_date", "Details": "raw_details", "Memo": "raw_memo",
    "Debit": "raw_debit", "Credit": "raw_credit", "Balance": "raw_balance",
}


@query(
    "scan_csv_records",
    """SELECT 'posted date|details|memo|amount|balance' AS signature, raw_date AS posted, raw_details AS details, raw_memo AS memo,
      raw_amount AS amount, NULL AS debit, NULL AS credit, raw_balance AS balance FROM uploads WHERE style_no <> 2
    UNION ALL SELECT 'posted date|details|memo|debit|credit|balance', raw_date, raw_details, raw_memo, NULL, raw_debit, raw_credit,
      raw_balance FROM uploads WHERE style_no = 2""",
)
def scan_csv_records(led):
    out = None
    for shape, rows in ((ONE, led.uploads.where("style_no != 2")), (TWO, led.uploads.where("style_no = 2"))):
        path = scratch(led.spark, "csv")
        rows.select(*[F.col(c).alias(h) for h, c in shape.items()]).write.options(**files.CSV_OPTIONS).csv(path)
        read = files.read_csv_records(led.spark, path)
        headers = [c for c in read.columns if c not in ("file", "row_index")]
        record = F.col("record")
        part = files.as_records(read, headers).select(
            F.lit(I.header_signature(headers)).alias("signature"),
            *[
                F.try_element_at(record, F.lit(h)).alias(name)
                for h, name in (
                    ("Posted Date", "posted"), ("Details", "details"), ("Memo", "memo"), ("Amount", "amount"),
                    ("Debit", "debit"), ("Credit", "credit"), ("Balance", "balance"),
                )
            ],
        )
        out = part if out is None else out.unionByName(part)
    return out


def order_export(led):
    """The shop's export of all orders, read back from CSV."""
    dates = led.base.select(F.col("id").alias("order_id"), "date")
    rows = led.order_items.join(dates, "order_id").select(
        F.col("order_id").cast("string").alias("Order ID"),
        F.date_format("date", "yyyy-MM-dd'T'10:00:00").alias("Order Date"),
        F.concat(F.lit('Part "'), F.col("part_id").cast("string"), F.lit('", large')).alias("Product Name"),
        F.col("quantity").alias("Quantity"),
        F.concat(F.lit("$"), F.expr("total_cents div 100"), F.lit("."), F.lpad((F.col("total_cents") % 100).cast("string"), 2, "0")).alias("Total Owed"),
    )
    path = scratch(led.spark, "orders")
    rows.write.options(**files.CSV_OPTIONS).csv(path)
    return files.read_order_history(led.spark, path)


def known_orders(led):
    return led.base.where("status = 'F'").select(F.col("id").cast("string").alias("order_id"))


@query(
    "scan_order_history",
    """SELECT CAST(i.order_id AS VARCHAR) AS order_id, b.date::VARCHAR AS order_date, CAST(sum(total_cents) AS BIGINT) AS total_cents, count(*) AS items
    FROM order_items i JOIN base b ON b.id = i.order_id WHERE b.status <> 'F' GROUP BY 1, 2""",
)
def scan_order_history(led):
    orders, _ = files.new_orders(order_export(led), known_orders(led))
    return orders


@query(
    "order_history_stats",
    """SELECT count(DISTINCT i.order_id) FILTER (b.status <> 'F') AS orders_added, count(*) FILTER (b.status <> 'F') AS items_added,
      count(DISTINCT i.order_id) FILTER (b.status = 'F') AS orders_skipped FROM order_items i JOIN base b ON b.id = i.order_id""",
)
def order_history_stats(led):
    return files.order_history_stats(order_export(led), known_orders(led))


@query(
    "folder_scan",
    """SELECT 'statements/o_orderstatus=' || o_orderstatus AS folder, 'kept' AS status FROM orders GROUP BY 1
    UNION ALL SELECT 'notes/o_orderpriority=' || replace(o_orderpriority, ' ', '%20'), 'skipped' FROM orders GROUP BY 1""",
)
def folder_scan(led):
    root = scratch(led.spark, "folder")
    orders = led.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    orders.write.partitionBy("o_orderstatus").csv(f"{root}/statements")
    orders.write.partitionBy("o_orderpriority").json(f"{root}/notes")
    found = files.folder_scan(led.spark, root, [".csv"])
    folder = F.replace(F.regexp_replace("rel_path", "/[^/]*$", ""), F.lit(" "), F.lit("%20"))
    return found.select(folder.alias("folder"), "status").distinct()


@query(
    "statement_extract_scan",
    """SELECT import_batch_id AS statement_id, date::VARCHAR AS date, description, amount_cents AS "amountCents", NULL::VARCHAR AS kind,
      NULL::BIGINT AS "balanceCents" FROM base
    UNION ALL SELECT batch_id, date::VARCHAR, NULL, NULL, kind, balance_cents FROM statement_balances""",
)
def statement_extract_scan(led):
    # pages of extracted statements: a line or a balance each, so no statement
    # has to be gathered in one place to be written
    none_t = F.array().cast("array<struct<date:date,description:string,amountCents:long>>")
    none_b = F.array().cast("array<struct<kind:string,date:date,balanceCents:long>>")
    lines = led.base.select(
        F.col("import_batch_id").alias("statement_id"),
        F.array(F.struct("date", "description", F.col("amount_cents").alias("amountCents"))).alias("transactions"),
        none_b.alias("balances"),
    )
    printed = led.statement_balances.select(
        F.col("batch_id").alias("statement_id"),
        none_t.alias("transactions"),
        F.array(F.struct("kind", "date", F.col("balance_cents").alias("balanceCents"))).alias("balances"),
    )
    path = scratch(led.spark, "statements")
    lines.unionByName(printed).write.json(path)
    read = files.read_statements(led.spark, path)
    none = F.lit(None)
    return (
        St.statement_lines_of(read)
        .select("statement_id", "date", "description", "amountCents", none.cast("string").alias("kind"), none.cast("long").alias("balanceCents"))
        .unionByName(
            St.statement_balances_of(read).select(
                "statement_id", "date", none.cast("string").alias("description"), none.cast("long").alias("amountCents"), "kind", "balanceCents"
            )
        )
    )


_TEMPLATES = ", ".join(
    f"({i}, '{d}', '{m}', {lo}, {hi}, '{c}')"
    for i, (d, m, lo, hi, c) in enumerate(synthetic.MERCHANT_TEMPLATES)
)


def _scatter(stream: int) -> str:
    mixed = f"((o_orderkey % 1000003) * 7919 + (o_orderkey % 65537) * 31 + {stream * 104729})"
    return f"({mixed} * 40503 % 16777216 // 256)"


@query(
    "synthetic_ledger",
    f""", t(i, description, merchant, lo, hi, category) AS (VALUES {_TEMPLATES}),
    s AS (SELECT o_orderkey AS id, {_scatter(1)} % 16 AS i, DATE '2023-01-01' + CAST({_scatter(2)} % 1277 AS INTEGER) AS date,
      {_scatter(3)} AS r, {_scatter(4)} % 10 < 7 AS known, 1 + {_scatter(5)} % 2 AS account_id FROM orders)
    SELECT id, 'spend' AS kind, account_id, date::VARCHAR AS date, -(lo + r % (hi - lo + 1)) AS amount_cents, description, merchant,
      CASE WHEN known THEN category END AS category FROM s JOIN t USING (i)
    UNION ALL SELECT id, 'salary', 1, date::VARCHAR, 650000 + r % 50000, 'DIRECT DEP EMPLOYER PAYROLL', 'EMPLOYER PAYROLL', 'Salary'
    FROM s WHERE id % 120 = 0""",
)
def synthetic_ledger(led):
    keys = led.table("orders").select(F.col("o_orderkey").alias("id"))
    return synthetic.synthetic_ledger(keys)


@query(
    "ledger_sink",
    staging_plans.STAGED
    + """ SELECT account_id, date::VARCHAR AS date, amount_cents, description, strftime(date, '%Y-%m') AS month FROM (
      SELECT DISTINCT account_id, dedupe_hash, date, amount_cents, description FROM included)""",
)
def ledger_sink(led):
    cols = ["account_id", "date", "amount_cents", "description", "dedupe_hash"]
    final = staging_plans.final(led)
    lines = staging_plans.ledger_index(led).around(staging_plans.staged_lines(led))[0]
    # written out, as each append reads it
    rows = cut_lineage(commit_rows(final, lines).select(*cols))
    path = scratch(led.spark, "ledger")
    append_rows(rows, path)
    append_rows(rows, path)  # a repeated commit adds nothing
    return read_ledger(led.spark, path).select("account_id", "date", "amount_cents", "description", "month")


def _linked_sql(books: str, out: str) -> str:
    """Legs of ``books`` that are each other's only candidates."""
    return f"""{out} AS (SELECT o.id AS out_id, i.id AS in_id FROM {books} o JOIN {books} i ON i.amount_cents = -o.amount_cents
      AND i.account_id <> o.account_id AND abs(date_diff('day', o.date, i.date)) <= 3
    WHERE o.amount_cents < 0 AND NOT EXISTS (SELECT 1 FROM rejections r WHERE r.txn_a_id = least(o.id, i.id) AND r.txn_b_id = greatest(o.id, i.id))
    QUALIFY count(*) OVER (PARTITION BY o.id) = 1 AND count(*) OVER (PARTITION BY i.id) = 1)"""


@query(
    "ledger_commit",
    f""", books1 AS (SELECT * FROM transactions WHERE id < 10000000000000), {_linked_sql("books1", "linked1")},
    taken AS (SELECT out_id AS id FROM linked1 UNION ALL SELECT in_id FROM linked1),
    books2 AS (SELECT * FROM transactions WHERE id NOT IN (SELECT id FROM taken)), {_linked_sql("books2", "linked2")},
    legs2 AS (SELECT out_id AS id FROM linked2 UNION ALL SELECT in_id FROM linked2),
    held AS (SELECT account_id, date, max(balance_cents) AS cents FROM statement_balances GROUP BY 1, 2)
    SELECT 1 AS batch_id, (SELECT count(*) FROM books1) AS inserted, 0 AS skipped, (SELECT count(*) FROM held) AS balances_recorded,
      (SELECT count(*) FROM taken) AS transfers_linked
    UNION ALL SELECT 2, (SELECT count(*) FROM transactions WHERE id >= 10000000000000), (SELECT count(*) FROM books1),
      (SELECT count(*) FROM snapshots s LEFT JOIN held h USING (account_id, date) WHERE h.cents IS DISTINCT FROM s.balance_cents),
      (SELECT count(*) FROM legs2 WHERE id >= 10000000000000)""",
)
def ledger_commit(led):
    """Two imports into an empty ledger: the bank's own rows, then a file that brings
    them once more beside the legs of their transfers."""
    led.hold_base()
    path, name = scratch(led.spark, "books"), f"commit_{uuid.uuid4().hex}"
    # a task sorts a bucket: so many that one stays small
    buckets = max(8, led.table("orders").count() // 400_000)
    log, index = CommitLog(led.spark, path), DedupeIndex(led.spark, name, f"{path}/index", buckets)
    # ranking writes the rows out
    keyed = staging_plans.hashed_ledger(led, "merchant", "category_id")
    balances = [led.statement_balances.withColumn("source", F.lit("import")), led.snapshots]
    told = []
    for i, rows in enumerate([keyed.where("id < 10000000000000"), keyed], start=1):
        batch = F.lit(i).cast("long").alias("batch_id")
        noted = balances[i - 1].select("account_id", "date", "balance_cents", "source", batch)
        told.append(commit_import(log, index, rows.select("*", batch), noted, led.rejections))
    return told[0].unionByName(told[1])


# accounts whose files have a header that nobody has mapped
_UNMAPPED = "account_id % 11 = 5"


def ingested(led):
    """(ledger, problems) after two deliveries, run once per ledger."""
    if "ingested" not in led.__dict__:
        folder, ledger, checkpoint, problems = (scratch(led.spark, n) for n in ("inbox", "ledger", "stream", "problems"))
        signed = led.records.withColumn(
            "signature", I.header_signature_of(led.upload_headers(F.col("style_no")))
        ).drop("style_no")
        mappings = led.saved_mappings.where(f"not ({_UNMAPPED})")
        # half the accounts deliver first; then the folder grows, first files included
        # once more under new names
        signed.where("account_id % 2 = 0").write.json(f"{folder}/first")
        incremental.incremental_ingest(led.spark, folder, mappings, ledger, checkpoint, problems)
        signed.write.json(f"{folder}/second")
        incremental.incremental_ingest(led.spark, folder, mappings, ledger, checkpoint, problems)
        led.ingested = (read_ledger(led.spark, ledger), incremental.read_problems(led.spark, problems))
    return led.ingested


@query(
    "incremental_ingest",
    ingest_plans.MAPPED
    + f""" SELECT DISTINCT ON (account_id, date, amount_cents, line, occurrence) account_id, date::VARCHAR AS date, amount_cents, description
    FROM (SELECT u.account_id, m.date, m.amount_cents, m.description, upper(trim(m.description)) AS line,
        row_number() OVER (PARTITION BY u.account_id, m.file_id, m.date, m.amount_cents, upper(trim(m.description)) ORDER BY m.row_index) AS occurrence
      FROM mapped m JOIN uploads u ON u.row_index = m.row_index WHERE m.outcome = 'row' AND NOT ({_UNMAPPED}))""",
)
def incremental_ingest(led):
    return ingested(led)[0].select("account_id", "date", "amount_cents", "description")


@query(
    "ingest_problems",
    ingest_plans.MAPPED
    + f""" SELECT u.account_id, m.file_id, m.row_index,
      CASE WHEN {_UNMAPPED} THEN 'unknown header' WHEN m.date IS NULL THEN 'Unparseable date "' || trim(m.raw_date) || '"'
        ELSE 'Unparseable amount' END AS problem
    FROM mapped m JOIN uploads u ON u.row_index = m.row_index WHERE ({_UNMAPPED}) OR m.outcome = 'error'""",
)
def ingest_problems(led):
    return ingested(led)[1].select("account_id", "file_id", "row_index", "problem")


@query(
    "event_dedupe_stream",
    """SELECT event_id, user_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_cents FROM events""",
)
def event_dedupe_stream(led):
    feed, out, checkpoint = (scratch(led.spark, n) for n in ("feed", "events", "stream"))
    copies = F.when(F.col("event_id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    events = led.table("events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        to_cents(F.col("value")).alias("amount_cents"),
        F.explode(copies).alias("copy"),
    )
    events.drop("copy").write.parquet(feed)
    schema = "event_id long, ts timestamp, user_id long, event_type string, amount_cents long"
    incremental.event_dedupe_stream(led.spark, feed, schema, out, checkpoint)
    return led.spark.read.parquet(out)
