"""Reports and counts over the whole ledger."""

from pyspark.sql import functions as F

from ..constants import CALENDAR_MONTH_CAP
from ..operators import reports
from .registry import query

START, END = "1995-01-01", "2001-12-31"

_TAGGED = """
, tagged AS (
  SELECT strftime(l.date, '%Y-%m') AS month, c.name, c.spending_class, l.amount_cents,
    c.spending_class IN ('base','living','luxury') OR (l.category_id IS NULL AND l.amount_cents < 0) AS is_spend
  FROM lines l LEFT JOIN categories c ON c.id = l.category_id
  WHERE l.date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
)"""
_PIVOT = _TAGGED + """
, pivoted AS (
  SELECT strftime(m.m, '%Y-%m') AS month,
    CAST(abs(coalesce(sum(amount_cents) FILTER (is_spend AND spending_class = 'base'), 0)) AS BIGINT) AS base,
    CAST(abs(coalesce(sum(amount_cents) FILTER (is_spend AND spending_class = 'living'), 0)) AS BIGINT) AS living,
    CAST(abs(coalesce(sum(amount_cents) FILTER (is_spend AND spending_class = 'luxury'), 0)) AS BIGINT) AS luxury,
    CAST(abs(coalesce(sum(amount_cents) FILTER (is_spend AND spending_class IS NULL), 0)) AS BIGINT) AS uncategorized,
    CAST(coalesce(sum(amount_cents) FILTER (spending_class = 'income'), 0) AS BIGINT) AS income
  FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS m) m
  LEFT JOIN tagged t ON t.month = strftime(m.m, '%Y-%m')
  GROUP BY 1
)"""


@query("scan_tables", "SELECT * REPLACE (date::VARCHAR AS date) FROM transactions")
def scan_tables(led):
    return led.transactions


@query("effective_lines", "SELECT transaction_id, account_id, date::VARCHAR AS date, category_id, amount_cents FROM lines")
def effective_lines(led):
    return reports.effective_lines(led.transactions, led.splits)


@query(
    "spend_by_month_class",
    _TAGGED
    + " SELECT month, spending_class, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM tagged WHERE is_spend GROUP BY 1, 2",
)
def spend_by_month_class(led):
    return reports.spend_by_month_class(led.transactions, led.splits, led.categories, START, END)


@query(
    "income_by_month",
    _TAGGED
    + " SELECT month, CAST(sum(amount_cents) AS BIGINT) AS total_cents FROM tagged WHERE spending_class = 'income' GROUP BY 1",
)
def income_by_month(led):
    return reports.income_by_month(led.transactions, led.splits, led.categories, START, END)


@query(
    "top_categories",
    _TAGGED
    + """ SELECT coalesce(name, 'Uncategorized') AS name, spending_class, CAST(sum(amount_cents) AS BIGINT) AS total_cents
    FROM tagged WHERE is_spend GROUP BY 1, 2 ORDER BY 3, 1 LIMIT 8""",
)
def top_categories(led):
    return reports.top_categories(led.transactions, led.splits, led.categories, START, END)


@query("month_pivot_dense", _PIVOT + " SELECT * FROM pivoted")
def month_pivot_dense(led):
    return reports.month_pivot_dense(led.transactions, led.splits, led.categories, START, END)


@query(
    "month_summary",
    _PIVOT
    + """ SELECT month, base + living + luxury + uncategorized AS spend, income,
    income - (base + living + luxury + uncategorized) AS net, base, living, luxury FROM pivoted""",
)
def month_summary(led):
    return reports.month_summary(month_pivot_dense(led))


@query(
    "month_calendar",
    """SELECT DISTINCT strftime(m, '%Y-%m') AS month FROM (
      SELECT unnest(generate_series(date_trunc('month', lo), least(date_trunc('month', hi), date_trunc('month', lo) + INTERVAL 119 MONTH), INTERVAL 1 MONTH)) AS m
      FROM (SELECT min(date)::TIMESTAMP AS lo, max(date)::TIMESTAMP AS hi FROM transactions))""",
)
def month_calendar(led):
    bounds = led.transactions.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return reports.calendar_of(bounds, "lo", "hi", CALENDAR_MONTH_CAP)


@query(
    "category_txn_counts",
    """SELECT c.id, c.name, c.spending_class, (SELECT count(*) FROM transactions t WHERE t.category_id = c.id) AS txn_count
    FROM categories c""",
)
def category_txn_counts(led):
    return reports.category_txn_counts(led.transactions, led.categories)


@query(
    "ledger_counts",
    "SELECT count(*) AS total, count(*) FILTER (category_id IS NULL) AS uncategorized FROM transactions",
)
def ledger_counts(led):
    return reports.ledger_counts(led.transactions)


_ACTIVITY = """
, activity AS (
  SELECT a.id, a.name, a.kind, a.sort_order, coalesce(t.n, 0) AS txn_count, coalesce(s.n, 0) AS snapshot_count,
    coalesce(b.n, 0) AS batch_count, coalesce(f.n, 0) AS far_side_count
  FROM accounts a
  LEFT JOIN (SELECT account_id, count(*) n FROM transactions GROUP BY 1) t ON t.account_id = a.id
  LEFT JOIN (SELECT account_id, count(*) n FROM snapshots GROUP BY 1) s ON s.account_id = a.id
  LEFT JOIN (SELECT account_id, count(*) n FROM batches GROUP BY 1) b ON b.account_id = a.id
  LEFT JOIN (SELECT transfer_account_id, count(*) n FROM transactions GROUP BY 1) f ON f.transfer_account_id = a.id
)"""


def activity(led):
    return reports.account_activity_counts(led.accounts, led.transactions, led.snapshots, led.batches)


@query("account_activity_counts", _ACTIVITY + " SELECT * FROM activity")
def account_activity_counts(led):
    return activity(led)


@query(
    "guarded_archive_check",
    _ACTIVITY
    + """ SELECT id, name, CASE WHEN txn_count > 0 OR snapshot_count > 0 OR batch_count > 0 THEN 'history'
    WHEN far_side_count > 0 THEN 'far_side' ELSE 'deletable' END AS verdict FROM activity""",
)
def guarded_archive_check(led):
    return reports.guarded_archive_check(activity(led))


@query(
    "kind_switch_violations",
    """, kinds AS (SELECT id, name, CASE WHEN id % 5 = 0 THEN (CASE kind WHEN 'balance' THEN 'transaction' ELSE 'balance' END)
        ELSE kind END AS kind FROM accounts)
    SELECT k.id, k.name, k.kind, count(*) AS rows, 'balance_account_has_rows' AS violation
    FROM kinds k JOIN transactions t ON t.account_id = k.id WHERE k.kind = 'balance' GROUP BY ALL
    UNION ALL
    SELECT k.id, k.name, k.kind, count(*), 'ledger_account_is_far_side'
    FROM kinds k JOIN transactions t ON t.transfer_account_id = k.id WHERE k.kind = 'transaction' GROUP BY ALL""",
)
def kind_switch_violations(led):
    # a proposed switch of some accounts, checked against every row
    other = F.when(F.col("kind") == "balance", F.lit("transaction")).otherwise(F.lit("balance"))
    proposed = led.accounts.withColumn("kind", F.when(F.col("id") % 5 == 0, other).otherwise(F.col("kind")))
    return reports.kind_switch_violations(proposed, led.transactions)


@query(
    "distinct_merchants",
    "SELECT DISTINCT merchant FROM transactions WHERE merchant <> ''",
)
def distinct_merchants(led):
    return led.transactions.where("merchant != ''").select("merchant").distinct()


@query(
    "active_accounts",
    "SELECT id, name, institution, account_type, sort_order FROM accounts WHERE is_active",
)
def active_accounts(led):
    cols = ["id", "name", "institution", "account_type", "sort_order"]
    return led.accounts.where("is_active").select(*cols).orderBy("sort_order", "name")
