"""Register queries."""

from pyspark.sql import functions as F

from ..operators import balances as B
from ..operators import register as R
from .balances import CLEARED
from .registry import query


@query(
    "register_filter",
    CLEARED
    + """ SELECT t.id, t.account_id, t.date::VARCHAR AS date, t.amount_cents, t.description FROM cleared t
    JOIN categories c ON c.id = t.category_id AND c.spending_class = 'luxury'
    WHERE t.date BETWEEN DATE '1996-03-01' AND DATE '2000-10-31' AND t.description ILIKE '%widget%' AND t.cleared = 'reconciled'""",
)
def register_filter(led):
    f = R.RegisterFilter(
        spending_class="luxury", start="1996-03-01", end="2000-10-31", text="widget", reconciled=True
    )
    days = B.cleared_days(led.snapshots, led.transactions)
    rows = R.register_filter(led.transactions, f, led.categories, days)
    return rows.select("id", "account_id", "date", "amount_cents", "description")


@query(
    "register_filter_open",
    CLEARED
    + """ SELECT t.id, t.account_id, t.date::VARCHAR AS date, t.amount_cents FROM cleared t
    WHERE t.category_id IS NULL AND t.cleared <> 'reconciled' AND t.id IN (SELECT id FROM statement_lines)""",
)
def register_filter_open(led):
    f = R.RegisterFilter(category="none", reconciled=False, ids=led.statement_lines)
    days = B.cleared_days(led.snapshots, led.transactions)
    rows = R.register_filter(led.transactions, f, led.categories, days)
    return rows.select("id", "account_id", "date", "amount_cents")


@query(
    "uncategorized_filter",
    "SELECT id, account_id, date::VARCHAR AS date, amount_cents, merchant FROM transactions WHERE category_id IS NULL",
)
def uncategorized_filter(led):
    rows = R.register_filter(led.transactions, R.RegisterFilter(category="none"))
    return rows.select("id", "account_id", "date", "amount_cents", "merchant")


@query(
    "register_total",
    "SELECT account_id, count(*) AS total FROM transactions GROUP BY 1",
)
def register_total(led):
    # the register counts by account alone, whatever else is filtered
    return led.transactions.groupBy("account_id").agg(F.count("*").alias("total"))


@query(
    "register_enrich",
    """SELECT t.id, t.account_id, a.name AS account_name, t.date::VARCHAR AS date, t.amount_cents, t.description, t.merchant,
      c.name AS category_name, c.spending_class, pa.name AS peer_account_name,
      (SELECT count(*) FROM splits s WHERE s.transaction_id = t.id) AS split_count
    FROM transactions t JOIN accounts a ON a.id = t.account_id LEFT JOIN categories c ON c.id = t.category_id
    LEFT JOIN transactions p ON p.id = t.transfer_peer_id LEFT JOIN accounts pa ON pa.id = p.account_id""",
)
def register_enrich(led):
    return R.register_enrich(led.transactions, led.accounts, led.categories, led.splits)


@query(
    "register_page",
    """, page AS (SELECT id, account_id, date, amount_cents, description FROM transactions
      WHERE (date, id) < (DATE '1999-06-15', 5000) ORDER BY date DESC, id DESC LIMIT 51),
    numbered AS (SELECT *, row_number() OVER (ORDER BY date DESC, id DESC) AS i, count(*) OVER () AS n FROM page)
    SELECT id, account_id, date::VARCHAR AS date, amount_cents, description,
      CASE WHEN n > 50 AND i = 50 THEN CAST(date AS VARCHAR) || '_' || CAST(id AS VARCHAR) END AS next_cursor
    FROM numbered WHERE i <= 50""",
)
def register_page(led):
    return R.register_page(led.transactions, cursor=("1999-06-15", 5000))


@query(
    "neighbor_rows",
    """SELECT id, date::VARCHAR AS date, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id
    FROM transactions WINDOW w AS (ORDER BY date DESC, id DESC)""",
)
def neighbor_rows(led):
    return R.neighbor_rows(led.transactions)


@query(
    "categorize_plan",
    """SELECT id, date::VARCHAR AS date, greatest((SELECT count(*) FROM transactions WHERE category_id IS NULL) - 1000, 0) AS queued_beyond_run
    FROM transactions WHERE category_id IS NULL ORDER BY transactions.date DESC, id DESC LIMIT 1000""",
)
def categorize_plan(led):
    return R.categorize_plan(led.transactions)


@query(
    "imported_register_frame",
    """SELECT import_batch_id, account_id, min(date)::VARCHAR AS from_date, max(date)::VARCHAR AS to_date, count(*) AS added,
      count(*) FILTER (category_id IS NULL) AS uncategorized FROM transactions WHERE import_batch_id IS NOT NULL GROUP BY 1, 2""",
)
def imported_register_frame(led):
    return R.imported_register_frame(led.transactions)
