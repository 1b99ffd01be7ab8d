"""Balances and reconciliation."""

from pyspark.sql import functions as F

from ..operators import balances as B
from ..operators.staging import staged_included
from . import staging
from .registry import query

WINDOWS = """
, ledger_act AS (SELECT account_id, date, count(*) AS n, sum(amount_cents) AS cents FROM transactions GROUP BY 1, 2),
paid_in AS (SELECT transfer_account_id AS account_id, date, count(*) AS n, sum(-amount_cents) AS cents
  FROM transactions WHERE transfer_account_id IS NOT NULL GROUP BY 1, 2),
pairs AS (
  SELECT s.account_id, lag(s.date) OVER w AS from_date, s.date AS to_date,
    lag(s.balance_cents) OVER w AS from_cents, s.balance_cents AS to_cents, a.kind, a.name AS account_name
  FROM snapshots s JOIN accounts a ON a.id = s.account_id WINDOW w AS (PARTITION BY s.account_id ORDER BY s.date)
),
acts AS (
  SELECT l.* FROM ledger_act l JOIN accounts a ON a.id = l.account_id AND a.kind = 'transaction'
  UNION ALL SELECT p.* FROM paid_in p JOIN accounts a ON a.id = p.account_id AND a.kind = 'balance'
),
windows0 AS (
  SELECT p.account_id, p.account_name, p.kind, p.from_date, p.to_date, p.from_cents, p.to_cents,
    CASE WHEN p.from_date IS NOT NULL THEN CAST(coalesce(sum(x.n), 0) AS BIGINT) END AS txn_count,
    CASE WHEN p.from_date IS NOT NULL THEN CAST(coalesce(sum(x.cents), 0) AS BIGINT) END AS txn_sum_cents
  FROM pairs p LEFT JOIN acts x ON x.account_id = p.account_id AND x.date > p.from_date AND x.date <= p.to_date
  GROUP BY p.account_id, p.account_name, p.kind, p.from_date, p.to_date, p.from_cents, p.to_cents
),
windows AS (
  SELECT *, to_cents - from_cents - txn_sum_cents AS gap_cents,
    CASE WHEN from_date IS NULL THEN 'unanchored' WHEN to_cents - from_cents - txn_sum_cents = 0 THEN 'ok'
      WHEN kind = 'balance' THEN 'movement' ELSE 'mismatch' END AS status
  FROM windows0
)"""

CLEARED = WINDOWS + """
, cleared AS (
  SELECT t.*, w.from_date, w.to_date,
    CASE w.status WHEN 'ok' THEN 'reconciled' WHEN 'mismatch' THEN 'mismatch' ELSE 'open' END AS cleared
  FROM transactions t LEFT JOIN windows w ON w.account_id = t.account_id AND w.kind = 'transaction'
    AND t.date > w.from_date AND t.date <= w.to_date
)"""

BALANCES = """
, anchors AS (SELECT account_id, max(date) AS anchor_date, arg_max(balance_cents, date) AS anchor_cents FROM snapshots GROUP BY 1),
balances AS (
  SELECT a.id AS account_id, a.name, a.kind,
    a.account_type IN ('credit_card','line_of_credit','mortgage','loan') AS is_liability, a.is_active,
    n.anchor_date, n.anchor_cents,
    CAST(CASE WHEN a.kind = 'transaction' THEN coalesce(sum(t.amount_cents), 0) ELSE 0 END AS BIGINT) AS activity_cents,
    CASE WHEN a.kind = 'transaction' THEN count(t.id) ELSE 0 END AS activity_count,
    CAST(CASE WHEN a.kind = 'transaction' THEN coalesce(n.anchor_cents, 0) + coalesce(sum(t.amount_cents), 0)
      ELSE n.anchor_cents END AS BIGINT) AS current_cents,
    greatest(n.anchor_date, CASE WHEN a.kind = 'transaction' THEN max(t.date) END) AS as_of,
    n.anchor_date IS NULL AS unanchored
  FROM accounts a LEFT JOIN anchors n ON n.account_id = a.id
  LEFT JOIN transactions t ON t.account_id = a.id AND (n.anchor_date IS NULL OR t.date > n.anchor_date)
  GROUP BY a.id, a.name, a.kind, a.account_type, a.is_active, n.anchor_date, n.anchor_cents
)"""


@query("latest_anchor", BALANCES + " SELECT account_id, anchor_date::VARCHAR AS anchor_date, anchor_cents FROM anchors")
def latest_anchor(led):
    return B.latest_anchor(led.snapshots)


def balances(led):
    return B.account_balances(led.accounts, led.snapshots, led.transactions)


@query(
    "account_balances",
    BALANCES + " SELECT * REPLACE (anchor_date::VARCHAR AS anchor_date, as_of::VARCHAR AS as_of) FROM balances",
)
def account_balances(led):
    return balances(led)


@query(
    "net_worth",
    BALANCES
    + """ SELECT CAST(sum(CASE WHEN unanchored THEN 0 ELSE coalesce(current_cents, 0) END) AS BIGINT) AS net_worth_cents,
    count(*) FILTER (unanchored) AS unanchored_count FROM balances WHERE is_active""",
)
def net_worth(led):
    return B.net_worth(balances(led))


@query(
    "snapshot_history",
    """SELECT account_id, place, date::VARCHAR AS date, balance_cents, source FROM (
      SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date DESC) AS place FROM snapshots) WHERE place <= 24""",
)
def snapshot_history(led):
    return B.snapshot_history(led.snapshots)


@query(
    "balance_trends",
    """SELECT s.account_id, a.name, s.date::VARCHAR AS date, s.balance_cents
    FROM snapshots s JOIN accounts a ON a.id = s.account_id AND a.is_active""",
)
def balance_trends(led):
    return B.balance_trends(led.accounts, led.snapshots)


_WINDOW_COLS = """account_id, from_date::VARCHAR AS from_date, to_date::VARCHAR AS to_date, from_cents, to_cents,
  txn_count, txn_sum_cents, gap_cents, status"""


@query("reconcile_windows", WINDOWS + f" SELECT {_WINDOW_COLS} FROM windows WHERE kind = 'transaction'")
def reconcile_windows(led):
    ledgers = led.accounts.where("kind = 'transaction'").select(F.col("id").alias("account_id"))
    snaps = led.snapshots.join(ledgers, "account_id", "left_semi")
    return B.reconcile_windows(snaps, B.daily_activity(led.transactions))


def all_windows(led):
    return B.reconcile_accounts(led.accounts, led.snapshots, led.transactions)


@query("reconcile_accounts", WINDOWS + f" SELECT account_name, kind, {_WINDOW_COLS} FROM windows")
def reconcile_accounts(led):
    return all_windows(led)


@query(
    "reconcile_status",
    WINDOWS
    + """ SELECT a.id AS account_id, a.name, a.kind, count(w.status) FILTER (w.status <> 'unanchored') AS checked,
      count(w.status) FILTER (w.status = 'mismatch') AS mismatches,
      CASE WHEN count(w.status) FILTER (w.status = 'mismatch') > 0 THEN 'mismatch'
        WHEN count(w.status) FILTER (w.status <> 'unanchored') > 0 THEN 'ok' ELSE 'unanchored' END AS status
    FROM accounts a LEFT JOIN windows w ON w.account_id = a.id GROUP BY 1, 2, 3""",
)
def reconcile_status(led):
    return B.account_status(led.accounts, all_windows(led))


@query(
    "cleared_windows",
    WINDOWS
    + """ SELECT account_id, from_date::VARCHAR AS from_date, to_date::VARCHAR AS to_date, txn_count, txn_sum_cents,
      CASE WHEN gap_cents = 0 THEN 'ok' ELSE 'mismatch' END AS status FROM windows WHERE kind = 'transaction' AND from_date IS NOT NULL""",
)
def cleared_windows(led):
    ledgers = led.accounts.where("kind = 'transaction'").select(F.col("id").alias("account_id"))
    return B.cleared_windows(led.snapshots.join(ledgers, "account_id", "left_semi"), led.transactions)


@query(
    "cleared_window_join",
    CLEARED + " SELECT id, account_id, date::VARCHAR AS date, from_date::VARCHAR AS from_date, to_date::VARCHAR AS to_date FROM cleared",
)
def cleared_window_join(led):
    return B.cleared_state(led.snapshots, led.transactions).select(
        "id", "account_id", "date", "from_date", "to_date"
    )


@query("cleared_state", CLEARED + " SELECT id, account_id, date::VARCHAR AS date, amount_cents, cleared FROM cleared")
def cleared_state(led):
    return B.cleared_state(led.snapshots, led.transactions).select(
        "id", "account_id", "date", "amount_cents", "cleared"
    )


@query(
    "reconcile_issues",
    WINDOWS
    + """, hits AS (
      SELECT w.account_id, w.to_date, w.gap_cents, t.id,
        CASE WHEN t.amount_cents = -w.gap_cents THEN 'extra_row' ELSE 'wrong_sign' END AS issue,
        count(*) OVER (PARTITION BY w.account_id, w.to_date, t.amount_cents, t.date, t.description) AS n
      FROM windows w JOIN transactions t ON t.account_id = w.account_id AND t.date > w.from_date AND t.date <= w.to_date
      WHERE w.status = 'mismatch' AND (t.amount_cents = -w.gap_cents OR t.amount_cents * 2 = -w.gap_cents)),
    named AS (SELECT *, CASE issue WHEN 'extra_row' THEN 'warning' ELSE 'info' END AS severity FROM hits
      UNION ALL SELECT * REPLACE ('repeated_row' AS issue), 'error' FROM hits WHERE issue = 'extra_row' AND n > 1)
    SELECT account_id, to_date::VARCHAR AS to_date, gap_cents, id, issue, severity,
      CASE issue WHEN 'repeated_row' THEN 'the same row is there more than once and equals the gap'
        WHEN 'extra_row' THEN 'one row equals the gap' ELSE 'one row equals half the gap' END AS message,
      CASE issue WHEN 'wrong_sign' THEN 'turn its sign' ELSE 'delete it if it is not on the statement' END AS fix
    FROM named""",
)
def reconcile_issues(led):
    return B.reconcile_issues(led.snapshots, led.transactions)


_PENDING = staging.STAGED + """
, pend AS (SELECT i.id, i.account_id, i.date, i.amount_cents FROM included i JOIN batches b ON b.id = i.batch_id AND b.status = 'review'),
ledger_plus AS (SELECT id, account_id, date, amount_cents FROM transactions UNION ALL SELECT * FROM pend),
snap_plus AS (
  SELECT coalesce(b.account_id, s.account_id) AS account_id, coalesce(b.date, s.date) AS date,
    coalesce(b.balance_cents, s.balance_cents) AS balance_cents
  FROM snapshots s FULL JOIN (SELECT p.account_id, p.date, max(balance_cents) AS balance_cents FROM statement_balances p
    JOIN batches f ON f.id = p.batch_id AND f.status = 'review' WHERE p.kind = 'closing' GROUP BY 1, 2) b
  ON b.account_id = s.account_id AND b.date = s.date
)"""

_UPSERT = """
, snap_plus AS (
  SELECT coalesce(b.account_id, s.account_id) AS account_id, coalesce(b.date, s.date) AS date,
    coalesce(b.balance_cents, s.balance_cents) AS balance_cents
  FROM snapshots s FULL JOIN (SELECT account_id, date, max(balance_cents) AS balance_cents FROM statement_balances
    WHERE kind = 'closing' GROUP BY 1, 2) b ON b.account_id = s.account_id AND b.date = s.date
)"""


def closing(led):
    return led.statement_balances.where("kind = 'closing'").withColumn("source", F.lit("import"))


@query(
    "ledger_plus_pending",
    _PENDING
    + """ SELECT p.account_id, p.to_date::VARCHAR AS to_date, p.to_cents - p.from_cents - coalesce(CAST(sum(l.amount_cents) AS BIGINT), 0) AS gap_cents
    FROM (SELECT account_id, date AS to_date, balance_cents AS to_cents, lag(date) OVER w AS from_date, lag(balance_cents) OVER w AS from_cents
      FROM snap_plus WINDOW w AS (PARTITION BY account_id ORDER BY date)) p
    LEFT JOIN ledger_plus l ON l.account_id = p.account_id AND l.date > p.from_date AND l.date <= p.to_date
    GROUP BY p.account_id, p.to_date, p.to_cents, p.from_cents""",
)
def ledger_plus_pending(led):
    led.hold_base()
    review = led.batches.where("status = 'review'").select(F.col("id").alias("batch_id"))
    rows = staged_included(staging.final(led)).join(review, "batch_id", "left_semi")
    prints = closing(led).join(review, "batch_id", "left_semi")
    rows, snaps = B.with_pending(led.transactions, led.snapshots, rows, prints)
    windows = B.reconcile_windows(snaps, B.daily_activity(rows))
    return windows.select("account_id", "to_date", "gap_cents")


@query(
    "balance_upsert",
    _UPSERT + " SELECT account_id, date::VARCHAR AS date, balance_cents FROM snap_plus",
)
def balance_upsert(led):
    return B.balance_upsert(led.snapshots, closing(led)).select("account_id", "date", "balance_cents")


@query(
    "balance_replace_check",
    """SELECT b.batch_id, b.account_id, b.kind, b.date::VARCHAR AS date, b.balance_cents, s.balance_cents AS on_file_cents,
      CASE WHEN s.balance_cents IS NULL THEN 'new' WHEN s.balance_cents = b.balance_cents THEN 'already_on_file'
        ELSE 'replaces' END AS effect
    FROM statement_balances b LEFT JOIN snapshots s ON s.account_id = b.account_id AND s.date = b.date""",
)
def balance_replace_check(led):
    return B.balance_replace_check(led.statement_balances, led.snapshots)
