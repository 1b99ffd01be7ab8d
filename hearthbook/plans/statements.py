"""Statements against the books."""

from pyspark.sql import functions as F

from ..functions.dates import day_number
from ..operators import balances as B
from ..operators import statements as S
from ..operators.assign import nearest_first, one_to_one
from .registry import query
from .views_sql import assign_sql

MATCH = """
, sl AS (SELECT account_id, amount_cents, date, id AS left_id FROM statement_lines),
sr AS (SELECT account_id, amount_cents, date, id AS right_id FROM transactions)""" + assign_sql(
    "sl", "sr", ["account_id", "amount_cents"], nearest_first(5), "m"
)

CHECKED = MATCH + """
, checked AS (
  SELECT l.*, t.id AS matched_id, t.date AS matched_date, t.description AS matched_description,
    t.id IS NULL AND EXISTS (SELECT 1 FROM transactions o WHERE o.account_id = l.account_id
      AND o.amount_cents = -l.amount_cents AND abs(o.date - l.date) <= 5) AS sign_conflict
  FROM statement_lines l LEFT JOIN m ON m.left_id = l.id LEFT JOIN transactions t ON t.id = m.right_id
)"""

CLOSES = CHECKED + """
, closes AS (
  SELECT c.batch_id, c.matched, c.missing, c.conflicts, c.missing_cents, coalesce(b.balances, 0) AS balances, coalesce(b.replaces, 0) AS replaces
  FROM (SELECT batch_id, count(matched_id) AS matched, count(*) FILTER (matched_id IS NULL AND NOT sign_conflict) AS missing,
      count(*) FILTER (sign_conflict) AS conflicts,
      CAST(coalesce(sum(amount_cents) FILTER (matched_id IS NULL AND NOT sign_conflict), 0) AS BIGINT) AS missing_cents
    FROM checked GROUP BY 1) c
  LEFT JOIN (SELECT p.batch_id, count(*) AS balances, count(*) FILTER (s.balance_cents <> p.balance_cents) AS replaces
    FROM statement_balances p LEFT JOIN snapshots s ON s.account_id = p.account_id AND s.date = p.date GROUP BY 1) b ON b.batch_id = c.batch_id
)"""

# every tenth file prints no balance, and every tenth no opening one
_PRINTS = "batch_id % 10 <> 3 AND (batch_id % 10 <> 4 OR kind <> 'opening')"

TIE = f"""
, prints AS (SELECT * FROM statement_balances WHERE {_PRINTS}),
tie AS (
  SELECT p.batch_id, p.account_id, coalesce(l.n, 0) AS rows, CAST(coalesce(l.net, 0) - (p.closing - p.opening) AS BIGINT) AS off_by_cents,
    a.account_type NOT IN ('credit_card','line_of_credit','mortgage','loan') OR coalesce(p.highest < 0, true) AS signs_ok
  FROM (SELECT f.id AS batch_id, f.account_id, max(balance_cents) FILTER (b.kind = 'opening') AS opening,
      max(balance_cents) FILTER (b.kind = 'closing') AS closing, max(balance_cents) AS highest
    FROM batches f LEFT JOIN prints b ON b.batch_id = f.id GROUP BY 1, 2) p
  JOIN accounts a ON a.id = p.account_id
  LEFT JOIN (SELECT import_batch_id AS batch_id, count(*) n, sum(amount_cents) net FROM base GROUP BY 1) l ON l.batch_id = p.batch_id
)"""


def matches(led):
    return S.statement_match(led.statement_lines, led.transactions)


def checked(led):
    found = S.matched_lines(led.statement_lines, led.transactions, matches(led))
    return S.sign_conflicts(found, led.transactions)


@query("statement_match", MATCH + " SELECT left_id AS line_id, right_id AS matched_id, days FROM m")
def statement_match(led):
    return matches(led)


@query(
    "one_to_one_assign",
    MATCH + " SELECT left_id, right_id, days, left_choices, right_choices FROM m",
)
def one_to_one_assign(led):
    def side(df, name):
        return df.select(*S.KEYS, day_number(F.col("date")).alias("day"), F.col("id").alias(name))

    left, right = side(led.statement_lines, "left_id"), side(led.transactions, "right_id")
    return one_to_one(left, right, S.KEYS, nearest_first(5)).drop(*S.KEYS)


@query(
    "sign_conflict_match",
    CHECKED + " SELECT id, account_id, date::VARCHAR AS date, amount_cents FROM checked WHERE sign_conflict",
)
def sign_conflict_match(led):
    return checked(led).where("sign_conflict").select("id", "account_id", "date", "amount_cents")


def closes(led):
    effects = B.balance_replace_check(led.statement_balances, led.snapshots)
    return S.statement_close(checked(led), effects)


@query("statement_close", CLOSES + " SELECT * FROM closes")
def statement_close(led):
    return closes(led)


@query(
    "close_totals",
    CLOSES
    + """ SELECT CAST(sum(missing) AS BIGINT) AS adding, CAST(sum(balances) AS BIGINT) AS balances,
    CAST(sum(missing_cents) AS BIGINT) AS missing_cents FROM closes""",
)
def close_totals(led):
    return S.close_totals(closes(led))


def tie_out(led):
    lines = led.base.select(F.col("import_batch_id").alias("batch_id"), "amount_cents")
    files = led.batches.select(F.col("id").alias("batch_id"), "account_id")
    return S.statement_tie_out(files, lines, led.statement_balances.where(_PRINTS), led.accounts)


@query(
    "statement_tie_out",
    TIE
    + """ SELECT *, off_by_cents IS NULL OR off_by_cents <> 0 OR NOT signs_ok AS blocked,
      CASE WHEN off_by_cents IS NULL THEN 'a balance is missing' WHEN off_by_cents <> 0 THEN 'lines and balances differ'
        WHEN NOT signs_ok THEN 'a debt shows a credit' END AS reason FROM tie""",
)
def statement_tie_out(led):
    return tie_out(led)


@query(
    "statement_hold_check",
    TIE
    + """ SELECT t.batch_id, t.account_id, CASE WHEN blocked THEN 'does not tie out' ELSE 'contradicts balance on file' END AS reason,
      CASE WHEN NOT blocked THEN p.balance_cents - s.balance_cents END AS differs_by
    FROM (SELECT *, off_by_cents IS NULL OR off_by_cents <> 0 OR NOT signs_ok AS blocked FROM tie) t
    LEFT JOIN prints p ON p.batch_id = t.batch_id AND p.kind = 'closing'
    LEFT JOIN snapshots s ON s.account_id = p.account_id AND s.date = p.date AND s.balance_cents <> p.balance_cents
    WHERE blocked OR s.balance_cents IS NOT NULL""",
)
def statement_hold_check(led):
    return S.statement_hold_check(tie_out(led), led.statement_balances.where(_PRINTS), led.snapshots)


@query(
    "close_history",
    """SELECT b.session_id, s.status AS session_status,
      a.institution || ' · ' || a.name || CASE WHEN a.last_four IS NULL THEN '' ELSE ' ··' || a.last_four END AS label,
      min(b.period_start)::VARCHAR AS period_start, max(b.period_end)::VARCHAR AS period_end, count(*) AS statements,
      count(*) * 2 AS balances, CAST(sum(b.row_count) AS BIGINT) AS row_count
    FROM batches b JOIN sessions s ON s.id = b.session_id AND s.purpose = 'reconcile' JOIN accounts a ON a.id = b.account_id
    GROUP BY 1, 2, 3""",
)
def close_history(led):
    return S.close_history(led.batches, led.sessions, led.labelled_accounts, led.statement_balances)


@query(
    "close_sessions",
    """SELECT s.id AS session_id, s.status AS session_status, min(b.period_start)::VARCHAR AS period_start,
      max(b.period_end)::VARCHAR AS period_end, count(b.id) AS statements, 2 * count(b.id) AS balances,
      CAST(coalesce(sum(b.row_count), 0) AS BIGINT) AS row_count, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS inserted
    FROM (SELECT id, status FROM sessions WHERE purpose = 'reconcile' UNION ALL SELECT -1, 'open') s
    LEFT JOIN batches b ON b.session_id = s.id
    LEFT JOIN (SELECT import_batch_id, count(*) AS n FROM transactions GROUP BY 1) t ON t.import_batch_id = b.id GROUP BY 1, 2""",
)
def close_sessions(led):
    # one more session that has no files yet
    sessions = led.sessions.select("id", "status", "purpose")
    fresh = led.spark.sql("select -1L as id, 'open' as status, 'reconcile' as purpose")
    return S.close_sessions(sessions.unionByName(fresh), led.batches, led.statement_balances, led.transactions)
