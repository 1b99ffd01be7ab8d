"""Transfers between own accounts."""

from pyspark.sql import functions as F

from ..operators import hints as H
from ..operators import transfers as X
from .registry import query

START, END = "1995-01-01", "2001-12-31"

PAIRS = """
, free AS (SELECT id, account_id, date, amount_cents FROM transactions
  WHERE transfer_peer_id IS NULL AND transfer_account_id IS NULL AND amount_cents <> 0),
cand AS (
  SELECT o.id AS out_id, i.id AS in_id, o.account_id AS out_account_id, i.account_id AS in_account_id, o.date AS out_date,
    o.amount_cents, abs(date_diff('day', o.date, i.date)) AS day_diff
  FROM free o JOIN free i ON i.amount_cents = -o.amount_cents AND i.account_id <> o.account_id
    AND abs(date_diff('day', o.date, i.date)) <= 3
  WHERE o.amount_cents < 0 AND NOT EXISTS (SELECT 1 FROM rejections r
    WHERE r.txn_a_id = least(o.id, i.id) AND r.txn_b_id = greatest(o.id, i.id))
)"""

AUTO = PAIRS + """
, auto AS (SELECT * FROM cand
  QUALIFY count(*) OVER (PARTITION BY out_id) = 1 AND count(*) OVER (PARTITION BY in_id) = 1)"""


@query(
    "transfer_candidates",
    PAIRS
    + """ SELECT out_id AS id, out_account_id AS account_id, out_date::VARCHAR AS date, amount_cents, count(*) AS candidates,
      min(day_diff) AS nearest_days, CASE WHEN count(*) = 1 THEN min(in_id) END AS only_partner_id
    FROM cand GROUP BY out_id, out_account_id, out_date, amount_cents""",
)
def transfer_candidates(led):
    return X.transfer_candidates(led.transactions, led.rejections)


@query(
    "transfer_leg_candidates",
    PAIRS
    + """ SELECT f.id, f.amount_cents, count(c.id) AS candidates, min(c.day_diff) AS nearest_days
    FROM free f LEFT JOIN (SELECT out_id AS id, day_diff FROM cand UNION ALL SELECT in_id, day_diff FROM cand) c ON c.id = f.id
    GROUP BY f.id, f.amount_cents""",
)
def transfer_leg_candidates(led):
    found = X.leg_candidates(led.transactions, led.rejections)
    return found.select("id", "amount_cents", "candidates", "nearest_days")


def newest_ambiguous(led):
    """The leg a user would open next: the newest one with several candidates."""
    found = X.transfer_candidates(led.transactions, led.rejections).where("candidates > 1")
    return found.orderBy(F.col("date").desc(), F.col("id").desc()).limit(1)


@query(
    "candidates_for_txn",
    PAIRS
    + """, asked AS (SELECT out_id FROM cand GROUP BY out_id, out_date HAVING count(*) > 1 ORDER BY out_date DESC, out_id DESC LIMIT 1)
    SELECT c.out_id AS asked_id, c.in_id AS peer_id, c.in_account_id AS peer_account_id, t.date::VARCHAR AS peer_date, c.day_diff
    FROM cand c JOIN asked a ON a.out_id = c.out_id JOIN transactions t ON t.id = c.in_id""",
)
def candidates_for_txn(led):
    return X.candidates_for(led.transactions, led.rejections, newest_ambiguous(led))


@query(
    "manual_peer_candidates",
    PAIRS
    + """, asked AS (SELECT out_id AS id, out_account_id FROM cand GROUP BY out_id, out_date, out_account_id HAVING count(*) > 1
      ORDER BY out_date DESC, out_id DESC LIMIT 1)
    SELECT a.id AS asked_id, p.id AS peer_id, p.account_id AS peer_account_id, p.date::VARCHAR AS peer_date,
      abs(date_diff('day', p.date, m.date)) AS day_diff
    FROM asked a JOIN free m ON m.id = a.id JOIN free p ON p.amount_cents = -m.amount_cents AND p.account_id <> m.account_id
      AND abs(date_diff('day', p.date, m.date)) <= 30
    WHERE p.account_id IN (SELECT in_account_id FROM cand WHERE out_id = a.id)""",
)
def manual_peer_candidates(led):
    asked = newest_ambiguous(led)
    # any account one of its candidates lies in
    near = X.candidates_for(led.transactions, led.rejections, asked)
    targets = near.select(
        F.col("asked_id").alias("id"), F.col("peer_account_id").alias("target_account_id")
    ).distinct()
    return X.manual_peer_candidates(led.transactions, led.rejections, targets)


@query(
    "rejected_pair_anti",
    """SELECT m.id AS out_id, m.id + 10000000000000 AS in_id FROM base m
    WHERE m.mirrored AND (m.id, m.id + 10000000000000) NOT IN (SELECT (txn_a_id, txn_b_id) FROM rejections)""",
)
def rejected_pair_anti(led):
    mirror = led.base.where("mirrored").select(
        F.col("id").alias("txn_a_id"), (F.col("id") + 10_000_000_000_000).alias("txn_b_id")
    )
    kept = X.rejected_pair_anti(mirror, led.rejections)
    return kept.select(F.col("txn_a_id").alias("out_id"), F.col("txn_b_id").alias("in_id"))


@query(
    "auto_link_transfers",
    AUTO + " SELECT out_id, in_id, out_account_id, in_account_id, amount_cents, day_diff FROM auto",
)
def auto_link_transfers(led):
    return X.auto_link(led.transactions, led.rejections)


@query(
    "link_category",
    AUTO
    + """ SELECT out_id, in_id, CASE WHEN a.account_type = 'credit_card' THEN 'Credit Card Payment'
      WHEN a.account_type IN ('line_of_credit','mortgage','loan') THEN 'Loan Payment' ELSE 'Transfer' END AS category_name
    FROM auto JOIN accounts a ON a.id = in_account_id""",
)
def link_category(led):
    pairs = X.auto_link(led.transactions, led.rejections)
    return X.link_category(pairs, led.accounts, led.categories).select("out_id", "in_id", "category_name")


@query(
    "linked_transfers",
    """SELECT o.id AS out_id, i.id AS in_id, a.name AS out_account, b.name AS in_account, o.date::VARCHAR AS out_date,
      i.date::VARCHAR AS in_date, o.amount_cents
    FROM transactions o JOIN transactions i ON i.id = o.transfer_peer_id JOIN accounts a ON a.id = o.account_id
    JOIN accounts b ON b.id = i.account_id WHERE o.amount_cents < 0""",
)
def linked_transfers(led):
    return X.linked_transfers(led.transactions, led.accounts)


@query(
    "account_linked_transfers",
    """SELECT t.id, t.date::VARCHAR AS date, a.name AS account_name, b.name AS target_account_name, t.description, t.amount_cents
    FROM transactions t JOIN accounts a ON a.id = t.account_id JOIN accounts b ON b.id = t.transfer_account_id""",
)
def account_linked_transfers(led):
    return X.account_linked_transfers(led.transactions, led.accounts)


@query(
    "unmatched_transfer_legs",
    """SELECT t.id, t.account_id, t.date::VARCHAR AS date, t.amount_cents FROM transactions t
    JOIN categories c ON c.id = t.category_id AND c.spending_class = 'transfer'
    WHERE t.transfer_peer_id IS NULL AND t.transfer_account_id IS NULL""",
)
def unmatched_transfer_legs(led):
    rows = X.unmatched_transfer_legs(led.transactions, led.categories)
    return rows.select("id", "account_id", "date", "amount_cents")


@query(
    "transfer_volume",
    """SELECT CAST(sum(abs(amount_cents)) AS BIGINT) AS moved_cents FROM transactions
    WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
      AND (transfer_account_id IS NOT NULL OR (transfer_peer_id IS NOT NULL AND amount_cents < 0))""",
)
def transfer_volume(led):
    return X.transfer_volume(led.transactions, START, END)


HINT = """
, found AS (
  SELECT text,
    (SELECT count(*) FROM cands a WHERE regexp_matches(a.last_four, '^[0-9]{4}$')
      AND list_contains(list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda r: length(r) >= 4), lambda r: right(r, 4)), a.last_four)) AS fn,
    (SELECT min(id) FROM cands a WHERE regexp_matches(a.last_four, '^[0-9]{4}$')
      AND list_contains(list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda r: length(r) >= 4), lambda r: right(r, 4)), a.last_four)) AS fid,
    (SELECT count(*) FROM cands a WHERE length(a.name) >= 4 AND contains(text, lower(a.name))) AS nn,
    (SELECT min(id) FROM cands a WHERE length(a.name) >= 4 AND contains(text, lower(a.name))) AS nid,
    (SELECT count(*) FROM cands a WHERE length(a.institution) >= 3 AND contains(text, lower(a.institution))) AS sn,
    (SELECT min(id) FROM cands a WHERE length(a.institution) >= 3 AND contains(text, lower(a.institution))) AS sid
  FROM texts
),
judged AS (
  SELECT text, CASE WHEN fn = 1 OR (fn = 0 AND nn = 1) OR (fn = 0 AND nn = 0 AND sn = 1) THEN 'match'
      WHEN fn + nn + sn > 0 THEN 'ambiguous' ELSE 'none' END AS outcome,
    CASE WHEN fn > 0 THEN 'last_four' WHEN nn > 0 THEN 'name' WHEN sn > 0 THEN 'institution' END AS strength,
    CASE WHEN fn = 1 THEN fid WHEN fn = 0 AND nn = 1 THEN nid WHEN fn = 0 AND nn = 0 AND sn = 1 THEN sid END AS account_id
  FROM found
)"""

FILE_TEXT = """CASE c_custkey % 5 WHEN 0 THEN 'Statement xxxx' || right(c_name, 4) || '.pdf' WHEN 1 THEN c_name || ' ' || n_name || ' Jan.pdf'
    WHEN 2 THEN 'export-' || replace(n_name, '_', '') || '.pdf' WHEN 3 THEN 'from ' || n_name || ' bank.pdf' ELSE 'scan of page.pdf' END"""


def statement_files(led):
    """One file per customer, named in one of five habits."""
    nation = led.table("nation")
    rows = led.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    habit = F.col("c_custkey") % 5
    return rows.select(
        F.col("c_custkey").alias("file_id"),
        F.when(habit == 0, F.concat(F.lit("Statement xxxx"), F.right("c_name", F.lit(4)), F.lit(".pdf")))
        .when(habit == 1, F.concat("c_name", F.lit(" "), "n_name", F.lit(" Jan.pdf")))
        .when(habit == 2, F.concat(F.lit("export-"), F.replace("n_name", F.lit("_"), F.lit("")), F.lit(".pdf")))
        .when(habit == 3, F.concat(F.lit("from "), "n_name", F.lit(" bank.pdf")))
        .otherwise(F.lit("scan of page.pdf"))
        .alias("hint"),
    )


@query(
    "account_hint_match",
    f""", cands AS (SELECT * FROM accounts),
    texts AS (SELECT DISTINCT lower({FILE_TEXT}) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
    + HINT
    + " SELECT * FROM judged",
)
def account_hint_match(led):
    return H.account_hint_match(statement_files(led).select(F.col("hint").alias("text")), led.accounts)


@query(
    "folder_account_assign",
    f""", cands AS (SELECT * FROM accounts),
    files AS (SELECT c_custkey AS file_id, {FILE_TEXT} AS hint FROM customer JOIN nation ON c_nationkey = n_nationkey),
    texts AS (SELECT DISTINCT lower(hint) AS text FROM files)"""
    + HINT
    + """ SELECT file_id, hint, CASE outcome WHEN 'match' THEN 'assigned' WHEN 'ambiguous' THEN 'question' ELSE 'new_account' END AS assignment,
      strength, account_id FROM files JOIN judged ON judged.text = lower(hint)""",
)
def folder_account_assign(led):
    return H.folder_account_assign(statement_files(led), led.accounts)


LINKS = """, cands AS (SELECT * FROM accounts WHERE kind = 'balance'),
free_rows AS (SELECT * FROM transactions WHERE transfer_peer_id IS NULL AND transfer_account_id IS NULL),
texts AS (SELECT DISTINCT lower(description) AS text FROM free_rows)""" + HINT + """
, hist AS (SELECT account_id, merchant, min(transfer_account_id) AS target FROM transactions WHERE transfer_account_id IS NOT NULL
  GROUP BY 1, 2 HAVING count(DISTINCT transfer_account_id) = 1),
links AS (
  SELECT f.id, f.account_id, f.date, f.amount_cents, coalesce(h.target, j.account_id) AS target_account_id,
    CASE WHEN h.target IS NOT NULL THEN 'merchant pointed there before'
      WHEN j.strength IN ('last_four','name') AND m THEN 'named and reads like money moving'
      WHEN j.strength IN ('last_four','name') THEN 'wording does not read like money moving'
      ELSE 'only the institution matched' END AS reason,
    h.target IS NOT NULL OR (coalesce(j.strength IN ('last_four','name'), false) AND m) AS link
  FROM (SELECT *, regexp_matches(description, '\\b(TRANSFER|XFER|PAYMENT|PMT|PYMT|CONTRIBUTION|DEPOSIT|AUTOPAY|ACH)\\b') AS m FROM free_rows) f
  LEFT JOIN judged j ON j.text = lower(f.description) AND j.outcome = 'match'
  LEFT JOIN hist h ON h.account_id = f.account_id AND h.merchant = f.merchant
  WHERE h.target IS NOT NULL OR j.account_id IS NOT NULL
)"""


@query(
    "account_transfer_link",
    LINKS + " SELECT id, account_id, date::VARCHAR AS date, amount_cents, target_account_id, reason FROM links WHERE link",
)
def account_transfer_link(led):
    return H.account_links(led.transactions, led.accounts).where("link").drop("link")


@query(
    "account_link_suggestions",
    LINKS + " SELECT id, account_id, date::VARCHAR AS date, amount_cents, target_account_id, reason FROM links WHERE NOT link",
)
def account_link_suggestions(led):
    return H.account_links(led.transactions, led.accounts).where("not link").drop("link")
