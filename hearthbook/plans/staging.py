"""Duplicates, overlaps, commit."""

import uuid

from pyspark.sql import functions as F

from ..constants import BULK_FILE_STATUSES, BULK_RUNS_SHOWN, IMPORT_HISTORY_SHOWN
from ..operators import staging as S
from ..operators import bulk
from ..operators.balances import balance_replace_check
from ..session import cut_lineage, shared_folder
from ..sources.index import DedupeIndex
from .ingest import OCCURRENCE
from .registry import query

STAGED = OCCURRENCE + """
, socc AS (SELECT *, row_number() OVER (PARTITION BY batch_id, account_id, date, amount_cents, upper(trim(description)) ORDER BY id) AS occurrence FROM staged),
shash AS (SELECT *, sha256(CAST(date AS VARCHAR) || '|' || CAST(amount_cents AS VARCHAR) || '|' || upper(trim(description)) || '|'
  || CAST(occurrence AS VARCHAR)) AS dedupe_hash FROM socc),
judged AS (
  SELECT s.*, coalesce(e.id, n.id) AS duplicate_of_id,
    CASE WHEN e.id IS NOT NULL THEN 'duplicate' WHEN n.id IS NOT NULL THEN 'possible_duplicate' ELSE 'new' END AS status
  FROM shash s LEFT JOIN (SELECT account_id, dedupe_hash, min(id) AS id FROM hashed GROUP BY 1, 2) e USING (account_id, dedupe_hash)
  LEFT JOIN (SELECT account_id, date, amount_cents, min(id) AS id FROM transactions GROUP BY 1, 2, 3) n USING (account_id, date, amount_cents)
),
ranked AS (
  SELECT j.*, first_value(j.batch_id) OVER (PARTITION BY j.session_id, j.account_id, j.dedupe_hash
    ORDER BY CASE WHEN b.kind = 'statement' THEN 0 ELSE 1 END, b.row_count DESC, j.batch_id) AS winner
  FROM judged j JOIN batches b ON b.id = j.batch_id
),
final AS (SELECT *, CASE WHEN session_id IS NOT NULL AND winner <> batch_id THEN winner END AS superseded_by_batch_id FROM ranked),
included AS (SELECT * FROM final WHERE status IN ('new', 'possible_duplicate') AND superseded_by_batch_id IS NULL)"""


def hashed_ledger(led, *more):
    """Rows with their line's hash; only what is asked for goes through the sort."""
    rows = led.transactions.select("id", "account_id", "date", "amount_cents", "description", *more)
    return S.with_dedupe_key(rows, ["account_id"])


def ledger_index(led):
    """The ledger's index, entered once; each commit would keep it up."""
    if "dedupe_index" not in led.__dict__:
        name = f"dedupe_{uuid.uuid4().hex}"
        index = DedupeIndex(led.spark, name, f"{shared_folder(led.spark)}/{name}", max(2, led.spark.sparkContext.defaultParallelism))
        index.add(hashed_ledger(led))
        led.dedupe_index = index
    return led.dedupe_index


def staged_lines(led):
    """Staged rows with their keys; written out, as all queries below read them."""
    if "staged_lines" not in led.__dict__:
        led.staged_lines = cut_lineage(S.with_dedupe_key(led.staged, ["batch_id", "account_id"]))
    return led.staged_lines


def judged(led, rows):
    return S.classify_staged(rows, *ledger_index(led).around(staged_lines(led)))


def final(led, unknown=False):
    """Staged rows with their copies in other files, then those in the books, marked."""
    led.hold_base()
    return judged(led, S.cross_file_supersede(staged_lines(led), led.batches, unknown))


@query("exact_dedupe", STAGED + " SELECT id, batch_id, duplicate_of_id FROM judged WHERE status = 'duplicate'")
def exact_dedupe(led):
    rows = staged_lines(led)
    found = S.exact_dedupe(rows, ledger_index(led).around(rows)[0])
    return found.where("duplicate_of_id is not null").select("id", "batch_id", "duplicate_of_id")


@query("soft_dedupe", STAGED + " SELECT id, batch_id, duplicate_of_id FROM judged WHERE status = 'possible_duplicate'")
def soft_dedupe(led):
    return S.soft_dedupe(judged(led, staged_lines(led))).select("id", "batch_id", "duplicate_of_id")


@query("cross_file_supersede", STAGED + " SELECT id, batch_id, session_id, superseded_by_batch_id FROM final")
def cross_file_supersede(led):
    found = S.cross_file_supersede(staged_lines(led), led.batches)
    return found.select("id", "batch_id", "session_id", "superseded_by_batch_id")


@query("staged_included", STAGED + " SELECT id, batch_id, account_id, date::VARCHAR AS date, amount_cents, status FROM included")
def staged_included(led):
    return S.staged_included(final(led)).select("id", "batch_id", "account_id", "date", "amount_cents", "status")


def staged_all(led, unknown=False):
    """Staged transactions and staged balances of the same files."""
    rows = final(led, unknown).select("batch_id", F.lit("transaction").alias("row_kind"), "status", "superseded_by_batch_id")
    balances = led.statement_balances.select(
        "batch_id",
        F.lit("balance").alias("row_kind"),
        F.when(F.col("kind") == "opening", F.lit("excluded")).otherwise(F.lit("new")).alias("status"),
        F.lit(None).cast("long").alias("superseded_by_batch_id"),
    )
    return rows.unionByName(balances)


@query(
    "staged_counts",
    STAGED
    + """, ranked_all AS (
      SELECT j.*, first_value(j.batch_id) OVER (PARTITION BY j.session_id, j.account_id, j.dedupe_hash
        ORDER BY CASE WHEN b.kind = 'statement' THEN 0 ELSE 1 END, coalesce(b.row_count, 0) DESC, j.batch_id) AS winner
      FROM judged j LEFT JOIN batches b ON b.id = j.batch_id),
    every AS (SELECT batch_id, 'transaction' AS row_kind, status, CASE WHEN session_id IS NOT NULL AND winner <> batch_id THEN winner END AS superseded_by_batch_id FROM ranked_all
      UNION ALL SELECT batch_id, 'balance', CASE kind WHEN 'opening' THEN 'excluded' ELSE 'new' END, NULL FROM statement_balances),
    provided AS (SELECT batch_id, to_json(list({'filename': filename, 'count': n} ORDER BY filename))::VARCHAR AS files
      FROM (SELECT e.batch_id, coalesce(b.filename, '#' || e.superseded_by_batch_id) AS filename, count(*) AS n FROM every e
        LEFT JOIN batches b ON b.id = e.superseded_by_batch_id WHERE e.superseded_by_batch_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    counted AS (SELECT batch_id,
      count(*) FILTER (row_kind = 'transaction' AND superseded_by_batch_id IS NULL AND status IN ('new','possible_duplicate')) AS txn_new,
      count(*) FILTER (row_kind = 'transaction' AND superseded_by_batch_id IS NULL AND status = 'duplicate') AS txn_dupe,
      count(*) FILTER (row_kind = 'transaction' AND superseded_by_batch_id IS NULL AND status = 'excluded') AS txn_excluded,
      count(*) FILTER (row_kind = 'balance' AND status NOT IN ('excluded','duplicate')) AS balances,
      count(*) FILTER (row_kind = 'transaction' AND superseded_by_batch_id IS NOT NULL) AS superseded
    FROM every GROUP BY 1)
    SELECT c.*, coalesce(p.files, '[]') AS superseded_by FROM counted c LEFT JOIN provided p ON p.batch_id IS NOT DISTINCT FROM c.batch_id""",
)
def staged_counts(led):
    return S.staged_counts(staged_all(led, unknown=True), led.batches)


@query(
    "superseded_by_file",
    STAGED
    + """ SELECT f.batch_id, b.filename, count(*) AS rows FROM final f JOIN batches b ON b.id = f.superseded_by_batch_id
    GROUP BY 1, 2""",
)
def superseded_by_file(led):
    return S.superseded_by_file(staged_all(led), led.batches)


@query(
    "owned_rows_semi",
    "SELECT id, batch_id FROM staged WHERE batch_id IN (SELECT id FROM batches WHERE session_id IS NOT NULL)",
)
def owned_rows_semi(led):
    return S.owned_rows(led.staged, led.batches).select("id", "batch_id")


@query(
    "overlapping_batches",
    """SELECT r.id, r.account_id, r.filename, r.period_start::VARCHAR AS period_start, r.period_end::VARCHAR AS period_end,
      count(c.id) AS overlapping
    FROM batches r LEFT JOIN batches c ON c.account_id = r.account_id AND c.status = 'committed'
      AND c.period_start <= r.period_end AND r.period_start <= c.period_end
    WHERE r.status = 'review' GROUP BY 1, 2, 3, 4, 5""",
)
def overlapping_batches(led):
    return S.overlap_counts(led.batches)


@query(
    "overlapping_files",
    """SELECT r.id, c.id AS other_id FROM batches r JOIN batches c ON c.account_id = r.account_id AND c.status = 'committed'
      AND c.period_start <= r.period_end AND r.period_start <= c.period_end
    WHERE r.status = 'review'""",
)
def overlapping_files(led):
    return S.overlapping_files(led.batches)


@query(
    "prior_file_warning",
    """SELECT b.id, b.file_hash, f.first_id FROM batches b
    JOIN (SELECT file_hash, min(id) AS first_id FROM batches GROUP BY 1) f ON f.file_hash = b.file_hash AND b.id > f.first_id""",
)
def prior_file_warning(led):
    return S.prior_file_warning(led.batches)


@query(
    "import_history",
    """SELECT b.id, b.session_id, b.filename, b.kind, b.status, b.period_start::VARCHAR AS period_start, b.period_end::VARCHAR AS period_end,
      b.row_count, a.name AS account_name
    FROM batches b LEFT JOIN accounts a ON a.id = b.account_id LEFT JOIN sessions s ON s.id = b.session_id
    WHERE b.session_id IS NULL OR s.purpose = 'import' ORDER BY b.id DESC LIMIT 25""",
)
def import_history(led):
    return S.import_history(led.batches, led.accounts, led.sessions, IMPORT_HISTORY_SHOWN)


_STATUS_SQL = "(['" + "','".join(BULK_FILE_STATUSES) + "'])[b.id % 9 + 1]"


@query(
    "bulk_run_files",
    """SELECT s.id, s.status, count(b.id) AS files FROM sessions s LEFT JOIN batches b ON b.session_id = s.id
    WHERE s.purpose = 'bulk' GROUP BY 1, 2 ORDER BY s.id DESC LIMIT 12""",
)
def bulk_run_files(led):
    return bulk.bulk_run_files(led.sessions, led.bulk_files, BULK_RUNS_SHOWN)


@query(
    "bulk_progress",
    f""", files AS (SELECT b.session_id, {_STATUS_SQL} AS status FROM batches b JOIN sessions s ON s.id = b.session_id AND s.purpose = 'bulk')
    SELECT session_id, count(*) AS total, """
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in BULK_FILE_STATUSES)
    + """, count(*) FILTER (status IN ('categorized','committed','skipped','failed','held')) AS finished FROM files GROUP BY 1""",
)
def bulk_progress(led):
    return bulk.bulk_progress(led.bulk_files)


COMMITTED = STAGED + """, typed AS (SELECT i.*, a.account_type, regexp_replace(i.description, '\\s*#\\s*\\d+.*$', '') AS merchant
  FROM included i JOIN accounts a ON a.id = i.account_id JOIN batches b ON b.id = i.batch_id AND b.status = 'review'
  WHERE NOT EXISTS (SELECT 1 FROM hashed h WHERE h.account_id = i.account_id AND h.dedupe_hash = i.dedupe_hash)),
filed AS (SELECT t.*, CASE WHEN t.amount_cents > 0 AND c.spending_class = 'income'
    AND t.account_type IN ('credit_card','line_of_credit','mortgage','loan') THEN NULL ELSE k.category_id END AS category_id
  FROM typed t LEFT JOIN merchant_memory k ON k.merchant = t.merchant LEFT JOIN categories c ON c.id = k.category_id)"""


def committed(led):
    rows = bulk.under_review(final(led), led.batches)
    lines = ledger_index(led).around(staged_lines(led))[0]
    return rows, bulk.commit(rows, lines, led.accounts, led.categories, led.merchant_memory)


@query(
    "stage_and_commit",
    COMMITTED + " SELECT id, batch_id, account_id, date::VARCHAR AS date, amount_cents, merchant, category_id FROM filed",
)
def stage_and_commit(led):
    return committed(led)[1].select("id", "batch_id", "account_id", "date", "amount_cents", "merchant", "category_id")


@query(
    "commit_stats",
    COMMITTED
    + """, added AS (SELECT batch_id, count(*) AS n, count(category_id) AS filed FROM filed GROUP BY 1),
    recorded AS (SELECT p.batch_id, count(*) AS n FROM statement_balances p LEFT JOIN snapshots s ON s.account_id = p.account_id AND s.date = p.date
      WHERE s.balance_cents IS DISTINCT FROM p.balance_cents GROUP BY 1)
    SELECT f.batch_id, count(*) AS staged_rows, coalesce(max(a.n), 0) AS inserted, count(*) - coalesce(max(a.n), 0) AS skipped,
      coalesce(max(a.filed), 0) AS auto_categorized, coalesce(max(r.n), 0) AS balances_recorded
    FROM final f JOIN batches b ON b.id = f.batch_id AND b.status = 'review'
    LEFT JOIN added a ON a.batch_id = f.batch_id LEFT JOIN recorded r ON r.batch_id = f.batch_id GROUP BY 1""",
)
def commit_stats(led):
    rows, new = committed(led)
    return bulk.commit_stats(rows, new, balance_replace_check(led.statement_balances, led.snapshots))
