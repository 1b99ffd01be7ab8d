"""Reading uploads: cells, mappings, errors, running balances."""

from pyspark.sql import functions as F

from ..constants import DATE_FORMATS
from ..functions import accounts as A
from ..functions import dates as D
from ..functions import money as M
from ..functions import text as T
from ..operators import ingest as I
from ..operators import staging as S
from ..sources.tables import pick
from .registry import query
from .views_sql import date_sql, money_sql

MAPPED = f"""
, cells AS (
  SELECT *, {date_sql("raw_date", "format_no")} AS date,
    trim(regexp_replace(raw_details || ' ' || raw_memo, '\\s+', ' ', 'g')) AS text,
    {money_sql("raw_amount")} AS a, {money_sql("raw_debit")} AS d, {money_sql("raw_credit")} AS c,
    {money_sql("raw_balance")} AS balance_cents
  FROM uploads
),
mapped0 AS (
  SELECT *, CAST(CASE style_no WHEN 0 THEN a WHEN 1 THEN -a
      ELSE (CASE WHEN d <> 0 THEN -abs(d) WHEN c <> 0 THEN abs(c) WHEN d = 0 OR c = 0 THEN 0 END) END AS BIGINT) AS amount_cents
  FROM cells
),
mapped AS (
  SELECT file_id, row_index, date, CASE WHEN text = '' THEN '(no description)' ELSE text END AS description,
    amount_cents, CAST(balance_cents AS BIGINT) AS balance_cents, raw_date,
    CASE WHEN date IS NULL AND trim(raw_date || text || raw_amount || raw_debit || raw_credit || raw_balance) = '' THEN 'blank'
      WHEN date IS NULL THEN 'error' WHEN amount_cents IS NULL THEN 'error'
      WHEN text = '' AND amount_cents = 0 THEN 'empty' ELSE 'row' END AS outcome
  FROM mapped0
)"""


def mapped(led):
    return I.map_records(led.mapped_records)


@query(
    "parse_money",
    f"SELECT row_index, raw_amount, CAST({money_sql('raw_amount')} AS BIGINT) AS cents FROM uploads",
)
def parse_money(led):
    return led.uploads.select("row_index", "raw_amount", M.parse_money(F.col("raw_amount")).alias("cents"))


@query(
    "parse_date",
    f"SELECT row_index, raw_date, CAST({date_sql('raw_date', 'format_no')} AS VARCHAR) AS date FROM uploads",
)
def parse_date(led):
    fmt = pick(DATE_FORMATS, F.col("format_no"))
    return led.uploads.select("row_index", "raw_date", D.parse_date(F.col("raw_date"), fmt).alias("date"))


@query(
    "apply_csv_mapping",
    MAPPED + " SELECT file_id, row_index, date::VARCHAR AS date, description, amount_cents FROM mapped WHERE outcome = 'row'",
)
def apply_csv_mapping(led):
    return I.mapped_rows(mapped(led))


@query(
    "row_error_capture",
    MAPPED
    + """ SELECT file_id, row_index, CASE WHEN date IS NULL THEN 'Unparseable date "' || raw_date || '"'
      ELSE 'Unparseable amount' END AS problem FROM mapped WHERE outcome = 'error'""",
)
def row_error_capture(led):
    return I.row_errors(mapped(led))


@query(
    "map_balance_file",
    MAPPED
    + """ SELECT file_id, row_index, date::VARCHAR AS date, balance_cents,
      CASE WHEN date IS NULL AND outcome <> 'blank' THEN 'Unparseable date "' || raw_date || '"'
        WHEN date IS NOT NULL AND balance_cents IS NULL THEN 'Unparseable balance ""' END AS problem FROM mapped""",
)
def map_balance_file(led):
    return I.map_records(led.mapped_records, kind="balances").select(
        "file_id", "row_index", "date", "balance_cents", "problem"
    )


@query("amount_style", MAPPED + " SELECT row_index, style_no, amount_cents FROM mapped0")
def amount_style(led):
    names = F.array(*[F.lit(n) for n in ("single_signed", "single_inverted", "debit_credit")])
    style = F.element_at(names, (F.col("style_no") + 1).cast("int"))
    parsed = [M.parse_money(F.col(f"raw_{c}")) for c in ("amount", "debit", "credit")]
    return led.uploads.select("row_index", "style_no", I.map_amount(style, *parsed).alias("amount_cents"))


@query(
    "concat_description",
    MAPPED + " SELECT row_index, CASE WHEN text = '' THEN '(no description)' ELSE text END AS description FROM cells",
)
def concat_description(led):
    joined = T.concat_description([F.col("raw_details"), F.col("raw_memo")])
    return led.uploads.select(
        "row_index", F.coalesce(joined, F.lit("(no description)")).alias("description")
    )


@query(
    "running_balance_anchor",
    MAPPED
    + """, good AS (SELECT * FROM mapped WHERE outcome = 'row' AND balance_cents IS NOT NULL),
    dir AS (SELECT file_id, arg_min(date, row_index) <= arg_max(date, row_index) AS up FROM good GROUP BY 1)
    SELECT file_id, row_index, date::VARCHAR AS date, balance_cents FROM good JOIN dir USING (file_id)
    QUALIFY row_number() OVER (PARTITION BY file_id, date ORDER BY CASE WHEN up THEN -row_index ELSE row_index END) = 1""",
)
def running_balance_anchor(led):
    return I.running_balance_anchor(mapped(led))


_FILES = """
, files AS (SELECT DISTINCT file_id, account_id, style_no FROM uploads),
signed AS (SELECT *, CASE WHEN style_no = 2 THEN 'posted date|details|memo|debit|credit|balance'
  ELSE 'posted date|details|memo|amount|balance' END AS signature FROM files)"""


@query("header_signature", _FILES + " SELECT file_id, signature FROM signed")
def header_signature(led):
    return led.upload_files.select("file_id", "signature")


@query(
    "saved_mapping_lookup",
    _FILES
    + """ SELECT file_id, account_id, signature,
      (['YYYY-MM-DD','MM/DD/YYYY','M/D/YYYY','DD/MM/YYYY','YYYY/MM/DD','MMM D, YYYY'])[account_id % 6 + 1] AS date_format,
      (['single_signed','single_inverted','debit_credit'])[account_id % 3 + 1] AS amount_style FROM signed""",
)
def saved_mapping_lookup(led):
    found = I.saved_mapping_lookup(led.upload_files, led.saved_mappings)
    return found.select("file_id", "account_id", "signature", "date_format", "amount_style")


@query(
    "heuristic_mapping",
    _FILES
    + """, firsts AS (SELECT file_id, arg_min(raw_date, row_index) AS sample FROM uploads WHERE trim(raw_date) <> '' GROUP BY 1)
    SELECT s.file_id, 'Posted Date' AS date_column,
      CASE WHEN regexp_matches(sample, '^[0-9]{4}-') THEN 'YYYY-MM-DD' WHEN regexp_matches(sample, '^[0-9]{4}/') THEN 'YYYY/MM/DD'
        WHEN regexp_matches(sample, '^[A-Za-z]') THEN 'MMM D, YYYY' ELSE 'MM/DD/YYYY' END AS date_format,
      'Memo' AS description_column, CASE WHEN style_no = 2 THEN 'debit_credit' ELSE 'single_signed' END AS amount_style,
      CASE WHEN style_no <> 2 THEN 'Amount' END AS amount_column, CASE WHEN style_no = 2 THEN 'Debit' END AS debit_column,
      CASE WHEN style_no = 2 THEN 'Credit' END AS credit_column, 'Balance' AS balance_column
    FROM signed s LEFT JOIN firsts USING (file_id)""",
)
def heuristic_mapping(led):
    samples = I.first_samples(led.records, led.upload_files)
    guessed = I.heuristic_mappings(led.upload_files.join(samples, "file_id", "left"))
    return guessed.select(
        "file_id",
        "date_column",
        "date_format",
        F.try_element_at("description_columns", F.lit(1)).alias("description_column"),
        "amount_style",
        "amount_column",
        "debit_column",
        "credit_column",
        "balance_column",
    )


@query(
    "normalize_merchant",
    """SELECT id, description, CASE WHEN regexp_matches(t, '^(AMZN|AMAZON)\\b') THEN 'AMAZON' WHEN b = '' THEN t ELSE b END AS merchant
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '\\.COM\\b.*$', ''), '\\s*#\\s*\\d+.*$', ''), '(\\s+\\d{3,})+$', '') AS b
      FROM (SELECT id, description, regexp_replace(upper(trim(regexp_replace(description, '\\s+', ' ', 'g'))), '^(SQ \\*|TST\\*|DIRECT DEP )\\s*', '') AS t
        FROM transactions))""",
)
def normalize_merchant(led):
    return led.transactions.select(
        "id", "description", T.normalize_merchant(F.col("description")).alias("merchant")
    )


OCCURRENCE = """
, occ AS (SELECT *, row_number() OVER (PARTITION BY account_id, date, amount_cents, upper(trim(description)) ORDER BY id) AS occurrence
  FROM transactions),
hashed AS (SELECT *, sha256(CAST(date AS VARCHAR) || '|' || CAST(amount_cents AS VARCHAR) || '|' || upper(trim(description)) || '|'
  || CAST(occurrence AS VARCHAR)) AS dedupe_hash FROM occ)"""


@query("occurrence_index", OCCURRENCE + " SELECT id, account_id, occurrence FROM occ")
def occurrence_index(led):
    return S.occurrence_index(led.transactions, ["account_id"]).select("id", "account_id", "occurrence")


@query("dedupe_key", OCCURRENCE + " SELECT id, account_id, dedupe_hash FROM hashed")
def dedupe_key(led):
    return S.with_dedupe_key(led.transactions, ["account_id"]).select("id", "account_id", "dedupe_hash")


@query(
    "liability_flag",
    "SELECT id, account_type, account_type IN ('credit_card','line_of_credit','mortgage','loan') AS is_liability FROM accounts",
)
def liability_flag(led):
    return led.accounts.select(
        "id", "account_type", A.is_liability(F.col("account_type")).alias("is_liability")
    )


@query(
    "resolve_account_kind",
    """SELECT id, account_type, asked, CASE WHEN account_type IN ('mortgage','loan','line_of_credit') AND asked IN ('transaction','balance') THEN asked
      WHEN account_type IN ('investment','retirement','mortgage','loan') THEN 'balance' ELSE 'transaction' END AS kind
    FROM (SELECT id, account_type, CASE id % 3 WHEN 0 THEN 'balance' WHEN 1 THEN 'transaction' END AS asked FROM accounts)""",
)
def resolve_account_kind(led):
    asked = F.when(F.col("id") % 3 == 0, F.lit("balance")).when(F.col("id") % 3 == 1, F.lit("transaction"))
    rows = led.accounts.select("id", "account_type", asked.alias("asked"))
    return rows.withColumn("kind", A.resolve_account_kind(F.col("account_type"), F.col("asked")))


@query(
    "payment_category",
    """SELECT id, account_type, CASE WHEN account_type = 'credit_card' THEN 'Credit Card Payment'
      WHEN account_type IN ('line_of_credit','mortgage','loan') THEN 'Loan Payment' END AS payment_category FROM accounts""",
)
def payment_category(led):
    return led.accounts.select(
        "id", "account_type", A.payment_category(F.col("account_type")).alias("payment_category")
    )


@query(
    "account_label",
    "SELECT id, institution || ' · ' || name || CASE WHEN last_four IS NULL THEN '' ELSE ' ··' || last_four END AS label FROM accounts",
)
def account_label(led):
    return led.labelled_accounts.select("id", "label")


@query(
    "format_cents",
    """SELECT id, CASE WHEN amount_cents < 0 THEN '-' ELSE '' END || '$' || s AS shown, '$' || s AS shown_abs,
      CASE WHEN amount_cents < 0 THEN '-' ELSE '' END || replace(s, ',', '') AS input
    FROM (SELECT id, amount_cents, format('{:,}', abs(amount_cents) // 100) || '.' || lpad(CAST(abs(amount_cents) % 100 AS VARCHAR), 2, '0') AS s
      FROM transactions)""",
)
def format_cents(led):
    amount = F.col("amount_cents")
    return led.transactions.select(
        "id",
        M.format_cents(amount).alias("shown"),
        M.format_cents_abs(amount).alias("shown_abs"),
        M.cents_to_input(amount).alias("input"),
    )


@query(
    "date_helpers",
    """SELECT id, strftime(date, '%Y-%m') AS month, CAST(date_trunc('month', date) AS DATE)::VARCHAR AS month_start,
      last_day(date)::VARCHAR AS month_end, (date + 45)::VARCHAR AS later,
      strftime(date_trunc('month', date) - INTERVAL 5 MONTH, '%Y-%m') AS five_months_back,
      date_diff('day', DATE '1995-01-01', date) AS days, NOT id % 9 = 0 AS valid
    FROM transactions""",
)
def date_helpers(led):
    date = F.col("date")
    text = F.date_format(date, "yyyy-MM-dd")
    given = F.when(F.col("id") % 9 == 0, F.concat(F.substring(text, 1, 8), F.lit("32"))).otherwise(text)
    return led.transactions.select(
        "id",
        D.month_of(date).alias("month"),
        D.month_start(D.month_of(date)).alias("month_start"),
        D.month_end(D.month_of(date)).alias("month_end"),
        F.date_add(date, 45).alias("later"),
        D.add_months(D.month_of(date), -5).alias("five_months_back"),
        D.days_between(F.lit("1995-01-01").cast("date"), date).cast("long").alias("days"),
        D.is_iso_date(given).alias("valid"),
    )
