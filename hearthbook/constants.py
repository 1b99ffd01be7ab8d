"""Every name, list and number here must stay exactly as it is,
because results are compared by these spellings."""

# --- fixed values -----------------------------------------------------------

ACCOUNT_KINDS = ["transaction", "balance"]

ACCOUNT_TYPES = [
    "checking",
    "savings",
    "credit_card",
    "line_of_credit",
    "mortgage",
    "loan",
    "investment",
    "retirement",
    "other",
]

LIABILITY_TYPES = ["credit_card", "line_of_credit", "mortgage", "loan"]

DATE_FORMATS = [
    "YYYY-MM-DD",
    "MM/DD/YYYY",
    "M/D/YYYY",
    "DD/MM/YYYY",
    "YYYY/MM/DD",
    "MMM D, YYYY",
]

AMOUNT_STYLES = ["single_signed", "single_inverted", "debit_credit"]

BULK_FILE_STATUSES = [
    "queued",
    "identified",
    "staged",
    "committed",
    "categorized",
    "needs_input",
    "held",
    "skipped",
    "failed",
]

# name, spending class, sort order; the id is the 1-based position
STARTER_CATEGORIES = [
    ("Mortgage", "base", 0),
    ("Loan Repayment", "base", 1),
    ("Interest", "base", 2),
    ("Utilities", "base", 3),
    ("Insurance", "base", 4),
    ("Internet & Phone", "base", 5),
    ("Childcare", "base", 6),
    ("Groceries", "living", 10),
    ("Gas & Auto", "living", 11),
    ("Health", "living", 12),
    ("Household Supplies", "living", 13),
    ("Restaurants", "luxury", 20),
    ("Entertainment", "luxury", 21),
    ("Shopping", "luxury", 22),
    ("Travel", "luxury", 23),
    ("Subscriptions", "luxury", 24),
    ("Salary", "income", 30),
    ("Dividends", "income", 31),
    ("Tax Distribution", "income", 32),
    ("Other Income", "income", 33),
    ("Transfer", "transfer", 40),
    ("Credit Card Payment", "transfer", 41),
    ("Loan Payment", "transfer", 42),
]

MONTH_ABBREVIATIONS = [
    "JAN", "FEB", "MAR", "APR", "MAY", "JUN",
    "JUL", "AUG", "SEP", "OCT", "NOV", "DEC",
]

CALENDAR_MONTH_CAP = 120
SNAPSHOTS_SHOWN = 24
CATEGORIZE_RUN_LIMIT = 1000
IMPORT_HISTORY_SHOWN = 25
BULK_RUNS_SHOWN = 12
SUGGESTED_MATCHES_SHOWN = 30
UNMATCHED_SHOWN = 25
CONFIRMED_MATCHES_SHOWN = 15

# --- our own defaults -------------------------------------------------------

TRANSFER_WINDOW_DAYS = 3
MANUAL_TRANSFER_WINDOW_DAYS = 30
STATEMENT_MATCH_WINDOW_DAYS = 5
ORDER_MATCH_WINDOW_DAYS = 10
REGISTER_PAGE_SIZE = 50
TOP_CATEGORIES_SHOWN = 8
