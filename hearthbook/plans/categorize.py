"""Filing rows, remembering choices, moving rules between ledgers."""

from pyspark.sql import functions as F

from ..operators import categorize as C
from ..operators.splits import split_validate
from ..sources import rules
from .registry import query

DECIDED = """
, ruled AS (
  SELECT t.id, t.account_id, t.amount_cents, t.merchant, m.category_id AS mem, mc.spending_class AS mem_class,
    s.category_id AS sug, sc.spending_class AS sug_class, s.confidence_tenths AS conf,
    t.amount_cents > 0 AND a.account_type IN ('credit_card','line_of_credit','mortgage','loan') AS debt_credit,
    regexp_matches(t.description, '\\b(PAYMENT|PMT|PYMT|AUTOPAY|THANK YOU|TRANSFER)\\b') AS pays,
    CASE WHEN a.account_type = 'credit_card' THEN 22 ELSE 23 END AS payment_id
  FROM transactions t JOIN accounts a ON a.id = t.account_id
  LEFT JOIN merchant_memory m ON m.merchant = t.merchant LEFT JOIN categories mc ON mc.id = m.category_id
  LEFT JOIN suggestions s ON s.merchant = t.merchant LEFT JOIN categories sc ON sc.id = s.category_id
  WHERE t.category_id IS NULL
),
outcomes AS (
  SELECT *, CASE WHEN debt_credit AND pays THEN 'rule'
    WHEN mem IS NOT NULL AND NOT (debt_credit AND mem_class = 'income') THEN 'memory'
    WHEN conf >= 5 AND NOT (debt_credit AND sug_class = 'income') THEN 'ai'
    WHEN debt_credit AND (coalesce(mem_class = 'income', false) OR (conf >= 5 AND sug_class = 'income')) THEN 'blocked'
    WHEN sug IS NOT NULL THEN 'low_confidence' ELSE 'unknown' END AS outcome
  FROM ruled
)"""


def decided(led):
    return C.categorize_layers(
        led.transactions, led.accounts, led.categories, led.merchant_memory, led.suggestions
    )


@query(
    "categorize_layers",
    DECIDED
    + """ SELECT id, account_id, amount_cents, merchant, outcome,
      CASE outcome WHEN 'rule' THEN payment_id WHEN 'memory' THEN mem WHEN 'ai' THEN sug END AS category_id,
      CASE outcome WHEN 'rule' THEN 'auto' WHEN 'memory' THEN 'memory' WHEN 'ai' THEN 'ai' END AS category_source FROM outcomes""",
)
def categorize_layers(led):
    return decided(led)


@query("categorize_tally", DECIDED + " SELECT outcome, count(*) AS rows FROM outcomes GROUP BY 1")
def categorize_tally(led):
    return C.categorize_tally(decided(led))


@query(
    "memory_join",
    """SELECT t.id, t.merchant, m.category_id AS memory_category_id, m.source AS memory_source
    FROM transactions t LEFT JOIN merchant_memory m ON m.merchant = t.merchant WHERE t.category_id IS NULL""",
)
def memory_join(led):
    found = C.memory_join(led.transactions, led.merchant_memory)
    return found.select("id", "merchant", "memory_category_id", "memory_source")


@query(
    "liability_credit_guard",
    """SELECT t.id, t.merchant, s.category_id FROM transactions t JOIN accounts a ON a.id = t.account_id
    JOIN suggestions s ON s.merchant = t.merchant JOIN categories c ON c.id = s.category_id
    WHERE t.amount_cents > 0 AND a.account_type IN ('credit_card','line_of_credit','mortgage','loan') AND c.spending_class = 'income'""",
)
def liability_credit_guard(led):
    types = led.accounts.select(F.col("id").alias("account_id"), "account_type")
    classes = led.categories.select(F.col("id").alias("category_id"), "spending_class")
    offered = led.suggestions.select("merchant", "category_id").join(classes, "category_id")
    rows = led.transactions.select("id", "account_id", "amount_cents", "merchant").join(types, "account_id")
    blocked = C.guard_blocks(F.col("amount_cents"), F.col("account_type"), F.col("spending_class"))
    return rows.join(offered, "merchant").where(blocked).select("id", "merchant", "category_id")


def selection(led):
    """The user ticks every open widget row and files them as Shopping."""
    ticked = led.transactions.where("category_id is null and merchant like '%WIDGET%'")
    return ticked.select("id", F.lit(14).cast("long").alias("new_category_id"))


@query(
    "bulk_categorize",
    """SELECT id, account_id, CASE WHEN t.category_id IS NULL AND merchant LIKE '%WIDGET%' THEN 14 ELSE t.category_id END AS category_id,
      CASE WHEN t.category_id IS NULL AND merchant LIKE '%WIDGET%' THEN 'user' ELSE category_source END AS category_source
    FROM transactions t""",
)
def bulk_categorize(led):
    filed = C.bulk_categorize(led.transactions, selection(led))
    return filed.select("id", "account_id", "category_id", "category_source")


_CHOICES = """
, choices AS (SELECT DISTINCT merchant FROM transactions WHERE category_id IS NULL AND merchant LIKE '%WIDGET%')"""


@query(
    "memory_upsert",
    _CHOICES
    + """ SELECT coalesce(m.merchant, c.merchant) AS merchant, CASE WHEN c.merchant IS NULL THEN m.category_id ELSE 14 END AS category_id,
      CASE WHEN c.merchant IS NULL THEN m.source ELSE 'user' END AS source,
      coalesce(m.use_count, 0) + CASE WHEN c.merchant IS NULL THEN 0 ELSE 1 END AS use_count
    FROM merchant_memory m FULL JOIN choices c ON c.merchant = m.merchant""",
)
def memory_upsert(led):
    return C.memory_upsert(led.merchant_memory, C.choices_of(led.transactions, selection(led)))


@query(
    "memory_upsert_ai",
    """SELECT coalesce(m.merchant, s.merchant) AS merchant,
      CASE WHEN m.source = 'user' OR s.merchant IS NULL THEN m.category_id ELSE s.category_id END AS category_id,
      CASE WHEN m.source = 'user' THEN 'user' ELSE 'ai' END AS source,
      coalesce(m.use_count, 0) + CASE WHEN s.merchant IS NULL THEN 0 ELSE 1 END AS use_count
    FROM merchant_memory m FULL JOIN suggestions s ON s.merchant = m.merchant""",
)
def memory_upsert_ai(led):
    answers = led.suggestions.select("merchant", "category_id", F.lit("ai").alias("source"))
    return C.memory_upsert(led.merchant_memory, answers)


@query(
    "rules_export",
    """SELECT m.merchant, c.name AS category, c.spending_class, m.source, m.use_count FROM merchant_memory m
    JOIN categories c ON c.id = m.category_id WHERE m.source = 'user'""",
)
def rules_export(led):
    return C.rules_export(led.categories, led.merchant_memory, user_only=True)


INCOMING = """
, incoming AS (
  SELECT merchant, CASE WHEN length(merchant) % 4 = 0 THEN 'Gifts' ELSE c.name END AS category,
    CASE WHEN length(merchant) % 4 = 0 THEN 'luxury' ELSE 'base' END AS spending_class,
    CASE WHEN length(merchant) % 5 = 0 THEN 'user' ELSE 'ai' END AS source
  FROM suggestions s JOIN categories c ON c.id = 1 + length(merchant) % 23
),
merged AS (
  SELECT coalesce(m.merchant, i.merchant) AS merchant, c.name AS mine, m.source AS my_source, i.category AS theirs, i.source AS their_source,
    m.merchant IS NOT NULL AS held, i.merchant IS NOT NULL AS given, coalesce(m.use_count, 0) AS use_count
  FROM merchant_memory m LEFT JOIN categories c ON c.id = CASE length(m.merchant) % 7 WHEN 1 THEN 1 WHEN 3 THEN 999 ELSE m.category_id END
  FULL JOIN incoming i ON i.merchant = m.merchant
)"""


def incoming(led):
    """A rules file from another ledger: some rules agree, some do not, and one
    category is new."""
    size = F.length("merchant")
    names = led.categories.select(F.col("id").alias("cat"), "name")
    return (
        led.suggestions.select("merchant", (1 + size % 23).alias("cat"))
        .join(names, "cat")
        .select(
            "merchant",
            F.when(size % 4 == 0, F.lit("Gifts")).otherwise(F.col("name")).alias("category"),
            F.when(size % 4 == 0, F.lit("luxury")).otherwise(F.lit("base")).alias("spending_class"),
            F.when(size % 5 == 0, F.lit("user")).otherwise(F.lit("ai")).alias("source"),
        )
    )


def own_memory(led):
    # some rules disagree with the file, and the category of some is gone
    size = F.length("merchant")
    first = F.when(size % 7 == 1, 1).when(size % 7 == 3, 999).otherwise(F.col("category_id")).cast("long")
    return led.merchant_memory.withColumn("category_id", first)


@query(
    "rules_merge",
    INCOMING
    + """ SELECT merchant, CASE WHEN held AND (NOT given OR mine IS NOT DISTINCT FROM theirs OR my_source = 'user') THEN mine ELSE theirs END AS category,
      CASE WHEN held AND (NOT given OR mine IS NOT DISTINCT FROM theirs OR my_source = 'user') THEN my_source ELSE their_source END AS source,
      use_count, CASE WHEN NOT held THEN 'added' WHEN NOT given THEN 'untouched' WHEN mine IS NOT DISTINCT FROM theirs THEN 'unchanged'
        WHEN my_source = 'user' THEN 'kept_user' ELSE 'updated' END AS outcome FROM merged""",
)
def rules_merge(led):
    return C.rules_merge(own_memory(led), led.categories, incoming(led))


@query(
    "rules_replace",
    INCOMING
    + """ SELECT merchant, theirs AS category, their_source AS source, use_count,
      CASE WHEN NOT given THEN 'removed' WHEN NOT held THEN 'added' ELSE 'replaced' END AS outcome FROM merged""",
)
def rules_replace(led):
    return C.rules_merge(own_memory(led), led.categories, incoming(led), replace=True)


@query(
    "rules_merge_counts",
    INCOMING
    + """ SELECT CASE WHEN NOT held THEN 'added' WHEN NOT given THEN 'untouched' WHEN mine IS NOT DISTINCT FROM theirs THEN 'unchanged'
        WHEN my_source = 'user' THEN 'kept_user' ELSE 'updated' END AS outcome, count(*) AS rules FROM merged GROUP BY 1""",
)
def rules_merge_counts(led):
    return C.outcome_counts(C.rules_merge(own_memory(led), led.categories, incoming(led)))


@query(
    "rules_merge_categories",
    INCOMING
    + """, wanted AS (SELECT category AS name, min(spending_class) AS file_class FROM incoming GROUP BY 1)
    SELECT coalesce(c.name, w.name) AS name, coalesce(c.spending_class, w.file_class) AS spending_class,
      CASE WHEN c.name IS NULL THEN 'created' WHEN w.name IS NOT NULL THEN 'matched' ELSE 'untouched' END AS outcome
    FROM categories c FULL JOIN wanted w ON w.name = c.name""",
)
def rules_merge_categories(led):
    return C.merge_categories(led.categories, incoming(led))


@query(
    "rules_import_scan",
    """, rules AS (SELECT m.merchant, c.name AS category, m.source FROM merchant_memory m JOIN categories c ON c.id = m.category_id)
    SELECT merchant, category, source, NULL::VARCHAR AS problem FROM rules WHERE source = 'user'
    UNION ALL SELECT merchant, NULL, source, 'rule without a category' FROM rules WHERE source = 'ai'""",
)
def rules_import_scan(led):
    # written as a rules file and read back; AI rules lose their category on the way
    out = C.rules_export(led.categories, led.merchant_memory)
    damaged = out.withColumn("category", F.when(F.col("source") == "user", F.col("category")))
    path = rules.scratch(led.spark, "rules")
    rules.write_rules(damaged, path)
    return rules.read_rules(led.spark, path).select("merchant", "category", "source", "problem")


@query(
    "split_validate",
    """, proposed AS (SELECT transaction_id, category_id, CASE WHEN line_no = 2 AND transaction_id % 7 = 0 THEN 0
        WHEN line_no = 2 AND transaction_id % 5 = 0 THEN amount_cents + 1 ELSE amount_cents END AS amount_cents FROM splits),
    sums AS (SELECT transaction_id, count(*) FILTER (amount_cents <> 0) AS lines, CAST(sum(amount_cents) AS BIGINT) AS line_cents FROM proposed GROUP BY 1)
    SELECT t.id, t.amount_cents, s.lines, s.line_cents,
      CASE WHEN lines < 2 THEN 'needs two lines' WHEN line_cents <> t.amount_cents THEN 'total differs' END AS problem
    FROM transactions t JOIN sums s ON s.transaction_id = t.id""",
)
def check_splits(led):
    second, key = F.col("line_no") == 2, F.col("transaction_id")
    amount = F.col("amount_cents")
    proposed = led.splits.withColumn(
        "amount_cents",
        F.when(second & (key % 7 == 0), 0).when(second & (key % 5 == 0), amount + 1).otherwise(amount),
    )
    return split_validate(led.transactions, proposed)
