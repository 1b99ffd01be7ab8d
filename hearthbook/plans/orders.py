"""Online orders, their charges and items."""

from pyspark.sql import functions as F

from ..constants import CONFIRMED_MATCHES_SHOWN, SUGGESTED_MATCHES_SHOWN, UNMATCHED_SHOWN
from ..operators import orders as O
from ..operators import register as R
from ..operators.splits import item_split_allocate
from ..operators.subsets import BOUNDS, MOST, ROUNDS
from ..session import cut_lineage
from .registry import query
from .views_sql import assign_sql, subset_sql

WINDOW = list(range(11))

EXACT = """
, el AS (SELECT account_id, -amount_cents AS size, date, id AS left_id FROM charges),
er AS (SELECT account_id, total_cents AS size, date, id AS right_id FROM shop_orders)""" + assign_sql(
    "el", "er", ["account_id", "size"], WINDOW, "ex"
) + """
, exact AS (SELECT 'exact' AS kind, right_id AS order_id, left_id AS charge_id, c.amount_cents, CAST(days AS BIGINT) AS days,
  1.0::DOUBLE - days / 20.0::DOUBLE AS confidence,
  CASE WHEN left_choices = 1 AND right_choices = 1 THEN 'confirmed' ELSE 'suggested' END AS status
  FROM ex JOIN charges c ON c.id = ex.left_id)"""


def split_sql(rounds):
    return EXACT + """
, c1 AS (SELECT id, account_id, date, -amount_cents AS size FROM charges WHERE id NOT IN (SELECT charge_id FROM exact)),
o1 AS (SELECT id, account_id, date, total_cents AS size FROM shop_orders WHERE id NOT IN (SELECT order_id FROM exact))""" + subset_sql(
        "o1", "c1", 0, 10, MOST, rounds, "sp"
    ) + """
, split AS (SELECT 'split' AS kind, target_id AS order_id, part_id AS charge_id, c.amount_cents, CAST(days AS BIGINT) AS days,
  1.0::DOUBLE - days / 20.0::DOUBLE AS confidence, CASE WHEN sure THEN 'confirmed' ELSE 'suggested' END AS status
  FROM sp JOIN charges c ON c.id = part_id)"""


def all_sql(rounds):
    return split_sql(rounds) + """
, c2 AS (SELECT * FROM c1 WHERE id NOT IN (SELECT charge_id FROM split)),
o2 AS (SELECT * FROM o1 WHERE id NOT IN (SELECT order_id FROM split))""" + subset_sql("c2", "o2", -10, 0, MOST, rounds, "cb") + """
, combined AS (SELECT 'combined' AS kind, part_id AS order_id, target_id AS charge_id, -o.total_cents AS amount_cents, CAST(days AS BIGINT) AS days,
  1.0::DOUBLE - days / 20.0::DOUBLE AS confidence, CASE WHEN sure THEN 'confirmed' ELSE 'suggested' END AS status
  FROM cb JOIN shop_orders o ON o.id = part_id),
matches AS MATERIALIZED (SELECT * FROM exact UNION ALL SELECT * FROM split UNION ALL SELECT * FROM combined)"""


# dealt until no target asks any more
SPLIT, ALL = split_sql(None), all_sql(None)


@query("match_orders_exact", EXACT + " SELECT * FROM exact")
def match_orders_exact(led):
    return O.match_exact(led.shop_orders, led.charges)


@query("match_orders_split", SPLIT + " SELECT * FROM split")
def match_orders_split(led):
    exact = cut_lineage(O.match_exact(led.shop_orders, led.charges))
    return O.match_split(*O.written(O.unexplained(led.shop_orders, led.charges, exact)))


@query("match_orders_combined", ALL + " SELECT * FROM combined")
def match_orders_combined(led):
    exact = cut_lineage(O.match_exact(led.shop_orders, led.charges))
    left = O.written(O.unexplained(led.shop_orders, led.charges, exact))
    left = O.written(O.unexplained(*left, cut_lineage(O.match_split(*left))))
    return O.match_combined(*left)


@query("match_orders", ALL + " SELECT * FROM matches")
def match_orders(led):
    return all_matches(led)


def reviews(led, matches):
    """The user confirms, rejects or undoes suggestions, rejects a match that was
    confirmed by itself now and then, and pairs open charges by hand with the order of
    the same number."""
    key, suggested = F.col("charge_id"), F.col("status") == "suggested"
    action = F.when(suggested & (key % 3 == 0), F.lit("confirm")).when(suggested & (key % 3 == 2), F.lit("undo")).otherwise(F.lit("reject"))
    judged = matches.where(suggested | (key % 97 == 0)).select(
        "order_id",
        "charge_id",
        action.alias("action"),
        "amount_cents",
        F.lit(1).alias("seq"),
    )
    _, open_charges = O.unexplained(led.shop_orders, led.charges, matches)
    manual = open_charges.select(
        (F.col("id") % 10_000_000_000_000).alias("order_id"),
        F.col("id").alias("charge_id"),
        F.lit("manual").alias("action"),
        "amount_cents",
        F.lit(2).alias("seq"),
    )
    return judged.unionByName(manual)


AFTER_REVIEW = """, reviewed AS (
    SELECT kind, order_id, charge_id, amount_cents, 'auto' AS match_type, confidence,
      CASE WHEN status = 'suggested' THEN CASE charge_id % 3 WHEN 0 THEN 'confirmed' ELSE 'rejected' END
           WHEN charge_id % 97 = 0 THEN 'rejected' ELSE status END AS status
    FROM matches WHERE status = 'confirmed' OR charge_id % 3 <> 2
    UNION ALL SELECT 'exact', id % 10000000000000, id, amount_cents, 'manual', 1.0::DOUBLE, 'confirmed'
    FROM charges WHERE id NOT IN (SELECT charge_id FROM matches))"""
REVIEWED = ALL + AFTER_REVIEW
# reports whose SQL says so count what was dealt in that many rounds
REVIEWED_ROUNDS = all_sql(ROUNDS) + AFTER_REVIEW


def reviewed(led, rounds=None):
    """The matches after the user has gone through them."""
    found = all_matches(led, rounds)
    return O.apply_reviews(found, reviews(led, found))


@query("match_review", REVIEWED + " SELECT * FROM reviewed")
def match_review(led):
    return reviewed(led)


# Reports below read the matches of every kind.


def all_matches(led, rounds=None):
    """Matched once per ledger; the matcher writes its results."""
    if "order_matches" not in led.__dict__:
        led.order_matches = O.run_matcher(led.shop_orders, led.charges, rounds=rounds)
    return led.order_matches


@query(
    "order_match_stats",
    REVIEWED_ROUNDS
    + """ SELECT (SELECT count(*) FROM shop_orders) AS orders, count(DISTINCT order_id) AS matched FROM reviewed WHERE status = 'confirmed'""",
)
def order_match_stats(led):
    return O.order_match_stats(led.shop_orders, reviewed(led, ROUNDS))


@query(
    "unmatched_orders",
    REVIEWED_ROUNDS
    + """ SELECT id, account_id, date::VARCHAR AS date, total_cents FROM shop_orders
    WHERE id NOT IN (SELECT order_id FROM reviewed WHERE status = 'confirmed') ORDER BY shop_orders.date DESC, id DESC LIMIT 25""",
)
def unmatched_orders(led):
    return O.unmatched_orders(led.shop_orders, reviewed(led, ROUNDS), UNMATCHED_SHOWN).select(
        "id", "account_id", "date", "total_cents"
    )


@query(
    "order_reach",
    REVIEWED_ROUNDS
    + f""", near AS (SELECT o.id, o.account_id, o.date, o.total_cents,
        count(DISTINCT (c.date, c.amount_cents)) FILTER (c.id IS NOT NULL) AS reach
      FROM shop_orders o LEFT JOIN (SELECT * FROM charges WHERE id NOT IN (SELECT charge_id FROM reviewed WHERE status <> 'rejected')) c
        ON c.account_id = o.account_id AND c.date - o.date BETWEEN 0 AND 10
      WHERE o.id NOT IN (SELECT order_id FROM reviewed WHERE status <> 'rejected') AND o.total_cents > 0 GROUP BY 1, 2, 3, 4)
    SELECT id, account_id, date - DATE '1970-01-01' AS day, total_cents AS size, reach,
      CASE WHEN reach <= {BOUNDS[4]} THEN 4 WHEN reach <= {BOUNDS[3]} THEN 3 WHEN reach <= {BOUNDS[2]} THEN 2 ELSE 1 END AS tried FROM near""",
)
def order_reach(led):
    # the sizes are those of the SQL; the matcher itself tries every order with all parts
    return O.order_reach(led.shop_orders, led.charges, reviewed(led, ROUNDS).where("status != 'rejected'"), bounds=BOUNDS)


@query(
    "unmatched_charge_filter",
    REVIEWED
    + """ SELECT id, account_id, date::VARCHAR AS date, amount_cents, merchant FROM charges
    WHERE (merchant ILIKE '%AMAZON%' OR merchant ILIKE '%AMZN%') AND amount_cents < 0
      AND id NOT IN (SELECT charge_id FROM reviewed WHERE status = 'confirmed')""",
)
def unmatched_charge_filter(led):
    return O.unmatched_charges(led.charges, reviewed(led), ["%AMAZON%", "%AMZN%"])


@query(
    "recent_matches",
    ALL
    + """, picked AS (
      (SELECT status, order_id, charge_id, amount_cents FROM matches WHERE status = 'suggested' ORDER BY charge_id DESC, order_id DESC LIMIT 30)
      UNION ALL (SELECT status, order_id, charge_id, amount_cents FROM matches WHERE status = 'confirmed' ORDER BY charge_id DESC, order_id DESC LIMIT 15))
    SELECT * FROM picked""",
)
def recent_matches(led):
    matches = all_matches(led)
    cols = ["status", "order_id", "charge_id", "amount_cents"]
    suggested = O.latest_matches(matches, "suggested", SUGGESTED_MATCHES_SHOWN).select(*cols)
    return suggested.unionByName(O.latest_matches(matches, "confirmed", CONFIRMED_MATCHES_SHOWN).select(*cols))


@query(
    "txn_detail_nested",
    """, parts AS (
      SELECT id, 'transaction' AS part, id AS part_id, account_id, category_id, amount_cents FROM transactions
      UNION ALL SELECT transfer_peer_id, 'peer', id, account_id, category_id, amount_cents FROM transactions WHERE transfer_peer_id IS NOT NULL
      UNION ALL SELECT transaction_id, 'split', line_no, NULL, category_id, amount_cents FROM splits
      UNION ALL SELECT id, 'order', id, NULL, NULL, -total_cents FROM shop_orders)
    SELECT p.id, p.part, p.part_id, a.name AS account_name, c.name AS category_name, p.amount_cents
    FROM parts p LEFT JOIN accounts a ON a.id = p.account_id LEFT JOIN categories c ON c.id = p.category_id""",
)
def txn_detail_nested(led):
    # the purchase behind an order's transaction carries the order's number
    matches = led.shop_orders.select(
        F.col("id").alias("transaction_id"),
        F.col("id").alias("order_id"),
        (-F.col("total_cents")).alias("amount_cents"),
    )
    return R.txn_detail(led.transactions, led.accounts, led.categories, led.splits, matches, led.shop_orders)


@query(
    "item_split_allocate",
    """, paid AS (SELECT id AS order_id, -total_cents AS amount_cents FROM shop_orders),
    run AS (SELECT i.*, p.amount_cents, CAST(sum(i.total_cents) OVER (PARTITION BY i.order_id ORDER BY item_id) AS HUGEINT) AS upto,
        CAST(sum(i.total_cents) OVER (PARTITION BY i.order_id) AS HUGEINT) AS whole
      FROM order_items i JOIN paid p ON p.order_id = i.order_id)
    SELECT order_id, item_id, part_id, total_cents, amount_cents, CAST(-(
      (2 * upto * abs(amount_cents) + whole) // (2 * whole) - (2 * (upto - total_cents) * abs(amount_cents) + whole) // (2 * whole)) AS BIGINT) AS share_cents
    FROM run""",
)
def allocate_items(led):
    paid = led.shop_orders.select(
        F.col("id").alias("order_id"), (-F.col("total_cents")).alias("amount_cents")
    )
    return item_split_allocate(paid, led.order_items)
