"""The derived ledger of `sources/tables.py` once more, as SQL for the
comparison engine. Written separately; only the definitions are shared."""

from ..constants import STARTER_CATEGORIES

_CATEGORY_ROWS = ",\n    ".join(
    f"({i}, '{name}', '{klass}', {order})"
    for i, (name, klass, order) in enumerate(STARTER_CATEGORIES, start=1)
)

VIEWS = f"""
WITH categories AS (
  SELECT CAST(id AS BIGINT) AS id, name, spending_class, CAST(sort_order AS BIGINT) AS sort_order
  FROM (VALUES
    {_CATEGORY_ROWS}
  ) t(id, name, spending_class, sort_order)
),
accounts AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS institution, 'transaction' AS kind,
    (['checking','savings','credit_card','line_of_credit','other'])[c_custkey % 5 + 1] AS account_type,
    CASE WHEN c_nationkey % 3 <> 0 THEN right(c_name, 4) END AS last_four,
    c_mktsegment <> 'MACHINERY' AS is_active, CAST(c_nationkey AS BIGINT) AS sort_order
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT s_suppkey + 1000000000000, s_name, n_name, 'balance',
    (['mortgage','loan','investment','retirement'])[s_suppkey % 4 + 1],
    right(s_name, 4), s_acctbal >= 0, CAST(s_nationkey AS BIGINT)
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
base0 AS (
  SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
    o_orderpriority AS priority, o_orderstatus AS status,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS price,
    upper(p_name) AS part_name,
    'SUPPLIER#' || lpad(CAST(o_orderkey % (SELECT count(*) FROM supplier) AS VARCHAR), 9, '0') AS supplier_text,
    o_orderkey % (SELECT count(*) FROM supplier) AS supplier_no,
    o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' AS open_note
  FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
),
base1 AS (
  SELECT *,
    CAST(CASE WHEN priority = '1-URGENT' THEN -1599
      WHEN priority = '2-HIGH' AND id % 7 = 0 THEN 1599
      WHEN priority = '2-HIGH' THEN price ELSE -price END AS BIGINT) AS amount_cents,
    CASE WHEN open_note AND id % 3 = 0 THEN 'PAYMENT TO ' || supplier_text
      WHEN open_note AND id % 3 = 1 THEN 'FEE ' || supplier_text
      ELSE part_name || ' #' || CAST(id % 1000 AS VARCHAR) END AS description,
    CASE WHEN open_note AND id % 3 = 0 THEN 'PAYMENT TO SUPPLIER'
      WHEN open_note AND id % 3 = 1 THEN 'FEE SUPPLIER' ELSE part_name END AS merchant,
    CASE WHEN status <> 'P' THEN 1 + id % 23 END AS category_id,
    CASE status WHEN 'F' THEN 'user' WHEN 'O' THEN 'ai' END AS category_source
  FROM base0
),
base AS (
  SELECT *,
    status = 'P' AND priority = '5-LOW' AS mirrored,
    coalesce(category_id >= 21, false) AND priority = '4-NOT SPECIFIED' AS paired,
    CASE WHEN category_id >= 21 AND priority = '3-MEDIUM' THEN 1000000000000 + supplier_no END AS transfer_account_id,
    account_id * 100 + year(date) - 1990 AS import_batch_id
  FROM base1
),
transactions AS (
  SELECT id, account_id, date, amount_cents, description, merchant, category_id, category_source,
    CASE WHEN paired THEN id + 30000000000000 END AS transfer_peer_id, transfer_account_id, import_batch_id
  FROM base
  UNION ALL
  SELECT id + 10000000000000, xor(account_id, 1), date + CAST(id % 5 AS INTEGER), -amount_cents,
    'TRANSFER ' || description, merchant, NULL, NULL, NULL, NULL, NULL
  FROM base WHERE mirrored
  UNION ALL
  SELECT id + 20000000000000, account_id - account_id % 10 + (account_id + 3) % 10, date + 1, -amount_cents,
    'TRANSFER ' || description, merchant, NULL, NULL, NULL, NULL, NULL
  FROM base WHERE mirrored AND id % 4 = 0
  UNION ALL
  SELECT id + 30000000000000, xor(account_id, 1), date + 1, -amount_cents,
    'TRANSFER ' || description, merchant, category_id, 'auto', id, NULL, NULL
  FROM base WHERE paired
  UNION ALL
  SELECT id + 40000000000000, account_id, date, amount_cents, description, merchant, category_id,
    category_source, NULL, transfer_account_id, NULL
  FROM base WHERE status = 'F' AND priority = '3-MEDIUM'
  UNION ALL
  SELECT id + 50000000000000, account_id, date, amount_cents, description || ' POSTED', merchant, category_id,
    category_source, NULL, transfer_account_id, NULL
  FROM base WHERE status = 'O' AND priority = '3-MEDIUM'
),
splits AS (
  SELECT id AS transaction_id, 1 AS line_no, 1 + id % 23 AS category_id, amount_cents // 3 AS amount_cents
  FROM base WHERE status = 'F' AND priority = '5-LOW'
  UNION ALL
  SELECT id, 2, 1 + (id + 7) % 23, amount_cents - amount_cents // 3
  FROM base WHERE status = 'F' AND priority = '5-LOW'
),
lines AS (
  SELECT id AS transaction_id, account_id, date, category_id, amount_cents FROM transactions
  WHERE id NOT IN (SELECT transaction_id FROM splits)
  UNION ALL
  SELECT t.id, t.account_id, t.date, s.category_id, s.amount_cents
  FROM transactions t JOIN splits s ON s.transaction_id = t.id
),
monthly AS (
  SELECT account_id, last_day(date) AS date, sum(amount_cents) AS moved
  FROM transactions WHERE account_id % 11 <> 0 GROUP BY 1, 2
),
snapshots AS (
  SELECT account_id, date,
    CAST(sum(moved) OVER (PARTITION BY account_id ORDER BY date)
      + CASE (account_id + month(date)) % 7 WHEN 0 THEN 1599 WHEN 1 THEN 3198 ELSE 0 END AS BIGINT) AS balance_cents,
    'import' AS source
  FROM monthly
  UNION ALL
  SELECT s_suppkey + 1000000000000, last_day(CAST(DATE '1995-03-01' + to_months(CAST(3 * q AS INTEGER)) AS DATE)),
    CASE WHEN s_suppkey % 4 < 2 THEN -1 ELSE 1 END
      * (10 * CAST(CAST(abs(s_acctbal) AS DECIMAL(18,2)) * 100 AS BIGINT) + q * (s_suppkey % 97) * 100),
    'manual'
  FROM supplier, range(28) r(q)
),
rejections AS (
  SELECT id AS txn_a_id, id + 10000000000000 AS txn_b_id FROM base WHERE mirrored AND id % 10 = 7
),
batches0 AS (
  SELECT account_id, year(date) AS yr, min(date) AS period_start, max(date) AS last_date,
    count(*) AS row_count, CAST(sum(amount_cents) AS BIGINT) AS net_cents
  FROM base GROUP BY 1, 2
),
batches AS (
  SELECT account_id * 100 + yr - 1990 AS id,
    CASE WHEN account_id % 4 <> 0 THEN account_id // 10 END AS session_id, account_id,
    CASE WHEN account_id % 4 <> 0 AND (account_id // 10) % 3 <> 0 THEN 'statement' ELSE 'transactions' END AS kind,
    'stmt-' || lpad(CAST(account_id AS VARCHAR), 9, '0') || '-' || CAST(yr AS VARCHAR) || '.csv' AS filename,
    CAST(account_id // 2 AS VARCHAR) || '-' || CAST(yr AS VARCHAR) AS file_hash,
    CASE WHEN account_id % 7 = 0 THEN 'discarded' WHEN yr >= 2000 THEN 'review' ELSE 'committed' END AS status,
    period_start, last_date + CAST(account_id % 30 AS INTEGER) AS period_end, row_count, net_cents
  FROM batches0
),
sessions AS (
  SELECT session_id AS id,
    CASE session_id % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'reconcile' ELSE 'bulk' END AS purpose,
    CASE WHEN count(*) FILTER (status = 'review') > 0 THEN 'open' ELSE 'committed' END AS status
  FROM batches WHERE session_id IS NOT NULL GROUP BY 1
),
staged AS (
  SELECT id, import_batch_id AS batch_id, account_id,
    CASE WHEN account_id % 4 <> 0 THEN account_id // 10 END AS session_id,
    CASE WHEN status = 'P' THEN date + 4000 ELSE date END AS date,
    CASE WHEN status = 'O' THEN description || ' PENDING' ELSE description END AS description, amount_cents
  FROM base
  UNION ALL
  SELECT id + 10000000000000, account_id * 100 + (year(date) - 1989) % 12, account_id,
    CASE WHEN account_id % 4 <> 0 THEN account_id // 10 END,
    CASE WHEN status = 'P' THEN date + 4000 ELSE date END,
    CASE WHEN status = 'O' THEN description || ' PENDING' ELSE description END, amount_cents
  FROM base WHERE priority = '5-LOW'
),
statement_lines AS (
  SELECT id, import_batch_id AS batch_id, account_id, date + CAST(id % 6 AS INTEGER) AS date, description,
    CASE WHEN id % 31 = 0 THEN -amount_cents ELSE amount_cents END AS amount_cents
  FROM base
  UNION ALL
  SELECT id + 70000000000000, import_batch_id, account_id, date + CAST(id % 6 AS INTEGER), description, amount_cents + 77
  FROM base WHERE status = 'P' AND priority = '2-HIGH'
),
statement_balances AS (
  SELECT id AS batch_id, account_id, 'opening' AS kind, period_start AS date, account_id * 100 AS balance_cents FROM batches
  UNION ALL
  SELECT id, account_id, 'closing', last_day(period_end),
    account_id * 100 + net_cents + CASE WHEN account_id % 9 = 0 THEN 5 ELSE 0 END FROM batches
),
order_items AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_id,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS total_cents,
    CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS item_id
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey
),
shop0 AS (
  SELECT b.id, b.account_id, b.date, CAST(sum(i.total_cents) + b.id % 500 AS BIGINT) AS total_cents
  FROM base b JOIN order_items i ON i.order_id = b.id GROUP BY 1, 2, 3
),
shop_orders AS (
  SELECT id, account_id, date, total_cents FROM shop0
  UNION ALL
  SELECT id + 50000000000000, account_id, date + CAST(id % 3 AS INTEGER), 2 * total_cents + 1 FROM shop0 WHERE id % 3 = 2
),
charges AS (
  SELECT id, account_id, date + CAST(CASE id % 3 WHEN 0 THEN id % 8 WHEN 1 THEN 1 ELSE 4 END AS INTEGER) AS date,
    CASE id % 3 WHEN 0 THEN -total_cents WHEN 1 THEN -(total_cents // 3) ELSE -(3 * total_cents + 1) END AS amount_cents,
    CASE WHEN id % 2 = 0 THEN 'Amzn Mktp' ELSE 'AMAZON' END AS merchant
  FROM shop0
  UNION ALL
  SELECT id + 10000000000000, account_id, date + 4, total_cents // 3 - total_cents,
    CASE WHEN id % 2 = 0 THEN 'Amzn Mktp' ELSE 'AMAZON' END
  FROM shop0 WHERE id % 3 = 1
),
merchant_memory AS (
  SELECT merchant, 1 + length(merchant) % 23 AS category_id,
    CASE WHEN length(merchant) % 2 = 0 THEN 'user' ELSE 'ai' END AS source, count(*) AS use_count
  FROM base WHERE status <> 'P' AND length(merchant) % 3 <> 0 GROUP BY merchant
),
suggestions AS (
  SELECT DISTINCT merchant, 1 + (length(merchant) * 7) % 23 AS category_id, length(merchant) % 10 AS confidence_tenths
  FROM base
),
uploads0 AS (
  SELECT *, id % 101 = 0 AS is_blank,
    CASE WHEN id % 103 = 0 THEN 0 WHEN account_id % 3 = 1 THEN -amount_cents ELSE amount_cents END AS shown
  FROM base
),
uploads1 AS (
  SELECT *, CAST(abs(shown) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(shown) % 100 AS VARCHAR), 2, '0') AS dollars FROM uploads0
),
uploads AS (
  SELECT import_batch_id AS file_id, id AS row_index, account_id,
    account_id % 3 AS style_no, account_id % 6 AS format_no,
    CASE WHEN is_blank THEN '  ' WHEN id % 97 = 0 THEN '31/31/1999'
      WHEN account_id % 6 = 0 THEN strftime(date, '%Y-%m-%d 10:00')
      WHEN account_id % 6 = 1 THEN strftime(date, '%m/%d/%Y')
      WHEN account_id % 6 = 2 THEN strftime(date, '%-m-%-d-%Y')
      WHEN account_id % 6 = 3 THEN strftime(date, '%d/%m/%Y')
      WHEN account_id % 6 = 4 THEN strftime(date, '%Y/%-m/%-d')
      ELSE strftime(date, '%b %-d, %Y') END AS raw_date,
    CASE WHEN is_blank OR id % 103 = 0 THEN '' ELSE '  ' || replace(description, ' ', '  ') END AS raw_details,
    CASE WHEN NOT is_blank AND id % 103 <> 0 AND id % 5 = 0 THEN ' ref ' ELSE '' END AS raw_memo,
    CASE WHEN is_blank THEN '' WHEN id % 89 = 0 THEN dollars || ' CR'
      WHEN shown < 0 AND id % 3 = 0 THEN '-$' || dollars
      WHEN shown < 0 AND id % 3 = 1 THEN '(' || dollars || ')'
      WHEN shown < 0 THEN ' -' || dollars
      WHEN id % 2 = 0 THEN '$' || dollars ELSE dollars END AS raw_amount,
    CASE WHEN NOT is_blank AND shown < 0 THEN dollars ELSE '' END AS raw_debit,
    CASE WHEN NOT is_blank AND shown >= 0 THEN dollars ELSE '' END AS raw_credit,
    CASE WHEN is_blank OR id % 4 = 0 THEN '' ELSE CAST(id % 5000 AS VARCHAR) || '.5' END AS raw_balance
  FROM uploads1
)"""


def money_sql(text: str) -> str:
    """Cents of a printed amount, read with patterns."""
    t = f"trim({text})"
    bare = f"regexp_replace(regexp_replace({t}, '^\\((.*)\\)$', '\\1'), '[$,\\s]', '', 'g')"
    digits = f"regexp_replace({bare}, '^[-+]', '')"
    size = (
        f"CAST('0' || regexp_extract({digits}, '^([0-9]*)', 1) AS BIGINT) * 100"
        f" + CAST(substr(rpad(regexp_extract({digits}, '\\.([0-9]*)$', 1), 4, '0'), 1, 2) AS BIGINT)"
        f" + CASE WHEN substr(rpad(regexp_extract({digits}, '\\.([0-9]*)$', 1), 4, '0'), 3, 1) >= '5' THEN 1 ELSE 0 END"
    )
    return (
        f"CASE WHEN regexp_full_match({digits}, '[0-9]+(\\.[0-9]{{0,4}})?|\\.[0-9]{{1,4}}')"
        f" THEN (CASE WHEN {t} LIKE '(%)' OR {bare} LIKE '-%' THEN -1 ELSE 1 END) * ({size}) END"
    )


def date_sql(text: str, number: str) -> str:
    """A date by format number (the place in the list of formats)."""
    t = f"trim({text})"
    first = "'^(\\d{4})[-/](\\d{1,2})[-/](\\d{1,2})'"
    last = "'^(\\d{1,2})[-/](\\d{1,2})[-/](\\d{2,4})'"
    word = "'^([A-Za-z]{3,})\\.?\\s+(\\d{1,2}),?\\s+(\\d{4})'"

    def iso(pattern: str, y: int, m: int, d: int) -> str:
        return (
            f"regexp_extract({t}, {pattern}, {y}) || '-' || lpad(regexp_extract({t}, {pattern}, {m}), 2, '0')"
            f" || '-' || lpad(regexp_extract({t}, {pattern}, {d}), 2, '0')"
        )

    worded = f"try_strptime(regexp_extract({t}, {word}, 0), '%b %d, %Y')::DATE"
    return (
        f"CASE WHEN {number} IN (0, 4) THEN TRY_CAST({iso(first, 1, 2, 3)} AS DATE)"
        f" WHEN {number} IN (1, 2) THEN TRY_CAST({iso(last, 3, 1, 2)} AS DATE)"
        f" WHEN {number} = 3 THEN TRY_CAST({iso(last, 3, 2, 1)} AS DATE)"
        f" ELSE {worded} END"
    )


def assign_sql(left: str, right: str, keys: list[str], offsets: list[int], out: str) -> str:
    """CTEs that pair ``left`` (keys, date, left_id) with ``right`` (keys, date,
    right_id) row by row, one round per offset, ending in ``out``."""
    key_list = ", ".join(keys)
    on = " AND ".join(f"l.{k} = r.{k}" for k in keys)
    parts = [f"{out}_all0 AS (SELECT 0 AS left_id, 0 AS right_id, 0 AS days WHERE false)"]
    for i, d in enumerate(offsets, start=1):
        done = f"{out}_all{i - 1}"
        parts.append(
            f"{out}_l{i} AS (SELECT *, row_number() OVER (PARTITION BY {key_list}, date ORDER BY left_id) AS rn"
            f" FROM {left} WHERE left_id NOT IN (SELECT left_id FROM {done}))"
        )
        parts.append(
            f"{out}_r{i} AS (SELECT *, row_number() OVER (PARTITION BY {key_list}, date ORDER BY right_id) AS rn"
            f" FROM {right} WHERE right_id NOT IN (SELECT right_id FROM {done}))"
        )
        parts.append(
            f"{out}_all{i} AS MATERIALIZED (SELECT * FROM {done} UNION ALL SELECT l.left_id, r.right_id, {d}"
            f" FROM {out}_l{i} l JOIN {out}_r{i} r ON {on} AND l.rn = r.rn AND l.date = r.date + {d})"
        )
    lo, hi = min(offsets), max(offsets)
    near = f"{on} AND l.date - r.date BETWEEN {lo} AND {hi}"
    parts.append(
        f"{out} AS MATERIALIZED (SELECT a.*, x.n AS left_choices, y.n AS right_choices FROM {out}_all{len(offsets)} a"
        f" JOIN (SELECT l.left_id, count(*) AS n FROM {left} l JOIN {right} r ON {near} GROUP BY 1) x ON x.left_id = a.left_id"
        f" JOIN (SELECT r.right_id, count(*) AS n FROM {left} l JOIN {right} r ON {near} GROUP BY 1) y ON y.right_id = a.right_id)"
    )
    return ", " + ",\n".join(parts)


def _dealt_sql(m: str) -> str:
    """Rounds of dealing the members ``m`` until no target asks any more. Each round has
    the subsets that are still whole, and what of them was granted in it (got)."""
    kept = "account_id, td, ts, tn, subset, days, d, s, n, times"
    target, whole, cell = "account_id, td, ts", "account_id, td, ts, subset", "account_id, d, s"
    run = f"OVER (PARTITION BY {cell}, asked ORDER BY td, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    state = f"SELECT it + 1 AS it, {kept}, rest - sum(times * got) OVER (PARTITION BY {cell}) AS rest, due - max(got) OVER (PARTITION BY {target}) AS due FROM r"
    live = f"SELECT * FROM (SELECT *, min(rest - times) OVER (PARTITION BY {whole}) AS spare FROM ({state})) WHERE spare >= 0 AND due > 0"
    asked = f"SELECT *, dense_rank() OVER (PARTITION BY {target} ORDER BY days, subset) = 1 AS asked FROM ({live})"
    queued = f"SELECT *, coalesce(sum(times * due) {run}, 0) AS queue FROM ({asked})"
    got = f"SELECT *, CASE WHEN asked THEN min(least(due, greatest(0, rest - queue) // times)) OVER (PARTITION BY {target}, asked) ELSE 0 END AS got FROM ({queued})"
    big = lambda x, name: f"CAST({x} AS BIGINT) AS {name}"
    first = ", ".join(big(x, name) for x, name in (("n", "rest"), ("tn", "due"), ("0", "got"), ("0", "t_from"), ("0", "p_from")))
    dealt = ", ".join(big(x, x) for x in ("rest", "due", "got"))
    dealt += ", " + big("tn - due", "t_from") + ", " + big(f"n - rest + coalesce(sum(times * got) {run}, 0)", "p_from")
    return (
        f"WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS it, {kept}, {first} FROM {m} UNION ALL SELECT it, {kept}, {dealt} FROM ({got}))"
        f" SELECT {whole}, d, s, times, got, t_from, p_from FROM r WHERE got > 0"
    )


def subset_sql(targets: str, parts: str, lo: int, hi: int, most: int, rounds: int | None, out: str) -> str:
    """CTEs that meet ``targets`` by 2..most ``parts`` (both account_id, date, size, id)
    lo..hi days away, by trying every combination; ``out`` has target_id, part_id, days
    and sure. Written from the rules, row lists in place of running sums. Without
    ``rounds`` cells are dealt until nobody asks any more."""
    day = "date - DATE '1970-01-01'"
    ctes = [
        f"{out}_{x}1 AS MATERIALIZED (SELECT account_id, CAST({day} AS BIGINT) AS d, size AS s, count(*) AS n, list(id ORDER BY id) AS ids, 0 AS used"
        f" FROM {table} WHERE size > 0 GROUP BY 1, 2, 3)"
        for x, table in (("t", targets), ("p", parts))
    ]
    names = "xyzw"
    for k in range(2, most + 1):
        t, p, own = f"{out}_t{k - 1}", f"{out}_p{k - 1}", names[:k]
        joins, spent = [], "t.s"
        for i, x in enumerate(own):
            on = f"{x}.account_id = t.account_id AND {x}.n > 0 AND {x}.d - t.d BETWEEN {lo} AND {hi}"
            on += f" AND {x}.s = {spent}" if i == k - 1 else f" AND {x}.s < {spent}"
            if i:
                on += f" AND ({x}.d, {x}.s) >= ({own[i - 1]}.d, {own[i - 1]}.s)"
            joins.append(f"JOIN {p} {x} ON {on}")
            spent += f" - {x}.s"
        members = "[" + ", ".join(f"{{'d': {x}.d, 's': {x}.s, 'n': {x}.n}}" for x in own) + "]"
        flat = "[" + ", ".join(f"{x}.d, {x}.s" for x in own) + "]"
        far = "greatest(" + ", ".join(f"abs({x}.d - t.d)" for x in own) + ")"
        c, m = f"{out}_c{k}", f"{out}_m{k}"
        ctes.append(
            f"{c} AS MATERIALIZED (SELECT * FROM (SELECT t.account_id, t.d AS td, t.s AS ts, t.n AS tn, {far} AS days, {flat} AS subset, {members} AS members"
            f" FROM {t} t {' '.join(joins)} WHERE t.n > 0) WHERE len(list_filter(members, lambda m: len(list_filter(members, lambda o: o = m)) > m.n)) = 0)"
        )
        ctes.append(
            f"{m} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY account_id, d, s) AS wanted FROM (SELECT account_id, td, ts, tn, days, subset, choices,"
            f" m.d AS d, m.s AS s, m.n AS n, count(*) AS times FROM (SELECT *, count(*) OVER (PARTITION BY account_id, td, ts) AS choices FROM {c}),"
            f" unnest(members) u(m) GROUP BY ALL))"
        )
        if rounds is None:
            ctes.append(f"{out}_g{k} AS MATERIALIZED ({_dealt_sql(m)})")
        else:
            ctes.append(f"{out}_g{k}_0 AS (SELECT account_id, td, ts, subset, d, s, times, 0 AS got, 0 AS t_from, 0 AS p_from FROM {m} WHERE false)")
        for r in range(1, (rounds or 0) + 1):
            g = f"{out}_g{k}_{r - 1}"
            run = "OVER (PARTITION BY account_id, d, s ORDER BY td, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
            ctes.append(
                f"{out}_a{k}_{r} AS (SELECT m.*, m.n - coalesce(a.gone, 0) AS rest, m.tn - coalesce(b.met, 0) AS due FROM {m} m"
                f" LEFT JOIN (SELECT account_id, d, s, sum(times * got) AS gone FROM {g} GROUP BY 1, 2, 3) a USING (account_id, d, s)"
                f" LEFT JOIN (SELECT account_id, td, ts, sum(got) AS met FROM (SELECT DISTINCT account_id, td, ts, subset, got, t_from FROM {g}) GROUP BY 1, 2, 3) b USING (account_id, td, ts))"
            )
            ctes.append(
                f"{out}_b{k}_{r} AS (SELECT a.*, coalesce(sum(times * due) {run}, 0) AS queue FROM {out}_a{k}_{r} a JOIN ("
                f"SELECT account_id, td, ts, subset FROM (SELECT account_id, td, ts, subset, days FROM {out}_a{k}_{r} GROUP BY ALL HAVING min(rest - times) >= 0 AND min(due) > 0)"
                f" QUALIFY row_number() OVER (PARTITION BY account_id, td, ts ORDER BY days, subset) = 1) USING (account_id, td, ts, subset))"
            )
            ctes.append(
                f"{out}_g{k}_{r} AS MATERIALIZED (SELECT * FROM {g} UNION ALL SELECT account_id, td, ts, subset, d, s, times, got, tn - due,"
                f" n - rest + coalesce(sum(times * got) {run}, 0) FROM (SELECT *, min(least(due, greatest(0, rest - queue) // times))"
                f" OVER (PARTITION BY account_id, td, ts) AS got FROM {out}_b{k}_{r}) WHERE got > 0)"
            )
        g = f"{out}_g{k}" if rounds is None else f"{out}_g{k}_{rounds}"
        ctes.append(
            f"{out}_r{k} AS (SELECT t.ids[CAST(t.used + t_from + j AS BIGINT)] AS target_id, p.ids[CAST(p.used + p_from + (j - 1) * g.times + i AS BIGINT)] AS part_id, m.days,"
            f" bool_and(m.tn = 1 AND m.choices = 1 AND m.wanted = 1 AND m.n = m.times) OVER (PARTITION BY g.account_id, g.td, g.ts, g.subset) AS sure"
            f" FROM {g} g JOIN {m} m USING (account_id, td, ts, subset, d, s) JOIN {t} t ON t.account_id = g.account_id AND t.d = g.td AND t.s = g.ts"
            f" JOIN {p} p ON p.account_id = g.account_id AND p.d = g.d AND p.s = g.s,"
            f" unnest(range(1, CAST(g.got AS BIGINT) + 1)) a(j), unnest(range(1, g.times + 1)) b(i))"
        )
        met = f"SELECT account_id, td AS d, ts AS s, sum(got) AS gone FROM (SELECT DISTINCT account_id, td, ts, subset, got, t_from FROM {g}) GROUP BY 1, 2, 3"
        gone = f"SELECT account_id, d, s, sum(times * got) AS gone FROM {g} GROUP BY 1, 2, 3"
        for x, less in (("t", met), ("p", gone)):
            ctes.append(
                f"{out}_{x}{k} AS MATERIALIZED (SELECT account_id, d, s, n - coalesce(gone, 0) AS n, ids, used + coalesce(gone, 0) AS used"
                f" FROM {out}_{x}{k - 1} LEFT JOIN ({less}) USING (account_id, d, s))"
            )
    every = " UNION ALL ".join(f"SELECT * FROM {out}_r{k}" for k in range(2, most + 1))
    ctes.append(f"{out} AS MATERIALIZED ({every})")
    return ", " + ",\n".join(ctes)
