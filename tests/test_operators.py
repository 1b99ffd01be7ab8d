"""Operators against brute force on small fixtures with hot groups."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hearthbook.operators import balances as B
from hearthbook.operators import categorize as C
from hearthbook.operators import hints as H
from hearthbook.operators import ingest as I
from hearthbook.operators import orders as O
from hearthbook.operators import reports, staging
from hearthbook.operators import transfers as X
from hearthbook.operators.assign import nearest_first, one_to_one
from hearthbook.operators.ordering import lookup, positions, running, with_neighbors
from hearthbook.operators.splits import item_split_allocate

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def hot_rows(rng, n):
    """Rows of which a third share one key and one day."""
    for i in range(n):
        hot = rng.random() < 0.34
        yield (i * 7 + 1, "a" if hot else rng.choice("abcd"), day(0 if hot else rng.randrange(5)), rng.randrange(-9, 10))


def test_running_over_cut_groups(spark):
    rows = list(hot_rows(random.Random(1), 300))
    df = spark.createDataFrame(rows, "id long, k string, d date, v long")
    out = running(df, ["k"], "id", {"n": F.lit(1).cast("long"), "s": F.col("v")}, "d", tasks=9).collect()
    want = {}
    for key in "abcd":
        n = s = 0
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            n, s = n + 1, s + r[3]
            want[r[0]] = (n, s)
    assert {r["id"]: (r["n"], r["s"]) for r in out} == want


def test_positions_without_date(spark):
    rows = list(hot_rows(random.Random(2), 200))
    df = spark.createDataFrame(rows, "id long, k string, d date, v long")
    out = positions(df, ["k"], "id", tasks=7).collect()
    for key in "abcd":
        placed = sorted((r["id"], r["position"]) for r in out if r["k"] == key)
        assert [p for _, p in placed] == list(range(1, len(placed) + 1))


def test_neighbors(spark):
    rows = list(hot_rows(random.Random(3), 150))
    df = spark.createDataFrame(rows, "id long, k string, d date, v long")
    out = {r["id"]: r for r in with_neighbors(df, [], "id", "d", ["id"], tasks=11).collect()}
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)]
    assert len(out) == len(rows)
    for i, key in enumerate(order):
        assert out[key]["prev_id"] == (order[i - 1] if i else None)
        assert out[key]["next_id"] == (order[i + 1] if i + 1 < len(order) else None)


def test_lookup_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id long, c long")
    dim = spark.createDataFrame([(5, "five")], "key long, name string")
    got = {r["id"]: r["name"] for r in lookup(df, dim, "c", "key", "id").collect()}
    assert got == {1: None, 2: "five", 3: None}


def greedy(left, right, offsets):
    """One round per offset over whole groups, lowest ids first."""
    pairs, used_l, used_r = [], set(), set()
    for d in offsets:
        free = defaultdict(list)
        for rid, key, rday in sorted(right):
            if rid not in used_r:
                free[key, rday].append(rid)
        for lid, key, lday in sorted(left):
            bucket = free[key, lday - d]
            if lid not in used_l and bucket:
                rid = bucket.pop(0)
                used_l.add(lid), used_r.add(rid)
                pairs.append((lid, rid, d))
    return sorted(pairs)


def test_one_to_one_against_rounds(spark):
    rng = random.Random(4)
    def side(n, base):
        return [(base + i, "hot" if rng.random() < 0.5 else rng.choice("xyz"), rng.randrange(8)) for i in range(n)]
    left, right = side(120, 0), side(90, 1000)
    offsets = nearest_first(2)
    out = one_to_one(
        spark.createDataFrame(left, "left_id long, k string, day int"),
        spark.createDataFrame(right, "right_id long, k string, day int"),
        ["k"],
        offsets,
    ).collect()
    assert sorted((r["left_id"], r["right_id"], r["days"]) for r in out) == greedy(left, right, offsets)
    near = Counter(lid for lid, k, d in left for _, k2, d2 in right if k == k2 and abs(d - d2) <= 2)
    assert all(r["left_choices"] == near[r["left_id"]] for r in out)
    assert len({r["left_id"] for r in out}) == len({r["right_id"] for r in out}) == len(out)


TXN = "id long, account_id long, date date, amount_cents long, description string, merchant string, category_id long, category_source string, transfer_peer_id long, transfer_account_id long"


def txns(spark, rows):
    """(id, account, day, amount[, description[, merchant[, category]]])"""
    full = []
    for r in rows:
        i, a, d, c, *rest = r
        rest = list(rest) + [None] * (3 - len(rest))
        full.append((i, a, day(d), c, rest[0] or "x", rest[1] or "X", rest[2], None, None, None))
    return spark.createDataFrame(full, TXN)


def test_transfer_candidates_against_pairs(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.randrange(3), rng.randrange(10), rng.choice([-50, 50]) if rng.random() < 0.6 else rng.choice([-7, 7, -8, 8, 0]))
        for i in range(1, 121)
    ]
    rejected = set()
    ids = [r[0] for r in rows]
    while len(rejected) < 60:
        a, b = sorted(rng.sample(ids, 2))
        rejected.add((a, b))
    by_id = {r[0]: r for r in rows}
    partners = defaultdict(list)
    for a in rows:
        for b in rows:
            if a[3] and a[3] == -b[3] and a[1] != b[1] and abs(a[2] - b[2]) <= 3:
                if (min(a[0], b[0]), max(a[0], b[0])) not in rejected:
                    partners[a[0]].append(b[0])
    rej = spark.createDataFrame(sorted(rejected), "txn_a_id long, txn_b_id long")
    out = {r["id"]: r for r in X.leg_candidates(txns(spark, rows), rej).collect()}
    assert set(out) == {r[0] for r in rows if r[3]}
    for i, r in out.items():
        mine = partners[i]
        assert r["candidates"] == len(mine)
        assert r["nearest_days"] == (min(abs(by_id[i][2] - by_id[p][2]) for p in mine) if mine else None)
        assert r["only_partner_id"] == (mine[0] if len(mine) == 1 else None)
    linked = X.auto_link(txns(spark, rows), rej).collect()
    want = {(i, p[0]) for i, p in partners.items() if len(p) == 1 and partners[p[0]] == [i] and by_id[i][3] < 0}
    assert {(r["out_id"], r["in_id"]) for r in linked} == want
    # linking files both legs and leaves the rest alone
    applied = X.apply_links(
        txns(spark, rows), spark.createDataFrame([(1, 2, 21)], "out_id long, in_id long, category_id long")
    )
    got = {r["id"]: (r["transfer_peer_id"], r["category_id"], r["category_source"]) for r in applied.collect()}
    assert got[1] == (2, 21, "auto") and got[2] == (1, 21, "auto") and got[3] == (None, None, None)


ACCOUNTS = [
    (1, "Household Checking", "Chase", "1234"),
    (2, "Visa", "Chase", "5678"),
    (3, "Brokerage", "Vanguard", "9999"),
    (4, "Brokerage", "Fidelity", None),
    (5, "Joint", "Ally", "1234x"),
    (6, "VIS", "B", "4321"),
]
HINTS = [
    "stmt 1234.pdf", "xx991234 jan", "12345", "visa 2024", "brokerage q1", "my vanguard file", "chase jan",
    "nothing", "ALLY bank 9999 5678", "household checking fidelity", "b vis 77", "", "joint-0.pdf", "5678 5678",
]


def expected_hint(text):
    import re

    text = text.lower()
    runs = re.findall(r"\d+", text)
    fours = {r[-4:] for r in runs if len(r) >= 4}
    levels = [
        ("last_four", [a for a in ACCOUNTS if a[3] and re.fullmatch(r"\d{4}", a[3]) and a[3] in fours]),
        ("name", [a for a in ACCOUNTS if len(a[1]) >= 4 and a[1].lower() in text]),
        ("institution", [a for a in ACCOUNTS if len(a[2]) >= 3 and a[2].lower() in text]),
    ]
    for strength, found in levels:
        if found:
            one = len(found) == 1
            return ("match" if one else "ambiguous", strength, found[0][0] if one else None)
    return ("none", None, None)


def test_account_hints(spark):
    accounts = spark.createDataFrame(ACCOUNTS, "id long, name string, institution string, last_four string")
    out = H.account_hint_match(spark.createDataFrame([(h,) for h in HINTS], "text string"), accounts)
    got = {r["text"]: (r["outcome"], r["strength"], r["account_id"]) for r in out.collect()}
    assert got == {h.lower(): expected_hint(h) for h in HINTS}


def test_hints_send_no_exploded_rows_through_the_driver(spark):
    """Every text has some hundred character runs; they must not be broadcast because
    the texts themselves are few."""
    accounts = spark.createDataFrame(ACCOUNTS, "id long, name string, institution string, last_four string")
    hints = spark.range(400).select(F.concat(F.lit("visa "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    seen = []
    out = H.account_hint_match(hints, accounts)
    assert out.where("outcome != 'none'").count() == 400
    plan = out.groupBy("outcome").count()
    plan.collect()
    walk = [plan._jdf.queryExecution().executedPlan()]
    while walk:
        node = walk.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            walk.append(node.executedPlan())
        elif kind.endswith("QueryStage"):
            walk.append(node.plan())
        else:
            if kind == "BroadcastExchange":
                seen.append(node.metrics().apply("numOutputRows").value())
            walk += [node.children().apply(i) for i in range(node.children().size())]
    assert max(seen, default=0) <= 400


def test_import_twice_adds_nothing(spark):
    wall = [(i, 1, 0, -5, "SAME LINE") for i in range(1, 6)] + [(9, 1, 1, -7, "OTHER")]
    ledger = staging.with_dedupe_key(txns(spark, wall), ["account_id"])
    again = [(100 + r[0], *r[1:]) for r in wall] + [(200, 1, 0, -5, "SAME LINE")]
    staged = staging.with_dedupe_key(txns(spark, again).withColumn("batch_id", F.lit(1)), ["batch_id", "account_id"])
    judged = staging.classify_staged(staged.drop("merchant"), ledger)
    status = Counter(r["status"] for r in judged.collect())
    # the sixth identical line is new by hash, but looks like one on file
    assert status == {"duplicate": 6, "possible_duplicate": 1}


def test_overlaps_against_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        start = rng.randrange(60)
        rows.append((i, rng.choice([1, 1, 2]), rng.choice(["committed", "review"]), day(start), day(start + rng.randrange(20)), f"f{i}"))
    df = spark.createDataFrame(rows, "id long, account_id long, status string, period_start date, period_end date, filename string")
    got = {r["id"]: r["overlapping"] for r in staging.overlap_counts(df).collect()}
    want = {
        a[0]: sum(b[2] == "committed" and b[1] == a[1] and b[3] <= a[4] and a[3] <= b[4] for b in rows)
        for a in rows
        if a[2] == "review"
    }
    assert got == want
    listed = Counter(r["asked_id"] for r in staging.overlaps_of(df, df.where("status = 'review'")).collect())
    assert listed == Counter({k: v for k, v in want.items() if v})


def test_allocation_is_exact(spark):
    rng = random.Random(7)
    items = [(o, n, n, rng.randrange(1, 10_000)) for o in range(20) for n in range(1, rng.randrange(2, 9))]
    charges = [(o, rng.choice([-1, 1]) * rng.randrange(1, 10**9)) for o in range(20)]
    out = item_split_allocate(
        spark.createDataFrame(charges, "order_id long, amount_cents long"),
        spark.createDataFrame(items, "order_id long, item_id long, part_id long, total_cents long"),
    ).collect()
    sums, price = Counter(), Counter()
    for r in out:
        sums[r["order_id"]] += r["share_cents"]
    for o, _, _, c in items:
        price[o] += c
    assert dict(sums) == dict(charges)
    for r in out:  # within a cent of the plain proportion
        fair = r["amount_cents"] * r["total_cents"] / price[r["order_id"]]
        assert abs(r["share_cents"] - fair) <= 1


def test_order_matcher_kinds(spark):
    orders = spark.createDataFrame(
        [(1, 1, day(0), 1000), (2, 1, day(20), 3000), (3, 1, day(40), 500), (4, 1, day(41), 700), (5, 2, day(0), 90), (6, 2, day(1), 90)],
        "id long, account_id long, date date, total_cents long",
    )
    charges = spark.createDataFrame(
        [(11, 1, day(3), -1000, "m"), (12, 1, day(21), -1100, "m"), (13, 1, day(23), -1900, "m"), (14, 1, day(44), -1200, "m"), (15, 2, day(2), -90, "m")],
        "id long, account_id long, date date, amount_cents long, merchant string",
    )
    got = {(r["kind"], r["order_id"], r["charge_id"]): (r["amount_cents"], r["status"]) for r in O.run_matcher(orders, charges).collect()}
    assert got == {
        ("exact", 1, 11): (-1000, "confirmed"),
        ("exact", 6, 15): (-90, "suggested"),
        ("split", 2, 12): (-1100, "confirmed"),
        ("split", 2, 13): (-1900, "confirmed"),
        ("combined", 3, 14): (-500, "confirmed"),
        ("combined", 4, 14): (-700, "confirmed"),
    }


def test_windows_and_cleared_state(spark):
    rows = txns(spark, [(1, 1, 1, -10), (2, 1, 5, -20), (3, 1, 10, 5), (4, 1, 12, 7), (5, 1, 30, 1)])
    snaps = spark.createDataFrame(
        [(1, day(0), 100, "import"), (1, day(5), 70, "import"), (1, day(12), 90, "import")],
        "account_id long, date date, balance_cents long, source string",
    )
    windows = {r["to_date"]: (r["status"], r["gap_cents"], r["txn_count"]) for r in B.reconcile_windows(snaps, B.daily_activity(rows)).collect()}
    assert windows == {day(0): ("unanchored", None, None), day(5): ("ok", 0, 2), day(12): ("mismatch", 8, 2)}
    states = {r["id"]: r["cleared"] for r in B.cleared_state(snaps, rows).collect()}
    assert states == {1: "reconciled", 2: "reconciled", 3: "mismatch", 4: "mismatch", 5: "open"}
    # own activity as anchors leaves no gap
    upserted = B.balance_upsert(snaps, spark.createDataFrame([(1, day(12), 82, "manual")], snaps.schema), today="2024-12-31")
    fixed = B.reconcile_windows(upserted, B.daily_activity(rows)).where("status = 'mismatch'").count()
    assert fixed == 0
    future = spark.createDataFrame([(1, day(500), 1, "manual")], snaps.schema)
    assert B.balance_upsert(snaps, future, today="2024-12-31").count() == 3


def test_split_lines_replace_the_transaction(spark):
    rows = txns(spark, [(1, 1, 0, -100, None, None, 8), (2, 1, 0, -50, None, None, 9)])
    splits = spark.createDataFrame([(1, 8, -60), (1, None, -40)], "transaction_id long, category_id long, amount_cents long")
    got = sorted((r["transaction_id"], r["category_id"] or 0, r["amount_cents"]) for r in reports.effective_lines(rows, splits).collect())
    assert got == [(1, 0, -40), (1, 8, -60), (2, 9, -50)]


MAPPING = "file_id long, row_index long, record map<string,string>, date_column string, date_format string, description_columns array<string>, amount_style string, amount_column string, debit_column string, credit_column string, balance_column string"


def test_mapping_edge_cases(spark):
    def rec(i, **cells):
        style = cells.pop("style", "single_signed")
        return (1, i, cells, "Date", "MM/DD/YYYY", ["Desc"], style, "Amt", "Out", "In", "Bal")

    rows = [
        rec(0, Date="01/03/2024", Desc="a", Amt="-5", Bal="10"),
        rec(1, Date="01/03/2024", Desc="b", Amt="(6)", Bal="20"),
        rec(2, Date="01/02/2024", Desc="", Amt="0", Bal="99"),
        rec(3, Date="", Desc=" ", Amt=""),
        rec(4, Date="soon", Desc="c", Amt="1"),
        rec(5, Date="01/01/2024", Desc="d", Amt="abc"),
        rec(6, Date="01/01/2024", Desc=" e  f ", Out="5", In="", style="debit_credit", Bal="1"),
        rec(7, Date="01/01/2024", Out="0", In="-7", style="debit_credit", Bal="2"),
        rec(8, Date="01/01/2024", Desc="g", Out="x", In="0", style="debit_credit"),
        rec(9, Date="01/01/2024", Desc="h", Amt="4", style="single_inverted"),
    ]
    mapped = I.map_records(spark.createDataFrame(rows, MAPPING))
    got = {r["row_index"]: (r["description"], r["amount_cents"]) for r in I.mapped_rows(mapped).collect()}
    assert got == {0: ("a", -500), 1: ("b", -600), 6: ("e f", -500), 7: ("(no description)", 700), 8: ("g", 0), 9: ("h", -400)}
    errors = {r["row_index"]: r["problem"] for r in I.row_errors(mapped).collect()}
    assert errors == {4: 'Unparseable date "soon"', 5: "Unparseable amount"}
    # the file runs backward, so the first row of a day closes it
    anchors = {r["date"]: (r["row_index"], r["balance_cents"]) for r in I.running_balance_anchor(mapped).collect()}
    assert anchors == {dt.date(2024, 1, 3): (0, 1000), dt.date(2024, 1, 1): (6, 100)}


def test_memory_ranks(spark):
    memory = spark.createDataFrame(
        [("A", 1, "user", 3), ("B", 2, "ai", 1)], "merchant string, category_id long, source string, use_count long"
    )
    ai = spark.createDataFrame([("A", 9, "ai"), ("B", 9, "ai"), ("C", 9, "ai")], "merchant string, category_id long, source string")
    got = {r["merchant"]: (r["category_id"], r["source"], r["use_count"]) for r in C.memory_upsert(memory, ai).collect()}
    assert got == {"A": (1, "user", 4), "B": (9, "ai", 2), "C": (9, "ai", 1)}


def test_running_sums_with_scattered_ids(spark):
    """Hashed 64-bit ids in one hot group, cut into many partitions."""
    rng = random.Random(11)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(300)] + list(range(50))
    rows = [(1 if i % 3 else 2, dt.date(2024, 1, 1 + i % 5), x, i % 7 - 3) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "k long, date date, id long, v long")
    got = {(r["k"], r["id"]): r["upto"] for r in running(df, ["k"], "id", {"upto": F.col("v")}, "date").collect()}
    small = {(r["k"], r["id"]): r["upto"] for r in running(df, ["k"], "id", {"upto": F.col("v")}, "date", tasks=40).collect()}
    want, total = {}, {1: 0, 2: 0}
    for k, date, x, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] += v
        want[k, x] = total[k]
    assert got == want == small


def test_linked_rows_may_have_a_category(spark):
    from hearthbook.operators.hints import account_links

    accounts = spark.createDataFrame(
        [(1, "Everyday", "Bank", "1111", "transaction", "checking"), (2, "Brokerage", "Fund", "2222", "balance", "investment")],
        "id long, name string, institution string, last_four string, kind string, account_type string",
    )
    day = dt.date(2024, 1, 1)
    rows = [(1, 1, day, -5, "TRANSFER TO BROKERAGE", "TRANSFER", None, None, None), (2, 1, day, -5, "TRANSFER TO BROKERAGE", "TRANSFER", 3, None, None),
            (3, 1, day, -5, "TRANSFER TO BROKERAGE", "TRANSFER", None, 7, None)]
    txns = spark.createDataFrame(
        rows, "id long, account_id long, date date, amount_cents long, description string, merchant string, category_id long, transfer_peer_id long, transfer_account_id long"
    )
    assert sorted(r["id"] for r in account_links(txns, accounts).where("link").collect()) == [1, 2]


def test_a_rule_survives_its_category(spark):
    from hearthbook.operators.categorize import rules_merge

    memory = spark.createDataFrame([("A", 1, "user", 4), ("B", 99, "ai", 2)], "merchant string, category_id long, source string, use_count long")
    categories = spark.createDataFrame([(1, "Travel", "luxury")], "id long, name string, spending_class string")
    given = spark.createDataFrame([("C", "Gifts", "ai")], "merchant string, category string, source string")
    got = sorted(tuple(r) for r in rules_merge(memory, categories, given).fillna("none").collect())
    assert got == [("A", "Travel", "user", 4, "untouched"), ("B", "none", "ai", 2, "untouched"), ("C", "Gifts", "ai", 0, "added")]


def test_a_statement_without_a_balance_is_held(spark):
    from hearthbook.operators.statements import statement_hold_check, statement_tie_out

    day = dt.date(2024, 1, 31)
    files = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "batch_id long, account_id long")
    lines = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "batch_id long, amount_cents long")
    prints = [(1, 1, "opening", day, 0), (1, 1, "closing", day, 5), (2, 1, "closing", day, 5)]
    balances = spark.createDataFrame(prints, "batch_id long, account_id long, kind string, date date, balance_cents long")
    accounts = spark.createDataFrame([(1, "checking")], "id long, account_type string")
    out = statement_tie_out(files, lines, balances, accounts)
    assert {r["batch_id"]: r["blocked"] for r in out.collect()} == {1: False, 2: True, 3: True}
    on_file = spark.createDataFrame([], "account_id long, date date, balance_cents long")
    assert sorted(r["batch_id"] for r in statement_hold_check(out, balances, on_file).collect()) == [2, 3]


def test_overlapping_files_against_all_pairs(spark):
    from hearthbook.operators.staging import overlapping_files

    rng = random.Random(5)
    rows = []
    for i in range(160):
        start = dt.date(1969, 6, 1) + dt.timedelta(rng.randrange(900))
        account = None if i % 40 == 7 else 1 if i % 3 else 2
        rows.append((i, account, rng.choice(["review", "committed", "discarded"]), start, start + dt.timedelta(rng.choice([-1, 0, 1, 30, 365, 40000]))))
    df = spark.createDataFrame(rows, "id long, account_id long, status string, period_start date, period_end date")
    want = {
        (a[0], b[0]) for a in rows for b in rows
        if a[2] == "review" and b[2] == "committed" and a[1] == b[1] is not None and max(a[3], b[3]) <= min(a[4], b[4])
    }
    got = [tuple(r) for r in overlapping_files(df).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_staged_counts_name_the_files_that_provide_rows(spark):
    files = spark.createDataFrame([(1, "transactions", "a.csv", 9), (2, "statement", "b.pdf", 5), (3, "transactions", "b.pdf", 9)], "id long, kind string, filename string, row_count long")
    rows = spark.createDataFrame(
        # files 7 and 8 have no record of their own; 7 is no more reliable than 1, 8 has only what nobody else has
        [(1, 1, "x"), (1, 1, "y"), (2, 1, "x"), (7, 1, "y"), (7, 1, "z"), (8, 1, "w"), (8, 1, "z"), (3, 2, "x"), (1, 2, "x")],
        "batch_id long, account_id long, dedupe_hash string",
    ).withColumn("session_id", F.lit(5).cast("long"))
    marked = staging.cross_file_supersede(rows, files, unknown=True)
    assert marked.count() == rows.count() and staging.cross_file_supersede(rows, files).count() == 5
    status = F.when(F.col("dedupe_hash") == "w", F.lit("duplicate")).otherwise(F.lit("new"))
    staged = marked.select("batch_id", F.lit("transaction").alias("row_kind"), status.alias("status"), "superseded_by_batch_id")
    more = spark.createDataFrame([(1, "transaction", "new", 2), (1, "transaction", "new", 3), (1, "transaction", "new", 9), (4, "balance", "new", None)], staged.schema)
    out = {r["batch_id"]: tuple(r)[1:] for r in staging.staged_counts(staged.unionByName(more), files).collect()}
    assert out == {
        1: (2, 0, 0, 0, 4, '[{"filename":"#9","count":1},{"filename":"b.pdf","count":3}]'),
        2: (1, 0, 0, 0, 0, "[]"), 3: (0, 0, 0, 0, 1, '[{"filename":"a.csv","count":1}]'), 4: (0, 0, 0, 1, 0, "[]"),
        7: (1, 0, 0, 0, 1, '[{"filename":"a.csv","count":1}]'), 8: (0, 1, 0, 0, 1, '[{"filename":"#7","count":1}]'),
    }
