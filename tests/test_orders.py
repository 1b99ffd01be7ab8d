"""Splits and combinations beside a search through all subsets."""

import datetime as dt
import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from hearthbook.operators import orders as O
from hearthbook.operators.subsets import _finder, match_subsets
from hearthbook.plans.views_sql import subset_sql

START = dt.date(2024, 1, 1)


def frames(spark, orders, charges):
    """orders: (id, account, day, total); charges: (id, account, day, size)."""
    o = spark.createDataFrame([(i, a, START + dt.timedelta(d), t) for i, a, d, t in orders], "id long, account_id long, date date, total_cents long")
    c = spark.createDataFrame([(i, a, START + dt.timedelta(d), -s) for i, a, d, s in charges], "id long, account_id long, date date, amount_cents long")
    return o.repartition(3), c.repartition(3)


def searched(targets, parts, lo, hi, most, rounds):
    """{(target_id, part_id): (k, days, sure)} from the rules, on lists of (id, account, day, size)."""
    def grouped(rows):
        out = {}
        for i, a, d, s in sorted(rows):
            if s > 0:
                out.setdefault((a, d, s), []).append(i)
        return out

    ts, ps, out = grouped(targets), grouped(parts), {}
    for k in range(2, most + 1):
        subsets = {}
        for (a, d, s), ids in ts.items():
            near = sorted(p for p in ps if p[0] == a and d + lo <= p[1] <= d + hi and ps[p]) if ids else []
            for m in itertools.combinations_with_replacement(near, k):
                if sum(x[2] for x in m) == s and all(m.count(x) <= len(ps[x]) for x in m):
                    subsets.setdefault((a, d, s), []).append((max(abs(x[1] - d) for x in m), m))
        wanted = {}
        for t, found in subsets.items():
            for _, m in found:
                for x in set(m):
                    wanted.setdefault(x, []).append(t)
        sure = {t for t, f in subsets.items() if len(f) == 1 and len(ts[t]) == 1 and all(wanted[x] == [t] and len(ps[x]) == f[0][1].count(x) for x in f[0][1])}
        for _ in range(rounds):
            asked = {}
            for t, found in subsets.items():
                whole = [(far, m) for far, m in found if all(m.count(x) <= len(ps[x]) for x in m)]
                if whole and ts[t]:
                    asked[t] = min(whole)
            got, queue = {}, {}
            for t in sorted(asked):
                n = len(ts[t])
                for x in set(asked[t][1]):
                    times, taken = asked[t][1].count(x), queue.get(x, 0)
                    n = min(n, max(0, len(ps[x]) - taken) // times)
                    queue[x] = taken + times * len(ts[t])
                got[t] = n
            for t in sorted(asked):
                far, m = asked[t]
                for _ in range(got[t]):
                    i = ts[t].pop(0)
                    for x in m:
                        out[i, ps[x].pop(0)] = (k, far, t in sure)
    return out


def test_charges_between_and_four_parts(spark):
    orders = [(1, 1, 0, 1000), (2, 1, 0, 777), (3, 2, 5, 1111), (4, 3, 0, 300), (5, 3, 0, 300), (6, 4, 0, 50)]
    charges = [
        (11, 1, 1, 400), (12, 1, 2, 333), (13, 1, 3, 9), (14, 1, 4, 600), (15, 1, 9, 444),  # two orders interleave, one charge is strange
        (21, 2, 5, 100), (22, 2, 6, 11), (23, 2, 7, 500), (24, 2, 15, 500), (25, 2, 16, 1000),  # four parts; the last charge is too late
        (31, 3, 1, 100), (32, 3, 1, 100), (33, 3, 2, 200), (34, 3, 2, 200),  # two equal orders, equal charges
        (41, 4, 11, 20), (42, 4, 1, 30),  # one part too late
    ]
    o, c = frames(spark, orders, charges)
    got = {(r["order_id"], r["charge_id"]): (r["status"], r["days"]) for r in O.match_split(o, c).collect()}
    assert got == {
        (1, 11): ("confirmed", 4), (1, 14): ("confirmed", 4), (2, 12): ("confirmed", 9), (2, 15): ("confirmed", 9),
        **{(3, i): ("confirmed", 10) for i in (21, 22, 23, 24)},
        (4, 31): ("suggested", 2), (4, 33): ("suggested", 2), (5, 32): ("suggested", 2), (5, 34): ("suggested", 2),
    }
    left = {r["id"]: (r["reach"], r["tried"]) for r in O.order_reach(o, c, O.match_split(o, c)).collect()}
    assert left == {6: (1, 4)}
    # the other way round: four orders of one charge
    o, c = frames(spark, [(i, 1, d, s) for i, d, s in ((1, 0, 10), (2, 3, 20), (3, 3, 70), (4, 9, 31), (5, 9, 5))], [(9, 1, 10, 131)])
    got = {(r["order_id"], r["amount_cents"], r["days"]) for r in O.match_combined(o, c).collect()}
    assert got == {(1, -10, 10), (2, -20, 10), (3, -70, 10), (4, -31, 10)}


@pytest.mark.parametrize(("seed", "lo", "hi", "most"), [(1, 0, 10, 4), (2, -10, 0, 3)])
def test_hot_account_against_all_subsets(spark, seed, lo, hi, most):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(12)] + [5, 5, 10]
    parts = [(i, 1 if i % 3 else rng.randint(2, 6), rng.randint(0, 25), rng.choice(sizes)) for i in range(90)]
    targets = [(1000 + i, 1 if i % 3 else rng.randint(2, 6), rng.randint(0, 25), sum(rng.sample(sizes, rng.randint(2, 4)))) for i in range(45)] + [(2000, 1, 3, 0), (2001, 1, 3, -5)]
    make = lambda rows: spark.createDataFrame([(a, d, s, i) for i, a, d, s in rows], "account_id long, day long, size long, id long").repartition(4)
    found = match_subsets(make(targets), make(parts), lo, hi, most, {2: 10**6, 3: 10**6, 4: 10**6}, rounds=3).collect()
    got = {(r["target_id"], r["part_id"]): (r["k"], r["days"], r["sure"]) for r in found}
    assert len(got) == len(found) and len({r["part_id"] for r in found}) == len(found)
    assert got == searched(targets, parts, lo, hi, most, 3)


def test_bounds_are_reported(spark):
    orders = [(1, 1, 0, 6), (2, 2, 0, 6)]
    charges = [(10 * a + s, a, 1, s) for a in (1,) for s in (1, 2, 3)] + [(100 + s, 2, 1, s) for s in (1, 2, 3, 50, 60)]
    o, c = frames(spark, orders, charges)
    found = O.match_split(o, c, bounds={2: 9, 3: 4, 4: 3})
    assert {r["order_id"] for r in found.collect()} == {1}
    left = {r["id"]: (r["reach"], r["tried"]) for r in O.order_reach(o, c, found, bounds={2: 9, 3: 4, 4: 3}).collect()}
    assert left == {2: (5, 2)}
    none = spark.createDataFrame([], c.schema)
    assert O.match_split(o, none).count() == 0 and O.match_combined(o.limit(0), c).count() == 0


def cell_rows(spark, rows):
    return spark.createDataFrame([(a, d, s, i) for i, a, d, s in rows], "account_id long, day long, size long, id long").repartition(4)


def subsets_found(df):
    found = df.collect()
    out = {(r["target_id"], r["part_id"]): (r["k"], r["days"], r["sure"]) for r in found}
    assert len(out) == len(found)
    return out


def test_wide_windows_are_searched_with_all_parts(spark):
    # 130 cells in the window of the first order, 510 in that of the second
    charges = [(i, 1, 1 + i % 9, 1000 * i) for i in range(1, 127)] + [(900 + s, 1, 3, s) for s in (1, 2, 4, 8)]
    charges += [(2000 + i, 2, 1 + i % 9, 1000 * i) for i in range(1, 508)] + [(2900 + s, 2, 3, s) for s in (1, 2, 4)]
    o, c = frames(spark, [(1, 1, 0, 15), (2, 2, 0, 7)], charges)
    got = {(r["order_id"], r["charge_id"], r["status"]) for r in O.match_split(o, c).collect()}
    assert got == {(1, 900 + s, "confirmed") for s in (1, 2, 4, 8)} | {(2, 2900 + s, "confirmed") for s in (1, 2, 4)}
    left = frames(spark, [(3, 1, 0, 13)], charges)
    assert {(r["reach"], r["tried"]) for r in O.order_reach(*left, O.match_split(*left).limit(0)).collect()} == {(130, 4)}


@pytest.mark.parametrize(("seed", "lo", "hi", "joined"), [(3, 0, 10, {2: 0, 3: 0, 4: 0}), (4, -10, 0, {2: 9, 3: 6, 4: 5})])
def test_searched_windows_against_all_subsets(spark, seed, lo, hi, joined):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 40) for _ in range(12)] + [5, 5, 10]
    parts = [(i, 1 if i % 3 else rng.randint(2, 6), rng.randint(0, 25), rng.choice(sizes)) for i in range(80)]
    targets = [(1000 + i, 1 if i % 3 else rng.randint(2, 6), rng.randint(0, 25), sum(rng.sample(sizes, rng.randint(2, 4)))) for i in range(40)]
    got = subsets_found(match_subsets(cell_rows(spark, targets), cell_rows(spark, parts), lo, hi, joined=joined))
    assert got == searched(targets, parts, lo, hi, 4, 10**3)


def test_cells_are_dealt_until_nobody_asks(spark):
    # few sizes, so that many targets want the same cells and turn to others round after round
    rng = random.Random(129)
    parts = [(i, 1, rng.randint(0, 10), rng.randint(1, 9)) for i in range(40)]
    targets = [(100 + i, 1, rng.randint(0, 3), rng.randint(6, 12)) for i in range(30)]
    want = searched(targets, parts, 0, 10, 2, 10**3)
    assert len(want) > len(searched(targets, parts, 0, 10, 2, 3))
    assert subsets_found(match_subsets(cell_rows(spark, targets), cell_rows(spark, parts), 0, 10, most=2)) == want
    con = duckdb.connect()
    for name, rows in (("t", targets), ("p", parts)):
        values = ", ".join(f"({i}, {a}, DATE '1970-01-01' + {d}, {s})" for i, a, d, s in rows)
        con.execute(f"create table {name} as select * from (values {values}) v(id, account_id, date, size)")
    for rounds in (None, 3):
        sql = f"WITH nothing AS (SELECT 1){subset_sql('t', 'p', 0, 10, 2, rounds, 'x')} SELECT target_id, part_id, 2, days, sure FROM x"
        assert {(t, p): tuple(r) for t, p, *r in con.execute(sql).fetchall()} == searched(targets, parts, 0, 10, 2, rounds or 10**3)


@pytest.mark.parametrize(("k", "most"), [(2, 3), (3, 3), (4, 3), (4, 40), (4, 10**6)])
def test_a_search_holds_a_slice(k, most):
    rng = random.Random(k)
    parts = sorted({(rng.randint(0, 5), rng.randint(1, 9)): rng.randint(1, 4) for _ in range(14)}.items())
    targets = [0, 1, 7, 12, 13, 20, 90]
    rows = [{"account_id": 8, "t_day": 0, "asked": False, "day": d, "size": s, "n": n} for (d, s), n in rng.sample(parts, len(parts))]
    rows += [{"account_id": 8, "t_day": 0, "asked": True, "day": 0, "size": t, "n": 2} for t in targets]
    out = [r for b in _finder(k, most)(iter(pa.Table.from_pylist(rows).to_batches(max_chunksize=5))) for r in b.to_pylist()]
    got = [(r["t_size"], tuple((r[f"day{i}"], r[f"size{i}"], r[f"n{i}"]) for i in range(k))) for r in out]
    cells = [(d, s, n) for (d, s), n in parts]
    want = [(t, m) for t in targets for m in itertools.combinations_with_replacement(cells, k) if sum(x[1] for x in m) == t and all(m.count(x) <= x[2] for x in m)]
    assert want and sorted(got) == sorted(want)
