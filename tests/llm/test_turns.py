"""Conversation repair beside an exhaustive search."""

import hashlib
import itertools
import random
import re

import pytest

from hearthbook.llm import turns

LEGAL = re.compile(r"(s?(ua)+)?\Z")
FULL = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0d]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying forward every edit from every state, keeping the
    least of each state; states are the initials so far, cut to what matters."""
    best = {"": (0, "", ())}

    def put(into, state, value):
        if state not in into or value[:2] < into[state][:2]:
            into[state] = value

    def grown(state, x):
        whole = {"": "", "s": "s", "u": "u", "a": "ua"}[state] + x
        return x if x == "s" and not state or x in "ua" and any(LEGAL.match(whole + y) for y in ("", "a", "ua")) else None

    def inserted(old):
        new = dict(old)
        for _ in range(3):
            for state, (cost, audit, kept) in list(new.items()):
                for x in "ua":
                    to = grown(state, x)
                    if to is not None:
                        put(new, to, (cost + 2, audit + "I", (*kept, f"{FULL[x]}:")))
        return new

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        step = {}
        for state, (cost, audit, kept) in inserted(best).items():
            put(step, state, (cost + 3, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            to = grown(state, role[:1]) if role[:1] in ("s", "u", "a") else None
            if to is not None:
                put(step, to, (cost + more, audit + "K", (*kept, f"{role}:{text}")))
            for x in "ua":
                to = grown(state, x)
                if to is not None:
                    put(step, to, (cost + 2 + more, audit + "R", (*kept, f"{FULL[x]}:{text}")))
        best = step
    return min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])


def account(rows):
    """rows of (turn, role, text) of one conversation -> the columns of the account and digest."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    plain = [(r, x) for _, r, x in rows]
    numbers = [t for t, _, _ in rows if t is not None]
    found = faults(plain)
    cost, audit, kept = cheapest(plain)
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        *[found.count(x) for x in ("blank", "duplicate", "truncated")],
        sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(plain)),
        cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
    )


def test_search_by_hand():
    assert cheapest([("user", "a."), ("assistant", "b.")])[:2] == (0, "KK")
    assert cheapest([("system", "a."), ("user", "b.")])[:2] == (2, "KKI")
    assert cheapest([("user", "a."), ("user", "b.")])[:2] == (2, "KR")
    assert cheapest([("assistant", "a.")])[:2] == (2, "IK")
    assert cheapest([("tool", " ")])[:2] == (3, "D")


@pytest.mark.parametrize("seed", range(4))
def test_edits_of_one_chunk(seed):
    rng = random.Random(seed)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["x.", "y", "z!", " ", ""])) for _ in range(rng.randint(0, 9))]
        codes = []
        for (role, _), fault in zip(rows, faults(rows), strict=True):
            code = "sua".find(role[:1]) if role else -1
            codes.append((turns.OTHER if code < 0 else code) + (turns.TRUNCATED if fault == "truncated" else turns.MUST_GO if fault else 0))
        tool = turns.Chunks()
        cost, audit, _ = cheapest(rows)
        assert tool.start(bytes(codes), turns.END)[turns.NOTHING] == cost
        assert tool.trace(bytes(codes), [0] * len(codes), turns.END, turns.NOTHING, True)[0] == audit


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    roles = ["user", "assistant", "system", "tool", None, ""]
    weights = [8, 8, 1, 1, 1, 1]
    for c in range(25):
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, t, 3, None]), rng.choices(roles, weights)[0], rng.choice(["a.", "b", "c!", "", None, " \n", f"{t} é.", "d?\n"])))
    # a hot conversation, one whose rows all say user, and one of alternating roles with copies
    rows += [(100, t, rng.choices(roles, weights)[0], rng.choice([f"text {t}.", f"text {t}", "again."])) for t in range(150)]
    rows += [(101, t, "user", f"{t}.") for t in range(77)]
    rows += [(102, t // 2, "user" if t % 4 < 2 else "assistant", f"{t // 2}.") for t in range(80)]
    rows += [(None, 1, "user", "a null conversation."), (None, 2, "assistant", "yes."), (103, None, None, None)]
    rows += [(104, 1, "user", "copies.")] * 50
    return rows


@pytest.mark.parametrize(("chunk", "passes"), [(7, 4), (5, 0), (4096, 4)])
def test_repair(spark, chunk, passes):
    rows = conversations(chunk)
    wide = [(*r, "x", 1, 2) for r in rows]
    df = spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, c string, pos long, n long").repartition(5)
    fixed, told = turns.repair(df, chunk=chunk, passes=passes)
    digest = {r["c"]: r["repaired_sha256"] for r in turns.digests(fixed).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: (*[r[x] for x in turns.ACCOUNT], digest.get(r["c"], empty)) for r in told.collect()}
    groups = {}
    for c, *r in rows:
        groups.setdefault(c, []).append(r)
    assert got == {c: account(r) for c, r in groups.items()}
    texts = {(c, x) for c, _, _, x in rows}
    kept = fixed.collect()
    assert all((r["conv_id"], r["text"]) in texts for r in kept if r["action"] != "I")
    by = {}
    for r in sorted(kept, key=lambda r: (r["place"], r["step"])):
        by.setdefault(r["conv_id"], []).append(r["role"])
    assert all(LEGAL.match("".join(x[0] for x in roles)) for roles in by.values())


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    fixed, told = turns.repair(df)
    assert fixed.count() == told.count() == turns.digests(fixed).count() == 0
