"""Near duplicates, repeated passages, decontamination: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_data import EDGE, documents, sentence
from pyspark.sql import functions as F

from hearthbook.llm import components, decontaminate, jaccard_join, suffix_dedup

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def groups(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            if s and 100 * len(s & sets[b]) >= percent * len(s | sets[b]):
                parent[root(a)] = root(b)
    name = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            name[root(a)] = min(name.get(root(a), i), i)
    return [(i, len(sets[a]), name.get(root(a))) for a, (i, _) in enumerate(rows)]


def near_copies(n, seed=1):
    """One hot text in many edited versions, chains that link only through others, and
    small sets."""
    rng, rows = random.Random(seed), []
    base = sentence(5, 150).split()
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        w = sentence(6, rng.randint(1, 30)).split()
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_near_duplicates(spark, width, percent):
    rows = near_copies(120) + [(i + 1000, t) for i, t in EDGE if i is not None]
    got = jaccard_join.near_duplicates(documents(spark, rows).repartition(4), width=width, percent=percent)
    assert sorted(map(tuple, got.collect())) == sorted(groups(rows, width, percent))


def test_near_duplicate_edges(spark, edge, empty):
    got = jaccard_join.near_duplicates(edge).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(groups(EDGE, 4, 85), key=key)
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 10, 12, 13]


def test_one_of_each_group_stays(spark):
    """Repeated rows and null ids too, and what stays outlives the cut of repeats."""
    long, near, alone = sentence(21, 200), sentence(22, 200), sentence(23, 200)
    rows = [(5, long)] * 40 + [(None, long)] * 3 + [(None, near)] * 2 + [(None, near + " more"), (3, alone), (None, alone)]
    rows += [(8, sentence(24, 90)), (8, sentence(25, 90)), (8, sentence(24, 90)), (9, sentence(25, 90) + " end")]
    rows += [(11, "!!! ..."), (11, "   "), (12, "   ")]
    frame = documents(spark, rows).repartition(3)
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    first = [t for i, t in got if not i]
    assert len(first) == 1 and first[0] in (near, near + " more")
    want = [(3, alone), (5, long), (8, sentence(24, 90)), (8, sentence(25, 90)), (11, "!!! ..."), (11, "   "), (12, "   ")]
    assert got[1:] == sorted(want)
    cut = suffix_dedup.cut_repeats(kept, least=256).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in cut) == got


def test_keys_of_linked_sets_meet():
    """The pigeonhole with left-out segments, on pairs at the threshold."""
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, n // 12) + 1))
        y = np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 12) + 1)), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if not len(y) or not jaccard_join.links(x, y, 85) or (len(x) == len(y) and (x == y).all()):
            continue
        row, key = jaccard_join.all_keys([x, y], 85)
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_large_group_cells_find_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.06], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(50)]
    component = rng.integers(0, 6, 50)
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if component[i] != component[j] and jaccard_join.links(sets[i], sets[j], 85)}
    got = set(jaccard_join.cross_links(np.arange(50), component, sets, None, 85))
    assert got == want and want
    second = np.arange(50) >= 25
    halves = set(jaccard_join.cross_links(np.arange(50), component, sets, second, 85))
    assert halves == {(i, j) for i, j in want if i < 25 <= j}


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3), (5, None), (1, 0)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(400), 0), **dict.fromkeys(range(1000, 1101), 1000)}
    assert components.connected(spark.createDataFrame([], "src long, dst long")).count() == 0


def without_repeats(rows, least):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[j : j + least] for j in range(len(b) - least + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - least + 1):
            if seen[b[j : j + least]] > 1:
                gone[j : j + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), any(gone)))
    return out


def passages(seed=1):
    rng = random.Random(seed)
    shared = [sentence(50 + k, rng.randint(8, 25)) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [sentence(100 + i * 9 + k, rng.randint(2, 30)) for k in range(3)]
        for p in rng.sample(shared, rng.randint(0, 3)):
            parts.insert(rng.randint(0, 3), p[rng.randint(0, 9) :])
        rows.append((i, " ".join(parts)))
    return rows + [(100, "a" * 700), (101, "ab" * 300), (102, "é" * 300), (103, rows[0][1]), (103, rows[0][1])]


@pytest.mark.parametrize("least,hot", [(60, 4096), (60, 1), (7, 2), (1, 4096)])
def test_repeats(spark, least, hot):
    rows = passages() if least > 1 else [(1, "abca"), (2, "xyz"), (3, "zw"), (4, None), (5, "")]
    got = suffix_dedup.report(documents(spark, rows).repartition(4), least=least, hot=hot).collect()
    assert sorted(map(tuple, got)) == sorted(without_repeats(rows, least))


def test_repeat_edges(spark, edge, empty):
    got = suffix_dedup.report(edge, least=50).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, without_repeats(EDGE, 50)))
    assert suffix_dedup.report(empty).count() == 0 and suffix_dedup.cut_repeats(empty).count() == 0
    cut = suffix_dedup.cut_repeats(edge, least=50)
    assert cut.columns == edge.columns
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert text[1] is None and text[2] == "" and text[7] == "" and text[12] == sentence(3, 12)
    # a character of which a byte stays is kept
    accents = suffix_dedup.cut_repeats(documents(spark, [(1, "xé" + "é" * 40), (2, "y" + "é" * 41)]), least=9)
    assert {r["text"] for r in accents.collect()} == {"x", "y"}


def test_copies_are_searched_once(spark):
    """One document of copies stands for all, null ids and repeated rows included; both
    ways of joining agree."""
    rows = [(i, "copied " * 20) for i in (7, 3, 9)] + [(3, "copied " * 20), (None, "x"), (None, "x"), (1, "alone"), (2, None), (4, "")]
    texts = documents(spark, rows).selectExpr("unhex(sha2(coalesce(text, ''), 256)) AS key", "CAST(doc_id AS string) AS doc", "CAST(coalesce(text, '') AS binary) AS body")
    for few in (100, 0):
        got = sorted((bytes(r["body"])[:6], r["doc"], r["weight"]) for r in suffix_dedup.one_per_text(texts, few).collect())
        assert got == [(b"", "2", 2), (b"alone", "1", 1), (b"copied", "3", 4), (b"copied", "3", 4), (b"x", None, 2), (b"x", None, 2)]
    many = documents(spark, [(i, "first " * 30 + "tail") for i in range(300)] + [(400, "first " * 30)])
    got = suffix_dedup.report(many.repartition(5), least=60).collect()
    assert sorted(map(tuple, got)) == sorted(without_repeats([(r["doc_id"], r["text"]) for r in many.collect()], 60))


def test_long_texts_are_coded_in_pieces(monkeypatch):
    """Words have the same codes wherever a long text is cut, a word longer than a piece too."""
    rows = [sentence(9, 400), "", "w" * 900, sentence(3, 2), " \n ", sentence(4, 90) + "  " + "v" * 500 + " " + sentence(5, 90)]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
    whole, at = suffix_dedup.coded(data, offsets)
    assert list(np.diff(at) // suffix_dedup.WORD_BYTES) == [len(r.split()) for r in rows]
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 200)
    pieces, places = suffix_dedup.coded(data, offsets)
    assert (pieces == whole).all() and (places == at).all()


def test_a_text_longer_than_a_piece(spark, monkeypatch):
    one = sentence(9, 400)
    data, offsets = np.frombuffer(one.encode(), np.uint8), np.array([0, len(one.encode())])
    whole = suffix_dedup.anchored(data, offsets, 8, 50)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 300)
    found = []
    for rows, starts, ends in suffix_dedup._pieces(offsets, 50):
        for a, b in zip(starts, ends, strict=True):
            _, first, last, anchor = suffix_dedup.anchored(data[a:b], np.array([0, b - a]), 8, 50)
            found += [(p + a, h) for f, l, h in zip(first, last, anchor, strict=True) for p in range(f, l + 1)]
    assert found == [(p, h) for f, l, h in zip(*whole[1:], strict=True) for p in range(f, l + 1)]


def test_repeated_strings_of_words(spark):
    """51 short words go though they are few bytes, 50 stay; against brute force."""
    rng = random.Random(4)
    word = lambda n: ["".join(rng.choice("abéd") for _ in range(rng.randint(1, 3))) for _ in range(n)]
    passage, fifty, texts = word(51), word(50), []
    for i in range(6):
        own = [f"{w}{i}x{j}" for j, w in enumerate(word(60))]
        texts.append(own[:20] + (passage if i < 2 else fifty if i < 4 else word(9)) + own[20:])
    texts[5] += passage[:30] + ["and"] + passage[30:] + word(100)
    texts += [["no"] * 51, ["on"] * 52, []]
    assert len(" ".join(passage).encode()) < 256
    at = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    rows, want = [], []
    for i, t in enumerate(texts):
        rows.append((i, ("  \n" if i == 1 else " ").join(t)))
        gone = {j for s in range(len(t) - 50) if at[tuple(t[s : s + 51])] > 1 for j in range(s, s + 51)}
        want.append([w for j, w in enumerate(t) if j not in gone])
    for hot in (suffix_dedup.HOT, 1):
        out = suffix_dedup.cut_repeats(documents(spark, rows).repartition(2), least=10_000, hot=hot, words=51)
        assert [t.split() for _, t in sorted((r["doc_id"], r["text"]) for r in out.collect())] == want
    assert len(want[0]) == 60 and len(want[2]) == 110 and want[6] == texts[6] and not want[7]
    import corpus_pipeline

    docs = documents(spark, rows[:6]).select("doc_id", "text", "n_chars")
    assert min(len(r["text"].split()) for r in corpus_pipeline.repeats(spark, docs, "").where("doc_id < 2").collect()) == 60


def test_passages_of_few_bytes_are_counted(spark, edge, empty):
    """Passages of 51 words count with and without 400 bytes; what goes is decided by
    bytes alone. Against brute force."""
    rng = random.Random(8)
    word = lambda n: ["".join(rng.choice("abéd") for _ in range(rng.randint(1, 3))) for _ in range(n)]
    own, passage, long = (lambda i: [f"{w}{i}x{j}" for j, w in enumerate(word(60))]), word(51), [f"longer{w}word" for w in word(70)]
    texts = [own(i)[:20] + part + own(i)[20:] for i, part in enumerate([passage, passage, word(50), long, passage[1:] + long[5:], passage[:50]])]
    texts += [own(7) + passage + own(8) + passage[:50] + long, ["no"] * 51, ["on"] * 52, word(51), [], *[own(9)] * 2]
    at = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    rows, want = [(i, ("\n " if i % 3 == 1 else " ").join(t)) for i, t in enumerate(texts)], []
    rows += [(90, None), (91, "")]
    for t in [*texts, [], []]:
        gone = {j for s in range(len(t) - 50) if at[tuple(t[s : s + 51])] > 1 for j in range(s, s + 51)}
        want.append((len(gone), sum(j - 1 not in gone for j in gone)))
    for hot in (suffix_dedup.HOT, 0):
        got = sorted(map(tuple, suffix_dedup.report(documents(spark, rows).repartition(3), hot=hot, words=51).collect()))
        assert [r[:6] for r in got] == sorted(without_repeats(rows, 400))
        assert [r[6:] for r in got] == want
    assert got[0][2] == 0 and want[0] == (51, 1) and got[3][2] > 400 and want[6][1] == 2
    assert suffix_dedup.report(edge, words=51).count() == len(EDGE) and suffix_dedup.report(empty, words=51).count() == 0


def test_registered_repeats_name_short_passages(spark, tmp_path):
    """A passage of over 50 words that two documents share shows though it has fewer than
    400 bytes."""
    from hearthbook.llm import queries

    passage = " ".join(f"w{i % 47}" for i in range(60))
    assert len(passage) < 400
    rows = [(1, f"here {passage} ends"), (2, f"there {passage} is more"), (3, "nothing like it " + " ".join(map(str, range(200))))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).select("doc_id", "n_removed", "n_passage_words", "n_passages")
    assert sorted(map(tuple, out.collect())) == [(1, 0, 60, 1), (2, 0, 60, 1), (3, 0, 0, 0)]


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(3)
    for symbols in (1, 2, 5, 300, 70_000) * 12:
        text = rng.integers(0, symbols, rng.integers(1, 90)).astype(np.int32)
        text = np.tile(text, rng.integers(1, 4))
        order, levels = suffix_dedup.suffix_order(text)
        suffixes = [text[i:].tolist() for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=suffixes.__getitem__)
        both = list(zip(order[:-1].tolist(), order[1:].tolist(), strict=True))
        shared = [next((k for k, (x, y) in enumerate(zip(suffixes[i], suffixes[j], strict=False)) if x != y), min(len(suffixes[i]), len(suffixes[j]))) for i, j in both]
        assert suffix_dedup.common_prefix(levels, text, order[:-1], order[1:]).tolist() == shared


def windows_brute(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate({65 + k: 97 + k for k in range(26)}))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, u in items:
            v = words(u)
            if not v:
                continue
            n = min(size, len(v))
            grams = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    ids |= {str(item)} - {"None"}  # an item without an id isn't named
        out.append((i, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    return out


ITEMS = [(1, sentence(2, 14)), (2, "Naïve 日本語"), (3, None), (4, ""), (10, sentence(3, 12).upper()), (None, "one"), (11, "a null key"), (11, sentence(2, 11))]


def test_decontamination(spark, edge, empty):
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, key string")
    docs = [*EDGE, (20, "x " + sentence(2, 14).replace(" ", ", ") + " y " + sentence(3, 12)), (21, sentence(2, 9))]
    frame = documents(spark, docs)
    got = decontaminate.report(frame, items).withColumn("items", F.array_join("items", ",")).collect()
    want = windows_brute(docs, ITEMS)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for few in (0, 3):  # nothing is small enough to broadcast
        again = decontaminate.report(frame, items, few=few).withColumn("items", F.array_join("items", ",")).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert decontaminate.report(empty, items).count() == 0
    none = decontaminate.report(edge, items.limit(0)).collect()
    assert len(none) == len(EDGE) and not any(r["contaminated"] for r in none)
    clean = decontaminate.keep_clean(frame, items)
    assert clean.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, *_, bad in want if not bad)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(frame, items).collect()}
    assert cut[20] == "x y " and cut[21] == sentence(2, 9) and cut[1] is None


def test_items_without_an_id_and_hot_texts(spark):
    """Words of an unnamed item are hit, named items alone are counted; copies of a hit
    text and null texts, by broadcast and by shuffle."""
    unnamed, named = sentence(71, 14), sentence(72, 11)
    items = spark.createDataFrame([(None, unnamed), (None, "only"), ("a", named), ("b", named)], "item_id string, text string")
    rows = [(1, "x " + unnamed), (2, unnamed + " " + named), (3, "clean text"), (4, "only")] + [(10 + i, named) for i in range(50)]
    rows += [(100 + i, None) for i in range(50)] + [(None, None), (None, None)]
    frame = documents(spark, rows)
    size = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()))
    both = size(unnamed) + size(named)
    want = [(1, size(unnamed) + 1, size(unnamed), 0, [], True), (2, both, both, 2, ["a", "b"], True), (3, 2, 0, 0, [], False), (4, 1, 1, 0, [], True)]
    want += [(10 + i, size(named), size(named), 2, ["a", "b"], True) for i in range(50)]
    want += [(i, 0, 0, 0, [], False) for i in [*range(100, 150), None, None]]
    for few in (1_000_000, 0):
        got = decontaminate.report(frame, items, few=few).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["doc_id"] for r in decontaminate.keep_clean(frame, items).collect()} == {3, None, *range(100, 150)}


def test_no_python_in_decontamination(spark, edge):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate.report(edge, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
