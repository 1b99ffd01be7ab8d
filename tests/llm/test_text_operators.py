"""Byte pairs, languages, toxicity and licenses."""

import base64
import hashlib
import random
import timeit

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_data import EDGE, LONG, documents
from pyspark.sql import functions as F

from hearthbook.llm import bpe, langid, license_scan, toxicity
from hearthbook.llm import queries as registered

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_equals_the_library(library):
    own, rng = bpe.Codec(PATH, P.PATTERN), random.Random(5)
    texts = ["", "a", "aaaa" * 500, "éè" * 40, "<|endoftext|>", " \n\t x  ", "a" * 20_000]
    texts += ["".join(rng.choice("abeth éü1.,\n") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text in texts:
        want = library.encode_ordinary(text)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert own.decode(own.encode(text)) == text.encode()


def test_short_pieces_need_no_tree(library, monkeypatch):
    """Words are merged without the tree: the same ids around the bound, in less time."""
    own, rng = bpe.Codec(PATH, P.PATTERN), random.Random(6)
    parts = ["th", "er", "on", "aa", "é", "ß", "x", "ing", "ü", "\u4e2d", "q"]
    words = ["".join(rng.choice(parts) for _ in range(n)) for n in range(1, 90) for _ in range(4)] + ["a" * n for n in range(1, 140)]
    raw = [rng.randbytes(n) for n in range(2, 80)] + [w.encode() for w in words]
    usual = [" " + "".join(rng.choice(parts) for _ in range(5)) for _ in range(3000)]
    took = {}
    for short in (bpe.SHORT, 0):
        monkeypatch.setattr(bpe, "SHORT", short)
        got = [bpe.merge(r, own.ranks) for r in raw]
        took[short] = min(timeit.repeat(lambda: [bpe.merge(u.encode(), own.ranks) for u in usual], number=1, repeat=5)), got
    (less, a), (more, b) = took.values()
    assert a == b and a[78:] == [library._encode_single_piece(w) for w in words]
    assert less < 0.85 * more


def test_bpe_rows(spark, edge, empty, library):
    got = sorted(map(str, bpe.round_trip(edge, PATH, P.PATTERN, keep=["doc_id"]).collect()))
    want = []
    for i, t in EDGE:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    rows = bpe.round_trip(edge, PATH, P.PATTERN, keep=["doc_id"]).collect()
    assert len(got) == len(EDGE) and sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe.round_trip(empty, PATH, P.PATTERN).count() == 0
    encoded = bpe.encode_texts(edge, PATH, P.PATTERN)
    assert set(edge.columns) - {"text"} <= set(encoded.columns)


def test_language_accuracy_and_edges(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = registered.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01")
    both = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = both.where("lang = lang_pred").count() / both.count()
    assert right > 0.97
    model = langid.fit(docs, per_language=40, landmarks=10)
    rows = langid.predict(edge, model, keep=["doc_id"]).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGE)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 13))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert by[7]["lang_pred"] == by[8]["lang_pred"] != "und"
    nothing = langid.fit(empty)
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.predict(edge, nothing).collect()} == {"und"}
    one = langid.fit(documents(spark, [(1, "only one language here")]))
    assert {r["lang_pred"] for r in langid.predict(edge, one).where("doc_id in (4, 7)").collect()} == {"en"}
    assert langid.predict(empty, model).count() == 0


def test_toxicity_auc_and_edges(spark, edge, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registered.QUERIES["op7_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "score").collect()
    bad = [r["score"] for r in rows if r["toxic"] == 1]
    good = sorted(r["score"] for r in rows if r["toxic"] == 0)
    auc = np.mean(np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")) / 2 / len(good)
    assert auc > 0.97
    train = [(i, t, y) for y, words in ((1, "you stupid loser"), (0, "a calm river")) for i, t in enumerate([words + f" {k}" for k in range(8)], 10 * y)]
    model = toxicity.fit(spark.createDataFrame([*train, (99, None, 0), (98, "x", None)], "doc_id long, text string, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score_texts(edge, model, keep=["doc_id"]).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert out[1]["score"] == out[2]["score"]
    more = documents(spark, [(1, "what a stupid loser"), (2, "the calm river")])
    a, b = toxicity.score_texts(more, model).orderBy("doc_id").collect()
    assert a["predicted"] == 1 and b["predicted"] == 0 and "lang" in a.asDict()
    none = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert {r["predicted"] for r in toxicity.score_texts(edge, none).collect()} == {0}
    assert toxicity.score_texts(empty, model).count() == 0


def test_increasing_is_a_longest_one():
    rng = random.Random(3)
    for _ in range(200):
        values = rng.sample(range(50), rng.randint(0, 12))
        kept = [values[i] for i in license_scan.increasing(values)]
        assert kept == sorted(kept)
        best = [0] * (len(values) + 1)
        for i, v in enumerate(values):
            best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
        assert len(kept) == max(best, default=0)


def test_licenses(spark, edge, empty):
    t = license_scan.TEMPLATES
    edited = t["MIT"].replace("merge", "blend").replace("publish,", "")
    rows = [
        (1, t["MIT-line"]), (2, LONG + " " + edited + " " + LONG), (3, (t["Apache-2.0-line"] + "\n") * 3),
        (4, "the license of the river under the version"), (5, None), (6, ""), (7, t["Apache-2.0"]),
        (8, t["GPL-3.0-line"].upper() + " " + t["CC-BY-NC-4.0-line"]),
    ]
    out = {r["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    assert [out[i]["licenses"] for i in range(1, 9)] == [
        "MIT-line", "MIT", "Apache-2.0-line", "", "", "", "Apache-2.0", "CC-BY-NC-4.0-line,GPL-3.0-line",
    ]
    assert out[2]["spans"].startswith("MIT:3000-") and 0.9 < out[2]["coverage"] < 1
    assert out[3]["n_spans"] == 3 and out[7]["n_spans"] == 1
    assert license_scan.scan(edge).count() == len(EDGE) and license_scan.scan(empty).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = [t[n] for n in t if n.endswith("line")]
    want = docs.where(F.expr(" or ".join(f"contains(text, '{x}')" for x in lines))).select("doc_id").collect()
    got = registered.QUERIES["op4_license_scan"](spark, "/root/testdata/sf0.01").where("n_spans > 0").select("doc_id").collect()
    assert sorted(want) == sorted(got)


def test_edited_licenses(spark):
    """An edited copy is found wherever the words it lacks stand, beside an intact one too."""
    mit = license_scan.TEMPLATES["MIT"]
    edited, other = mit.replace("The above", "The foregoing"), mit.replace("granted", "given").replace("subject", "liable")
    rows = [
        (1, f"{edited} {LONG} above a notice"), (2, f"{mit} {LONG} {edited}"), (3, f"{edited} {mit}"),
        (4, f"{other} x y {edited} x {mit}"), (5, f"{mit} above {LONG} {other} granted a subject"),
    ]
    out = {r["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    assert [out[i]["n_spans"] for i in range(1, 6)] == [1, 2, 2, 3, 2]
    assert out[1]["spans"] == "MIT:0-87" and out[3]["spans"] == "MIT:0-87,MIT:87-174"
    scanner, rng, size = license_scan.Scanner({"MIT": mit}, 0.8), random.Random(3), 87
    words = license_scan.WORD.findall(mit.lower())
    for _ in range(60):
        copies = [[f"q{rng.randrange(10**6)}" if i in gone else w for i, w in enumerate(words)] for gone in (set(rng.sample(range(1, size - 1), rng.randint(0, 17))) for _ in range(3))]
        around = [rng.choices([*words, "river", "stone"], k=3) + [f"z{i}" for i in range(200)] for _ in range(4)]
        text = [*around[0], *(w for copy, more in zip(copies, around[1:], strict=True) for w in copy + more)]
        assert len(scanner.spans(" ".join(text))) == 3
