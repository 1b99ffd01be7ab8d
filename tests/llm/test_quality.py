"""Quality: held-out accuracy, the solver beside its optimum, and edges."""

import numpy as np
from llm_data import EDGE, documents, sentence

from hearthbook.llm import quality
from hearthbook.llm import queries as registered


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = registered.QUERIES["op13_quality"](spark, sf).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_dual_descent_reaches_the_optimum():
    """At the optimum w is the sum of the errors: w = sum 2 C max(0, 1 - y f) y x."""
    rng = np.random.default_rng(1)
    xs = [np.sort(rng.choice(12, 5, replace=False)).astype(np.int32) for _ in range(60)]
    y = np.array([1.0 if 3 in x or rng.random() < 0.1 else -1.0 for x in xs])
    ratio = rng.normal(size=12)
    w, bias = quality.hinge(xs, y, ratio, 1.0, 2000)
    rows = np.zeros((60, 13))
    for r, x in zip(rows, xs, strict=True):
        r[x], r[12] = ratio[x], 1
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    cost = np.array([60 / (2 * np.count_nonzero(y == s)) for s in y])
    full = np.append(w, bias)
    want = (2 * cost * np.maximum(0, 1 - y * (rows @ full)) * y) @ rows
    assert np.allclose(full, want, atol=1e-2)


def test_quality_edges(spark, edge, empty):
    train = [(i, sentence(i, 30), 1) for i in range(12)] + [(20 + i, " ".join(w + "###" for w in sentence(i, 30).split()), 0) for i in range(12)]
    model = quality.fit(spark.createDataFrame([*train, (98, None, 1), (99, "x", None)], "doc_id long, text string, quality int"))
    out = quality.score_texts(edge, model, keep=["doc_id"]).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[1] == by[2] == by[3] and by[7] == by[8]  # null, empty and blank alike; copies alike
    a, b = quality.score_texts(documents(spark, [(1, sentence(50, 40)), (2, " ".join(w + "###" for w in sentence(51, 40).split()))]), model).orderBy("doc_id").collect()
    assert a["predicted"] == 1 and b["predicted"] == 0 and "lang" in a.asDict()
    none = quality.fit(spark.createDataFrame([], "doc_id long, text string, quality int"))
    assert {r["predicted"] for r in quality.score_texts(edge, none).collect()} == {0}
    assert quality.score_texts(empty, model).count() == 0
