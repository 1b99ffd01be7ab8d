"""Merkle manifest beside a tree built level by level."""

import hashlib
import random

import pytest
from llm_data import EDGE, documents
from pyspark.sql import functions as F

from hearthbook.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """(root, per leaf the list of (left, right) siblings)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for path, p in zip(paths, at, strict=True):
            run = runs[p // arity]
            path.append((run[: p % arity], run[p % arity + 1 :]))
        level, at = [digest(*r) for r in runs], [p // arity for p in at]
    return level[0], paths


def want(rows, arity):
    """doc_id, leaf, subroot, root, proof for rows of (doc_id, source, leaf)."""
    groups = {}
    for i, s, d in rows:
        groups.setdefault(s, []).append((i, d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[s] = tree([d for _, d in groups[s]], arity)
    root, tops = tree([built[s][0] for s in order], arity)
    out = []
    for s, top in zip(order, tops, strict=True):
        subroot, paths = built[s]
        for (i, d), path in zip(groups[s], paths, strict=True):
            proof = digest(*(x for left, right in path + top for x in left + right))
            out.append((i, d, subroot, root, proof))
    return out


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_appending_leaf_by_leaf(arity):
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82]:
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        own = merkle.Appender(arity)
        for x in leaves:
            own.append(x)
        root, paths = tree([x.hex() for x in leaves], arity)
        assert own.close().hex() == root
        for x, witness, path in zip(leaves, own.witnesses, paths, strict=True):
            assert [([d.hex() for d in a], [d.hex() for d in b]) for a, b in merkle.steps(merkle.packed(witness))] == path
            assert merkle.fold(x, merkle.packed(witness)).hex() == root


def test_witness_grows_with_its_siblings():
    own = merkle.Appender(3)
    for i in range(3):
        own.append(bytes([i]) * 32)
    assert own.witnesses == [[], [], []]  # the run is complete once the next one begins
    own.append(b"x" * 32)
    assert own.witnesses[0] == [([], [b"\1" * 32, b"\2" * 32])] and own.witnesses[3] == []


@pytest.mark.parametrize(("arity", "levels"), [(3, 1), (3, 2), (2, 3), (3, 8)])
def test_manifest_of_a_hot_group(spark, arity, levels):
    rng = random.Random(arity * 10 + levels)
    rows = [(i, "hot", f"text {i % 7}") for i in range(120)] + [(5, "hot", "twice")] * 3
    rows += [(1000 + i, f"s{rng.randint(0, 14)}", "x\n" * (i % 3)) for i in range(60)]
    rows += [(None, "hot", None), (2000, None, "no source"), (2001, "", "empty source"), (2002, "é", "ü"), (2003, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    leaf = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("text"))
    other = F.when(F.col("text").contains("\n"), merkle.leaf(F.col("doc_id"), F.col("source"), F.translate("text", "\n", "")))
    found = merkle.manifest(df, "source", "doc_id", leaf, other, arity, levels)
    rows_ = merkle.audited(found, "doc_id").collect()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    leaves = [(i, s, digest(field(i), field(s), field(t))) for i, s, t in rows]
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows_]
    assert sorted(map(str, got)) == sorted(map(str, want(leaves, arity)))
    changed = {i for i, _, t in rows if t and "\n" in t}
    assert all(r["verified"] == (r["doc_id"] not in changed) == (r["folded_root"] == r["root"]) for r in rows_)
    assert sorted(r["position"] for r in found.where("source = 'hot'").collect()) == list(range(124))


def test_registered_rules_and_edges(spark, edge, empty):
    leaf = merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    rows = merkle.audited(merkle.manifest(edge, "source", "doc_id", leaf), "doc_id").collect()
    assert len(rows) == len(EDGE) and all(r["verified"] for r in rows) and len({r["root"] for r in rows}) == 1
    assert merkle.manifest(empty, "source", "doc_id", leaf).count() == 0
    one = merkle.audited(merkle.manifest(documents(spark, [(1, "t")]), "source", "doc_id", leaf), "doc_id").first()
    assert one["leaf"] == one["subroot"] == one["root"] == digest("1:1", "1:s", "2:en", "1:0", "1:t")
    assert one["proof_sha256"] == digest("")
