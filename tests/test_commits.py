"""The index of a ledger and commits that are all or nothing."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from hearthbook.operators.staging import classify_staged, with_dedupe_key
from hearthbook.sources import commits as C
from hearthbook.sources.index import DedupeIndex, packed, unpacked

LINES = "id long, account_id long, date date, amount_cents long, description string"
START = dt.date(2024, 1, 30)


def lines(spark, rows):
    """(id, account, day, cents, text) as rows of a file numbered by the hundreds of the id."""
    df = spark.createDataFrame([(i, a, START + dt.timedelta(d), c, x) for i, a, d, c, x in rows], LINES).withColumn("batch_id", F.expr("id div 100"))
    return with_dedupe_key(df, ["account_id", "batch_id"]).withColumn("merchant", F.lit("m")).withColumn("category_id", F.lit(None).cast("long"))


def balances(spark, rows):
    return spark.createDataFrame([(a, START + dt.timedelta(d), c, "import", b) for a, d, c, b in rows], C.BALANCES)


@pytest.fixture
def books(spark, tmp_path):
    name = f"ix{uuid.uuid4().hex}"
    nobody = spark.createDataFrame([], "txn_a_id long, txn_b_id long")
    return C.CommitLog(spark, f"{tmp_path}/books"), DedupeIndex(spark, name, f"{tmp_path}/index", 4), nobody


def told(df):
    return {r["batch_id"]: tuple(r)[1:] for r in df.collect()}


def test_index_answers_like_the_ledger(spark, tmp_path):
    ledger = lines(spark, [(i, i % 3, i % 70, i % 5, f"text {i % 4}") for i in range(300)])
    staged = lines(spark, [(1000 + i, i % 4, i % 90, i % 6, f"text {i % 5}") for i in range(200)])
    index = DedupeIndex(spark, f"ix{uuid.uuid4().hex}", f"{tmp_path}/index", 4)
    for part in (0, 1):
        index.add(ledger.where(f"id % 2 = {part}"))
    index.add(ledger.where("id < 10"))  # entered twice
    near = classify_staged(staged, *index.around(staged))
    want = classify_staged(staged, ledger)
    key = ["id", "status", "duplicate_of_id"]
    assert sorted(map(tuple, near.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    # another session's catalog finds what lies there
    again = DedupeIndex(spark, f"ix{uuid.uuid4().hex}", f"{tmp_path}/index", 4)
    assert again.around(staged)[0].count() == index.around(staged)[0].count() > 0


def test_import_does_not_shuffle_the_index(spark, tmp_path):
    ledger = lines(spark, [(i, i % 3, i % 70, i % 5, f"text {i % 4}") for i in range(300)])
    index = DedupeIndex(spark, f"ix{uuid.uuid4().hex}", f"{tmp_path}/index", 4)
    index.add(ledger)
    staged = lines(spark, [(1000, 1, 3, 3, "text 3")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = classify_staged(staged, *index.around(staged))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [x for x in plan.splitlines() if "FileScan" in x and "month" in x]
    assert len(scans) == 2 and all("Bucketed: true" in x and re.search(r"PartitionFilters: \[[^]]*month", x) for x in scans)
    depth = lambda x: re.search(r"[A-Za-z]", x).start()
    for scan in scans:  # between a scan of the index and the join above it lies no exchange
        at, seen = depth(scan), []
        for x in reversed(plan.splitlines()[: plan.splitlines().index(scan)]):
            if depth(x) < at:
                at = depth(x)
                seen.append(x)
            if "Join" in seen[-1]:
                break
        assert "SortMergeJoin" in seen[-1] and not any("Exchange" in x for x in seen)


def test_commit_tells_what_it_did(spark, books):
    log, index, nobody = books
    first = lines(spark, [(100, 1, 0, -500, "out"), (101, 1, 0, -9, "same"), (102, 1, 0, -9, "same")])
    assert told(C.commit_import(log, index, first, balances(spark, [(1, 0, 70, 1), (1, 1, 80, 1)]), nobody)) == {1: (3, 0, 2, 0)}
    # a later file repeats two lines, brings the other leg of a transfer and one balance anew
    second = lines(spark, [(200, 1, 0, -500, "out"), (201, 1, 0, -9, "same"), (202, 2, 3, 500, "in"), (203, 2, 3, 8, "new")])
    out = C.commit_import(log, index, second, balances(spark, [(1, 1, 80, 2), (1, 0, 71, 2)]), nobody)
    assert told(out) == {2: (2, 2, 1, 1)}
    assert log.version() == 2 and log.read("rows").count() == 5 and log.read("rows", 1).count() == 3
    assert [tuple(r) for r in log.read("links").select("out_id", "in_id").collect()] == [(100, 202)]
    assert {(r["date"].day, r["balance_cents"]) for r in log.balances().collect()} == {(30, 71), (31, 80)}
    assert told(C.commit_import(log, index, second, balances(spark, []), nobody)) == {2: (0, 4, 0, 0)}
    log.compact()
    assert len(log.commits()) == 1 and log.read("rows").count() == 5 and log.read("rows", 2).count() == 5
    assert {(r["date"].day, r["balance_cents"]) for r in log.balances().collect()} == {(30, 71), (31, 80)}
    assert told(C.commit_import(log, index, second, balances(spark, []), nobody)) == {2: (0, 4, 0, 0)}


def test_a_writer_that_dies_shows_nothing(spark, books):
    log, index, nobody = books
    rows = lines(spark, [(100, 1, 0, -500, "a"), (101, 1, 40, 500, "b")])

    def dies():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        C.commit_import(log, index, rows, balances(spark, [(1, 0, 7, 1)]), nobody, before_publish=dies)
    assert log.version() == 0 and log.read("rows").count() == 0 and log.balances().count() == 0
    assert told(C.commit_import(log, index, rows, balances(spark, [(1, 0, 7, 1)]), nobody)) == {1: (2, 0, 1, 0)}
    # one that dies between publishing and the index: the next commit enters it
    lost = lines(spark, [(300, 5, 0, 1, "late")])
    log.publish(log.stage({"rows": lost}), log.version())
    assert told(C.commit_import(log, index, lost, balances(spark, []), nobody)) == {3: (0, 1, 0, 0)}
    assert log.read("rows").count() == 3


def test_two_writers_add_a_row_once(spark, books):
    log, index, nobody = books
    rows = lines(spark, [(100, 1, 0, -500, "a"), (101, 1, 1, 3, "b")])
    once = iter([True])

    def other():
        if next(once, False):
            assert told(C.commit_import(log, index, rows.where("id = 100"), balances(spark, []), nobody)) == {1: (1, 0, 0, 0)}

    assert told(C.commit_import(log, index, rows, balances(spark, []), nobody, before_publish=other)) == {1: (1, 1, 0, 0)}
    assert log.version() == 2 and sorted(r["id"] for r in log.read("rows").collect()) == [100, 101]
    staged = log.stage({"rows": rows.limit(0)})
    with pytest.raises(C.Conflict):
        log.publish(staged, 1)
    assert log.version() == 2


def test_hashes_are_packed_and_come_back(spark):
    texts = ["00ff", "00FF", "abc", "", None, "no hash", "é", "0a" * 32]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, dedupe_hash string")
    small = packed(rows)
    assert small.where("_raw is not null and _odd is not null").count() == 0 and small.where("length(_raw) = 32").count() == 1
    assert {r["id"]: r["dedupe_hash"] for r in unpacked(small.repartition(3)).collect()} == dict(enumerate(texts))


def test_a_commit_writes_its_rows_once(spark, books, monkeypatch):
    log, index, nobody = books
    written, cut = [], C.cut_lineage

    def noted(df, *more):
        written.append(cut(df, *more))
        return written[-1]

    monkeypatch.setattr(C, "cut_lineage", noted)
    # only 500 moves both ways; of the second import's amounts 9 does not
    first = lines(spark, [(100, 1, 0, -500, "out"), (101, 1, 0, -9, "same"), (102, 1, 0, -70, "one way"), (103, 4, 0, 70, "the other")])
    assert told(C.commit_import(log, index, first, balances(spark, []), nobody)) == {1: (4, 0, 0, 2)}
    assert sum("dedupe_hash" in df.columns for df in written) == 1  # the import as it came
    assert sorted(r["id"] for df in written if "new" in df.columns for r in df.collect()) == [102, 103]
    written.clear()
    second = lines(spark, [(200, 2, 3, 500, "in"), (201, 2, 3, -9, "same")])
    assert told(C.commit_import(log, index, second, balances(spark, []), nobody)) == {2: (2, 0, 0, 1)}
    assert sorted(r["id"] for df in written if "new" in df.columns for r in df.collect()) == [100, 200]


def test_a_commit_does_not_shuffle_the_index(spark, books):
    _, index, _ = books
    index.add(lines(spark, [(i, i % 3, i % 70, i % 5, f"text {i % 4}") for i in range(300)]))
    rows = C.cut_lineage(lines(spark, [(1000, 1, 3, 3, "text 3")]), C.CODEC)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 32)  # more than there are buckets
    try:
        once = index.dealt(rows).groupBy(*C.LINE).agg(F.min("id").alias("id"))
        plan = once.join(index.around(rows)[0].select(*C.LINE), C.LINE, "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert "SortMergeJoin" in plan and plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan
