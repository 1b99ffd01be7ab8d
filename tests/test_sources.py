"""Sources, the sink and the streams on small files."""

import datetime as dt

from pyspark.sql import functions as F

from hearthbook.operators import reports
from hearthbook.sources import files, rules
from hearthbook.sources.sink import append_rows, read_ledger
from hearthbook.streaming.incremental import event_dedupe_stream, incremental_ingest, read_problems


def test_csv_rows_keep_their_place(spark, tmp_path):
    for name in ("a", "b"):
        lines = [f'{name}{i},"say ""hi"", {i}", x ' for i in range(500)]
        (tmp_path / f"{name}.csv").write_text("Date,Text,Pad\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits per file
    try:
        got = files.read_csv_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1000
    for r in got:
        name = r["file"].rsplit("/", 1)[-1][0]
        assert (r["Date"], r["Text"], r["Pad"]) == (f"{name}{r['row_index']}", f'say "hi", {r["row_index"]}', " x ")


def test_folder_scan_lists_what_it_skips(spark, tmp_path):
    (tmp_path / "2024" / "jan").mkdir(parents=True)
    (tmp_path / "2024" / "jan" / "one.PDF").write_text("x")
    (tmp_path / "notes.txt").write_text("yy")
    got = {(r["rel_path"], r["size_bytes"], r["status"]) for r in files.folder_scan(spark, str(tmp_path), [".pdf"]).collect()}
    assert got == {("2024/jan/one.PDF", 1, "kept"), ("notes.txt", 2, "skipped")}


def test_rules_file_names_what_is_wrong(spark, tmp_path):
    lines = [
        '{"merchant":"A","category":"Travel","source":"user"}',
        '{"merchant":"","category":"Travel","source":"user"}',
        '{"merchant":"B","source":"ai"}',
        '{"merchant":"C","category":"Travel","source":"me"}',
        "not json",
    ]
    (tmp_path / "rules.json").write_text("\n".join(lines))
    got = [r["problem"] for r in rules.read_rules(spark, str(tmp_path)).coalesce(1).collect()]
    assert got == [None, "rule without a merchant", "rule without a category", "unknown source", "not a rule"]


def test_sink_takes_a_row_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "account_id long, dedupe_hash string, date date, amount_cents long"
    first = [(1, "h1", dt.date(2024, 1, 5), 10), (1, "h2", dt.date(2024, 2, 5), 20), (2, "h1", dt.date(2024, 1, 5), 30)]
    append_rows(spark.createDataFrame(first, schema), path)
    append_rows(spark.createDataFrame(first + [(1, "h3", dt.date(2024, 1, 6), 40)], schema), path)
    got = sorted((r["account_id"], r["dedupe_hash"], r["amount_cents"], str(r["month"])[:7]) for r in read_ledger(spark, path).collect())
    assert got == [(1, "h1", 10, "2024-01"), (1, "h2", 20, "2024-02"), (1, "h3", 40, "2024-01"), (2, "h1", 30, "2024-01")]


def test_event_stream_over_two_runs(spark, tmp_path):
    feed, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "checkpoint"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, amount_cents long"
    start = dt.datetime(2024, 1, 1)

    def deliver(ids):
        rows = [(i, start + dt.timedelta(minutes=i), i % 3, "pay", i * 100) for i in ids]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        event_dedupe_stream(spark, feed, schema, out, checkpoint)

    deliver([1, 2, 2, 3])
    deliver([3, 4, 2, 5])  # redelivered in a later run
    deliver([4000, -20_000, 7])  # one is weeks older than all before, for the first time
    deliver([-20_001, -20_000, 4001])
    got = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert got == [-20_001, -20_000, 1, 2, 3, 4, 5, 7, 4000, 4001]


def test_sink_after_a_commit_without_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "account_id long, dedupe_hash string, date date, amount_cents long"
    append_rows(spark.createDataFrame([], schema), path)
    (tmp_path / "ledger").mkdir(exist_ok=True)  # what a failed commit leaves
    append_rows(spark.createDataFrame([(1, "h", dt.date(2024, 1, 5), 10)], schema), path)
    append_rows(spark.createDataFrame([(1, "h", dt.date(2024, 1, 5), 10)], schema), path)
    assert read_ledger(spark, path).count() == 1


def test_ingest_is_the_same_in_one_delivery_or_two(spark, tmp_path):
    mapping = spark.createDataFrame(
        [(1, "date|text|amount", "Date", "YYYY-MM-DD", ["Text"], "single_signed", "Amount", None, None, None)],
        "account_id long, signature string, date_column string, date_format string, description_columns array<string>, "
        "amount_style string, amount_column string, debit_column string, credit_column string, balance_column string",
    )

    def line(file, row, date="2024-01-02", amount="-5.00", signature="date|text|amount"):
        return (file, row, 1, signature, {"Date": date, "Text": "coffee", "Amount": amount})

    schema = "file_id long, row_index long, account_id long, signature string, record map<string,string>"
    first = [line(10, 0), line(10, 1), line(11, 0, signature="unheard|of"), line(12, 0, date="soon"), line(12, 1, amount="lots")]
    second = [line(20, 0), line(20, 1, date="2023-12-31"), line(21, 0, signature="unheard|of")]
    seen = []
    for deliveries in ([first + second], [first, second], [second, first]):
        root = tmp_path / str(len(seen))
        folder, ledger, checkpoint, problems = (str(root / n) for n in ("inbox", "ledger", "stream", "problems"))
        for i, rows in enumerate(deliveries):
            spark.createDataFrame(rows, schema).write.json(f"{folder}/{i}")
            incremental_ingest(spark, folder, mapping, ledger, checkpoint, problems)
        rows = sorted((str(r["date"]), r["amount_cents"]) for r in read_ledger(spark, ledger).collect())
        bad = sorted((r["file_id"], r["row_index"], r["problem"]) for r in read_problems(spark, problems).collect())
        seen.append((rows, bad))
    assert seen[0] == seen[1] == seen[2]
    # two equal lines of one file are genuine; the third, of an overlapping file, is not
    assert seen[0][0] == [("2023-12-31", -500), ("2024-01-02", -500), ("2024-01-02", -500)]
    assert [b[:2] for b in seen[0][1]] == [(11, 0), (12, 0), (12, 1), (21, 0)]


def test_rows_wait_for_their_mapping(spark, tmp_path):
    """Rows under an unknown header are read once it is mapped, their files not delivered again."""
    columns = "account_id long, signature string, date_column string, date_format string, description_columns array<string>, " \
        "amount_style string, amount_column string, debit_column string, credit_column string, balance_column string"
    known = (1, "date|text|amount", "Date", "YYYY-MM-DD", ["Text"], "single_signed", "Amount", None, None, None)
    later = (1, "tag|wort|betrag", "Tag", "YYYY-MM-DD", ["Wort"], "single_signed", "Betrag", None, None, None)
    new = lambda file, row, day="2024-01-02": (file, row, 1, "tag|wort|betrag", {"Tag": day, "Wort": "tee", "Betrag": "-3.00"})
    old = (10, 0, 1, "date|text|amount", {"Date": "2024-01-02", "Text": "coffee", "Amount": "-5.00"})
    folder, ledger, checkpoint, problems = (str(tmp_path / n) for n in ("inbox", "ledger", "stream", "problems"))
    schema = "file_id long, row_index long, account_id long, signature string, record map<string,string>"

    def state():
        rows = sorted((str(r["date"]), r["amount_cents"]) for r in read_ledger(spark, ledger).collect())
        return rows, sorted((r["file_id"], r["row_index"], r["problem"]) for r in read_problems(spark, problems).collect())

    first, both = (spark.createDataFrame(x, columns) for x in ([known], [known, later]))
    spark.createDataFrame([old, new(11, 0), new(11, 1), new(11, 2, "soon")], schema).write.json(f"{folder}/0")
    incremental_ingest(spark, folder, first, ledger, checkpoint, problems)
    assert state() == ([("2024-01-02", -500)], [(11, i, "unknown header") for i in (0, 1, 2)])
    spark.createDataFrame([new(12, 0, "2024-02-01")], schema).write.json(f"{folder}/1")
    for _ in range(2):  # the second run finds nothing to do
        incremental_ingest(spark, folder, both, ledger, checkpoint, problems)
        rows, bad = state()
        assert rows == [("2024-01-02", -500), ("2024-01-02", -300), ("2024-01-02", -300), ("2024-02-01", -300)]
        assert [b[:2] for b in bad] == [(11, 2)] and bad[0][2] != "unknown header"


def test_paths_within_a_folder(spark):
    cases = [
        ("hdfs://nn:8020/in/a/x.pdf", "hdfs://nn:8020/in"), ("hdfs://nn:8020/in/a/x.pdf", "/in/"),
        ("s3a://bkt/in/a/x.pdf", "s3a://bkt/in/"), ("file:/in/a/x.pdf", "/in"), ("file:///in/a/x.pdf", "file:/in"),
        ("s3a://bkt/a/x.pdf", "s3a://bkt"),
    ]
    for path, folder in cases:
        df = spark.createDataFrame([(path,)], "path string")
        assert df.select(files.relative_path(F.col("path"), folder)).first()[0] == "a/x.pdf", (path, folder)


def test_a_pivot_over_twenty_years_keeps_all_money(spark):
    from hearthbook.sources.tables import categories

    rows = [(i, 1, dt.date(2000 + i // 12, 1 + i % 12, 3), -100, 8) for i in range(240)]
    txns = spark.createDataFrame(rows, "id long, account_id long, date date, amount_cents long, category_id long")
    splits = spark.createDataFrame([], "transaction_id long, category_id long, amount_cents long")
    got = reports.month_pivot_dense(txns, splits, categories(spark), "2000-01-01", "2019-12-31").collect()
    assert len(got) == 240 and sum(r["living"] for r in got) == 24_000


def test_month_pivot_against_effective_lines(spark):
    day = dt.date(2024, 3, 3)
    rows = [(1, 1, day, -100, 8), (2, 1, day, -50, None), (3, 1, day, 70, 17), (4, 1, day, -30, 12), (5, 1, day, 20, None)]
    txns = spark.createDataFrame(rows, "id long, account_id long, date date, amount_cents long, category_id long")
    splits = spark.createDataFrame([(1, 1, -60), (1, None, -40), (4, 21, -10), (4, 21, -20)], "transaction_id long, category_id long, amount_cents long")
    from hearthbook.sources.tables import categories

    got = reports.month_pivot_dense(txns, splits, categories(spark), "2024-02-01", "2024-04-30").collect()
    by_month = {r["month"]: r.asDict() for r in got}
    assert sorted(by_month) == ["2024-02", "2024-03", "2024-04"]
    assert by_month["2024-03"] == {
        "month": "2024-03", "base": 60, "living": 0, "luxury": 0, "uncategorized": 90, "income": 70,
    }
    classes = reports.spend_by_month_class(txns, splits, categories(spark), "2024-01-01", "2024-12-31")
    # the luxury and living rows were split away, so their groups are gone
    assert {(r["spending_class"], r["total_cents"]) for r in classes.collect()} == {("base", -60), (None, -90)}
    assert reports.effective_lines(txns, splits).agg(F.sum("amount_cents")).first()[0] == -90
