"""A folder that grows: each run takes the files that are new since the last."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import map_records, mapped_rows
from ..operators.staging import with_dedupe_key
from ..session import cut_lineage
from ..sources.sink import append_rows

UPLOAD_SCHEMA = "file_id long, row_index long, account_id long, signature string, record map<string,string>"


HEADER_SCHEMA = "account_id long, signature string"
PROBLEM_SCHEMA = "account_id long, file_id long, row_index long, signature string, problem string"


def read_uploads(uploads: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, problems) of upload rows.

    A line's occurrence is counted within its file, so what two files share is the
    same however they are delivered. A row whose header nobody has mapped, or that
    cannot be read, is a problem; blank lines are neither."""
    once = uploads.dropDuplicates(["account_id", "file_id", "row_index"])
    known = mappings.select("account_id", "signature").distinct()
    unknown = once.join(known, ["account_id", "signature"], "left_anti").select(
        "account_id", "file_id", "row_index", "signature", F.lit("unknown header").alias("problem")
    )
    own = ["account_id", "signature"]
    # written out: ranking samples its rows before it sorts them, problems are read beside
    read = cut_lineage(map_records(once.join(mappings, own), carry=own))
    rows = with_dedupe_key(mapped_rows(read, own), ["account_id", "file_id"], "row_index").select(
        "account_id", "date", "amount_cents", "description", "dedupe_hash"
    )
    bad = read.where("outcome = 'error'").select("account_id", "file_id", "row_index", "signature", "problem")
    return rows, unknown.unionByName(bad)


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def release(spark: SparkSession, mappings: DataFrame, ledger_path: str, problem_path: str) -> None:
    """Read the rows that waited for a header mapped since. The sink's key makes a
    repeated release harmless; that it happened is noted last."""
    columns = ["file_id", "row_index", "account_id", "signature", "record"]
    waiting = _there(spark, f"{problem_path}-waiting", UPLOAD_SCHEMA).select(*columns)
    done = _there(spark, f"{problem_path}-released", HEADER_SCHEMA)
    header = ["account_id", "signature"]
    fresh = waiting.select(*header).distinct().join(mappings.select(*header).distinct(), header).join(done, header, "left_anti")
    fresh = cut_lineage(fresh)
    if fresh.isEmpty():
        return
    rows, problems = read_uploads(waiting.join(fresh, header, "left_semi"), mappings)
    problems.write.mode("overwrite").parquet(f"{problem_path}/batch=released-{uuid.uuid4().hex}")
    append_rows(rows, ledger_path)
    fresh.write.mode("append").parquet(f"{problem_path}-released")


def incremental_ingest(
    spark: SparkSession, folder: str, mappings: DataFrame, ledger_path: str, checkpoint: str, problem_path: str
) -> None:
    """Run until all files now in ``folder`` are in the ledger or, row by row, among
    the problems. The checkpoint remembers files; the sink's key makes redelivered
    rows harmless, and problems of a batch replace those of its earlier attempt, so a
    batch that is repeated after a lost executor adds nothing twice. Rows under a
    header that nobody has mapped are kept as they came; the first run after the
    mapping was saved reads them."""
    mappings = mappings.dropDuplicates(["account_id", "signature"])
    release(spark, mappings, ledger_path, problem_path)
    feed = spark.readStream.schema(UPLOAD_SCHEMA).option("recursiveFileLookup", "true").json(folder)

    def land(batch: DataFrame, number: int) -> None:
        batch = cut_lineage(batch)  # the files are parsed once, whatever is asked of them
        rows, problems = read_uploads(batch, mappings)
        problems.write.mode("overwrite").parquet(f"{problem_path}/batch={number}")
        unknown = batch.join(mappings.select("account_id", "signature"), ["account_id", "signature"], "left_anti")
        unknown.select(*batch.columns).write.mode("overwrite").parquet(f"{problem_path}-waiting/batch={number}")
        append_rows(rows, ledger_path)

    run = (
        feed.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def read_problems(spark: SparkSession, problem_path: str) -> DataFrame:
    """Rows that wait for somebody, each once; a header mapped since is no problem."""
    columns = [c.split()[0] for c in PROBLEM_SCHEMA.split(", ")]  # not the batch's number
    rows = spark.read.schema(PROBLEM_SCHEMA).parquet(problem_path).select(*columns).distinct()
    done = _there(spark, f"{problem_path}-released", HEADER_SCHEMA).withColumn("problem", F.lit("unknown header"))
    return rows.join(done, ["account_id", "signature", "problem"], "left_anti").select(*columns)


def event_dedupe_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Each event once, however late it or its redelivery comes: no watermark, as that
    would drop events that come late for the first time. The state holds every
    event_id; `session.tune` keeps it in RocksDB, on disk and not on the heap."""
    feed = spark.readStream.schema(schema).parquet(folder)
    once = feed.dropDuplicates(["event_id"])
    run = (
        once.select("event_id", "user_id", "event_type", F.col("amount_cents"))
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
