"""The stored index of a ledger: what an import has to be held against.

Two small tables beside the ledger, kept up by each commit: the hash of every line, and
the least row of every (account, day, amount). Both are partitioned by month and
bucketed by exactly the columns that imports join on, so an import reads only the months
it touches and never ranks, hashes or shuffles the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_of

LINE = ["account_id", "dedupe_hash"]
DAY = ["account_id", "date", "amount_cents"]
KINDS = {"account_id": "BIGINT", "dedupe_hash": "STRING", "date": "DATE", "amount_cents": "BIGINT"}

#: Hashes in hexadecimal take half the room in files that code by frequency.
CODEC = "zstd"


def packed(rows: DataFrame) -> DataFrame:
    """``dedupe_hash`` as bytes, for a shuffle; what is not plain hexadecimal as it is."""
    line, raw = F.col("dedupe_hash"), F.unhex("dedupe_hash")
    plain = F.lower(F.hex(raw)).eqNullSafe(line)
    return rows.select(*[c for c in rows.columns if c != "dedupe_hash"], F.when(plain, raw).alias("_raw"), F.when(~plain, line).alias("_odd"))


def _line() -> Column:
    return F.coalesce(F.lower(F.hex("_raw")), F.col("_odd"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in ("_raw", "_odd")], _line().alias("dedupe_hash"))


class DedupeIndex:
    """``name`` names the tables in the catalog, ``path`` is where they lie; a session
    that does not know them yet finds what is there. ``buckets`` is fixed with the first
    commit: about one per 100 MB of a month's index."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 8):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        for kind, keys in (("lines", LINE), ("days", DAY)):
            table = f"{name}_{kind}"
            if not spark.catalog.tableExists(table):
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
                columns = ", ".join(f"{k} {KINDS[k]}" for k in keys)
                spark.sql(
                    f"CREATE TABLE {table} ({columns}, id BIGINT, month STRING) USING parquet OPTIONS (compression '{CODEC}') PARTITIONED BY (month)"
                    f" CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}/{kind}'"
                )
                spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` partitioned as the lines are bucketed, so that a join with them moves
        neither side once more."""
        return unpacked(packed(rows).repartition(self.buckets, F.col("account_id"), _line()))

    def add(self, rows: DataFrame) -> None:
        """Enter ledger rows (id, account_id, date, amount_cents, dedupe_hash). To enter
        rows once more changes no answer. One task writes one bucket."""
        rows = rows.withColumn("month", month_of(F.col("date")))
        for kind, keys in (("lines", LINE), ("days", DAY)):
            # hashes hardly repeat: they travel once, to their bucket, and are grouped there;
            # rows of a hot day and amount are grouped before they travel
            once = kind == "lines"
            dealt = self.dealt(rows.select(*keys, "id", "month")) if once else rows
            least = dealt.groupBy(*keys, "month").agg(F.min("id").alias("id")).select(*keys, "id", "month")
            least = (least if once else least.repartition(self.buckets, *keys)).sortWithinPartitions("month", *keys)
            least.write.mode("append").insertInto(f"{self.name}_{kind}")

    def _months(self, rows: DataFrame) -> list[str]:
        # one name per calendar month of the import
        return [r["m"] for r in rows.select(month_of(F.col("date")).alias("m")).distinct().collect()]

    def around(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(lines, days) of the months that ``rows`` have a date in: account_id,
        dedupe_hash, id and account_id, date, amount_cents, id. The hash covers the
        date, so no other month can matter."""
        months = self._months(rows)
        lines, days = (self.spark.table(f"{self.name}_{k}").where(F.col("month").isin(months)).drop("month") for k in ("lines", "days"))
        return lines, days
