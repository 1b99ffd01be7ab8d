"""A ledger of several tables with atomic commits.

A commit writes its rows, balances and links to folders nobody reads yet and then
publishes one manifest under the next version number. Publishing succeeds only if no one
else has taken that number, so readers see all of a commit or nothing, and of two writers
that started from the same version the second must look again. What a writer left behind
before publishing is never read."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_of
from ..operators.transfers import auto_link
from ..session import cut_lineage
from .index import CODEC, DedupeIndex, LINE, packed, unpacked

ROWS = "id bigint, account_id bigint, date date, amount_cents bigint, description string, merchant string, category_id bigint, dedupe_hash string, batch_id bigint"
BALANCES = "account_id bigint, date date, balance_cents bigint, source string, batch_id bigint"
LINKS = "out_id bigint, in_id bigint, amount_cents bigint"
SCHEMAS = {"rows": ROWS, "balances": BALANCES, "links": LINKS}


class Conflict(Exception):
    """Another commit took the version."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._at(f"{self.path}/log"))

    def manifests(self) -> list[dict]:
        """What has been published, one small entry per commit, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/log"))]
        names = sorted(n for n in names if n.endswith(".json") and not n.startswith((".", "_")))
        if not names:
            return []
        schema = "version long, commit string, stats map<string,long>, replaces array<string>"
        read = self.spark.read.schema(schema).json([f"{self.path}/log/{n}" for n in names])
        return [r.asDict() for r in read.orderBy("version").collect()]

    def version(self) -> int:
        found = self.manifests()
        return found[-1]["version"] if found else 0

    def commits(self, upto: int | None = None) -> list[str]:
        """The commits whose folders make up the ledger at a version."""
        out: list[str] = []
        for m in self.manifests():
            if upto is None or m["version"] <= upto:
                out = [c for c in out if c not in (m["replaces"] or [])] + [m["commit"]]
        return out

    def read(self, table: str, upto: int | None = None, commits: list[str] | None = None) -> DataFrame:
        """A table at a version (the latest): its columns, ``commit`` and, for rows,
        ``month``, both pruned by folder."""
        part = ", month string" if table == "rows" else ""
        schema = f"{SCHEMAS[table]}, commit string{part}"
        known = self.commits(upto) if commits is None else commits
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}").where(F.col("commit").isin(known))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def balances(self, upto: int | None = None) -> DataFrame:
        """One balance per account and day, that of the latest commit."""
        order = {c: i for i, c in enumerate(self.commits(upto))}
        rows = self.read("balances", upto)
        number = self.spark.createDataFrame(list(order.items()), "commit string, seq long")
        last = F.max_by(F.struct("balance_cents", "source"), F.struct("seq", "balance_cents")).alias("b")
        return rows.join(F.broadcast(number), "commit").groupBy("account_id", "date").agg(last).select("account_id", "date", "b.*")

    def stage(self, tables: dict[str, DataFrame], commit: str | None = None) -> str:
        """Write a commit's folders, which stay invisible; its name. With ``commit``, more
        tables of it."""
        commit = commit or uuid.uuid4().hex
        for table, df in tables.items():
            columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
            out, at = df.select(*columns), f"{self.path}/{table}/commit={commit}"
            if table == "rows":
                # rebalancing by month splits a hot month over many tasks and packs quiet ones
                out = unpacked(packed(out).withColumn("month", month_of(F.col("date"))).hint("rebalance", F.col("month")))
                out.select(*columns, "month").sortWithinPartitions("month", "account_id", "date").write.partitionBy("month").parquet(at, compression=CODEC)
            else:
                out.write.parquet(at, compression=CODEC)
        return commit

    def publish(self, commit: str, expected: int, stats: dict[str, int] | None = None, replaces: list[str] | None = None) -> int:
        """Make a staged commit version ``expected + 1``, or raise Conflict."""
        version = expected + 1
        text = json.dumps({"version": version, "commit": commit, "stats": stats or {}, "replaces": replaces or []})
        draft, final = f"{self.path}/log/_{commit}", f"{self.path}/log/{version:020d}.json"
        out = self._fs.create(self._at(draft))
        out.write(bytearray(text.encode()))
        out.close()
        qualified = self._fs.makeQualified(self._at(final)).toString()
        try:
            if qualified.startswith("file:"):
                # a local rename would overwrite; a link is made once
                os.link(*(unquote(urlparse(self._fs.makeQualified(self._at(p)).toString()).path) for p in (draft, final)))
            else:
                jvm = self.spark.sparkContext._jvm
                files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self._conf)
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                files.rename(self._at(draft), self._at(final), none)
        except FileExistsError as taken:
            raise Conflict(f"version {version}") from taken
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" in str(failed.java_exception):
                raise Conflict(f"version {version}") from failed
            raise
        finally:
            self._fs.delete(self._at(draft), False)
        return version

    def compact(self) -> int:
        """Rewrite everything published into one commit, so that folders do not grow
        without end. Readers of an earlier version keep theirs."""
        expected, known = self.version(), self.commits()
        tables = {"rows": self.read("rows", commits=known), "links": self.read("links", commits=known)}
        last = self.read("balances", commits=known).groupBy("account_id", "date").agg(F.max("batch_id").alias("batch_id"))
        tables["balances"] = self.balances(expected).join(last, ["account_id", "date"])
        return self.publish(self.stage(tables), expected, replaces=known)


def catch_up(log: CommitLog, index: DedupeIndex) -> None:
    """Enter commits the index has not seen. A writer that ended between publishing and
    this leaves it to the next one; entering a commit twice does no harm."""
    marks = log._at(f"{index.path}/seen")
    log._fs.mkdirs(marks)
    seen = {s.getPath().getName() for s in log._fs.listStatus(marks)}
    for m in log.manifests():
        if m["commit"] not in seen:
            if not m["replaces"]:
                index.add(log.read("rows", commits=[m["commit"]]))
            log._fs.create(log._at(f"{index.path}/seen/{m['commit']}")).close()


def commit_import(
    log: CommitLog, index: DedupeIndex, rows: DataFrame, balances: DataFrame, rejections: DataFrame,
    window: int = 3, tries: int = 5, before_publish: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Add included rows (`ROWS`), balances (`BALANCES`) and the links they make, all or
    nothing. Returns per file (batch_id): inserted, skipped, balances_recorded,
    transfers_linked.

    Rows whose line the ledger has are skipped. A balance is recorded if it is new or
    replaces another. A link is the only candidate of both its legs, one of them new,
    among the rows of the import's months and the days around them, linked ones left
    out. If another commit comes first all of this is decided again."""
    rows = cut_lineage(rows, CODEC)
    for _ in range(tries):
        catch_up(log, index)
        version = log.version()
        lines, _days = index.around(rows)
        new = index.dealt(rows).groupBy(*LINE).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in LINE]), "id").alias("r"))
        commit = log.stage({"rows": new.select(*LINE, "r.*").join(lines.select(*LINE), LINE, "left_anti")})
        # read where they were staged, which nobody else does
        fresh = log.read("rows", commits=[commit])
        held = log.balances(version).select("account_id", "date", F.col("balance_cents").alias("held"))
        last = balances.groupBy("account_id", "date").agg(F.max_by(F.struct("balance_cents", "source", "batch_id"), F.struct("batch_id", "balance_cents")).alias("b"))
        recorded = last.select("account_id", "date", "b.*").join(held, ["account_id", "date"], "left")
        recorded = cut_lineage(recorded.where("held is null or held != balance_cents").drop("held"), CODEC)
        linked = cut_lineage(new_links(log, fresh, rejections, version, window), CODEC)
        log.stage({"balances": recorded, "links": linked}, commit)
        before_publish()
        try:
            log.publish(commit, version)
        except Conflict:
            continue
        catch_up(log, index)
        return import_stats(rows, fresh, recorded, linked)
    raise Conflict(f"{tries} commits came first")


def new_links(log: CommitLog, fresh: DataFrame, rejections: DataFrame, version: int, window: int) -> DataFrame:
    """Links that the new rows make, among the months in reach of their dates."""
    # a partner's other candidates lie up to twice the window away
    ends = [F.date_sub("date", 2 * window), F.col("date"), F.date_add("date", 2 * window)]
    reach = fresh.select(F.explode(F.array(*ends)).alias("date"))
    months = [r["m"] for r in reach.select(month_of(F.col("date")).alias("m")).distinct().collect()]
    ends = log.read("links", version).select(F.explode(F.array("out_id", "in_id")).alias("id"))
    columns = ["id", "account_id", "date", "amount_cents"]
    old = log.read("rows", version).where(F.col("month").isin(months)).select(*columns).join(ends, "id", "left_anti")
    books = old.withColumn("new", F.lit(False)).unionByName(fresh.select(*columns, F.lit(True).alias("new")))
    # candidates have one amount, so only amounts that move both ways and are new somewhere matter
    size = F.abs("amount_cents")
    sides = [F.max(c) for c in (F.col("new"), F.col("amount_cents") > 0, F.col("amount_cents") < 0)]
    live = books.groupBy(size.alias("size")).agg((sides[0] & sides[1] & sides[2]).alias("live")).where("live").select("size")
    books = books.withColumn("size", size).join(live, "size", "left_semi").drop("size")
    books = cut_lineage(books.withColumn("transfer_peer_id", F.lit(None).cast("long")).withColumn("transfer_account_id", F.lit(None).cast("long")), CODEC)
    pairs = cut_lineage(auto_link(books, rejections, window), CODEC)
    new = books.where("new").select("id")
    touched = pairs.join(new.withColumnRenamed("id", "out_id"), "out_id", "left_semi").unionByName(pairs.join(new.withColumnRenamed("id", "in_id"), "in_id", "left_semi"))
    return touched.select("out_id", "in_id", "amount_cents").distinct()


def import_stats(rows: DataFrame, fresh: DataFrame, recorded: DataFrame, linked: DataFrame) -> DataFrame:
    """Per file; a link counts for the file of each new leg."""
    legs = linked.select(F.explode(F.array("out_id", "in_id")).alias("id"))
    made = fresh.select("id", "batch_id").join(legs, "id").groupBy("batch_id").agg(F.count("*").alias("transfers_linked"))
    added = fresh.groupBy("batch_id").agg(F.count("*").alias("inserted"))
    noted = recorded.groupBy("batch_id").agg(F.count("*").alias("balances_recorded"))
    every = rows.groupBy("batch_id").agg(F.count("*").alias("n"))
    out = every.join(added, "batch_id", "full").join(noted, "batch_id", "full").join(made, "batch_id", "full")
    zero = F.lit(0).cast("long")
    return out.select(
        "batch_id", F.coalesce("inserted", zero).alias("inserted"), (F.coalesce("n", zero) - F.coalesce("inserted", zero)).alias("skipped"),
        *[F.coalesce(c, zero).alias(c) for c in ("balances_recorded", "transfers_linked")],
    )
