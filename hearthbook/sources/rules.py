"""Categorization rules as JSON files, one rule per line."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "merchant string, category string, spending_class string, source string, use_count long, _broken string"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share. Only a local session that
    names none uses a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get(
        "spark.checkpoint.dir", ""
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="hearthbook-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("error").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file with what is wrong with each line, if anything."""
    raw = spark.read.schema(RULE_SCHEMA).option("columnNameOfCorruptRecord", "_broken").json(path)
    problem = (
        F.when(F.col("_broken").isNotNull(), F.lit("not a rule"))
        .when(F.coalesce("merchant", F.lit("")) == "", F.lit("rule without a merchant"))
        .when(F.coalesce("category", F.lit("")) == "", F.lit("rule without a category"))
        .when(~F.coalesce(F.col("source").isin("user", "ai"), F.lit(False)), F.lit("unknown source"))
    )
    return raw.withColumn("problem", problem)
