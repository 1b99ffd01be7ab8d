"""Name -> query and name -> comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from ..sources.tables import Ledger
from .views_sql import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """Made anew for every query: what a query writes out on its way is shared within it,
    and the next one reads the tables as they are then."""
    return Ledger(tune(spark), sf_dir)


def as_text_dates(df: DataFrame) -> DataFrame:
    """ISO text is how a ledger shows dates; used at the outer edge only."""
    return df.select(
        *[
            F.col(name).cast("string").alias(name) if kind == "date" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None):
    """Register ``fn(ledger) -> DataFrame``. ``sql`` either begins with SELECT or
    goes on the list of views with a comma and more CTEs."""

    def add(fn: Callable[[Ledger], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_text_dates(fn(ledger(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = VIEWS + "\n" + sql.strip()
        return fn

    return add
