"""The registered queries and the SQL they are compared with."""

from . import (  # noqa: F401
    balances,
    categorize,
    ingest,
    orders,
    register,
    reports,
    sources,
    staging,
    statements,
    transfers,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
