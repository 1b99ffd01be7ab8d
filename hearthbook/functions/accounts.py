"""Rules that follow from an account's type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ACCOUNT_KINDS, LIABILITY_TYPES


def is_liability(account_type: Column) -> Column:
    return account_type.isin(LIABILITY_TYPES)


def default_account_kind(account_type: Column) -> Column:
    by_balance = account_type.isin("investment", "retirement", "mortgage", "loan")
    return F.when(by_balance, F.lit("balance")).otherwise(F.lit("transaction"))


def resolve_account_kind(account_type: Column, requested: Column) -> Column:
    """Debts may be kept either way, so there the request counts."""
    may_choose = account_type.isin("mortgage", "loan", "line_of_credit")
    asked = F.coalesce(requested.isin(ACCOUNT_KINDS), F.lit(False))
    return F.when(may_choose & asked, requested).otherwise(default_account_kind(account_type))


def payment_category(account_type: Column) -> Column:
    return F.when(account_type == "credit_card", F.lit("Credit Card Payment")).when(
        is_liability(account_type), F.lit("Loan Payment")
    )


def account_label(institution: Column, name: Column, last_four: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    head = F.concat_ws(" · ", filled(institution), filled(name))
    return F.concat(head, F.coalesce(F.concat(F.lit(" ··"), filled(last_four)), F.lit("")))
