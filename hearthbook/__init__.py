"""Household-ledger analytics as composable Spark DataFrame operators."""
