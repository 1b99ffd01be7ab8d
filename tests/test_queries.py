"""A few registered queries of each kind beside their SQL, on the smallest data.
`python tests/compare.py` does the same for all of them at any size."""

import pytest
from compare import compare, duck

import hearthbook.plans as plans
from __spark_entry__ import entry, oracle_sql, queries
from hearthbook.plans import registry

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "month_pivot_dense",
    "account_balances",
    "cleared_state",
    "apply_csv_mapping",
    "neighbor_rows",
    "cross_file_supersede",
    "transfer_candidates",
    "statement_match",
    "categorize_layers",
    "match_orders",
    "event_dedupe_stream",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_ledger_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE)
    assert set(plans.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    out = entry(spark)
    assert out.columns[0] == "month" and out.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["transfer_candidates", "statement_match", "match_orders_exact", "auto_link_transfers"])
def test_no_pairwise_joins(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_shop_orders_are_written_once(spark):
    """Orders and charges are read by every step of the matcher; line items must not be
    added up for each."""
    led = registry.ledger(spark, SF_DIR)
    for df in (led.shop_orders, led.charges):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan


def test_held_base_is_read_as_written(spark):
    led = registry.ledger(spark, SF_DIR)
    led.hold_base()
    for df in (led.transactions, led.staged):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_share_nothing_written(spark):
    first = registry.ledger(spark, SF_DIR)
    first.order_matches = "of tables as they were"
    assert "order_matches" not in registry.ledger(spark, SF_DIR).__dict__
