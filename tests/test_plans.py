"""The physical plans are the ones we want at scale."""

from __future__ import annotations

import re

import pytest
from paths import SF_DIR

from txrisk.datasets import scored, transactions
from txrisk.operators import evaluation, explore, prep, sequence
from txrisk.plans import pipeline
from txrisk.plans.registry import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_needs_one_exchange_and_one_sort(spark):
    plan = plan_of(sequence.account_history(transactions(spark, SF_DIR)))
    assert plan.count("Exchange hashpartitioning(sender_account") == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1
    assert len(re.findall(r"\bWindow \[", plan)) == 1


def test_scan_reads_only_needed_columns(spark):
    report = pipeline.risk_by_category(pipeline.engineer_features(transactions(spark, SF_DIR)))
    assert "ReadSchema: struct<event_id:bigint" in plan_of(report)
    hist = plan_of(evaluation.threshold_sweep(scored(spark, SF_DIR), "probability", "label"))
    assert "ReadSchema: struct<event_type:string,value:double>" in hist


def test_filters_reach_the_scan(spark):
    plan = plan_of(explore.value_counts(transactions(spark, SF_DIR).filter("amount > 50"), "merchant_category"))
    assert "GreaterThan(value,50.0)" in plan


def test_split_moves_no_rows(spark):
    df = prep.split_stratified(transactions(spark, SF_DIR), "is_fraud", "transaction_id")
    assert "Exchange" not in plan_of(df)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_query_has_a_cross_join(spark, name):
    if QUERIES[name].sql is None:
        pytest.skip("trains a model: its result is a small projection")
    plan = plan_of(QUERIES[name].run(spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
