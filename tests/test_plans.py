"""Physical plans: no pairing of rows without a key, pruned scans, few shuffles."""

from __future__ import annotations

import re

import pytest

from ledgerweave.catalog.queries import BUILDERS
from ledgerweave.operators import features

LAZY = (
    "account_features",
    "bank_view_tx",
    "tx_mix",
    "bank_overview",
    "bank_sar",
    "integrity_checks",
    "daily_activity",
    "burst_features",
    "dedupe_tx",
    "split_assign",
    "split_by_cuts",
    "numeric_stats",
    "global_vocab",
    "standardize",
    "one_hot",
    "encode_long",
    "local_encode",
    "predict_scores",
    "val_metrics",
    "test_report",
    "compare_models",
    "masked_metrics",
    "secure_metric_mean",
    "early_stopping",
    "gd_round",
    "fedavg",
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_without_a_key(inputs, name):
    plan = plan_of(BUILDERS[name](inputs))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


def test_features_shuffle_the_ledger_three_times(spark, inputs):
    """De-duplication, facets, fold; the join finds the fold's partitioning in place."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        profile = plan_of(features._profile(inputs.ledger))
        sources = profile.count("Exchange hashpartitioning(l_orderkey") + profile.count(
            "Exchange hashpartitioning(o_orderkey"
        )
        assert profile.count("Exchange hashpartitioning") - sources == 3
        whole = plan_of(features.account_features(inputs.accounts, inputs.ledger, inputs.sar))
        assert re.search(
            r"Sort \[acct_id[^\n]*\n[^\n]*HashAggregate\(keys=\[acct_id#\d+L\], functions=\[sum", whole
        )
        assert "Expand" not in whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scans_read_only_what_is_used(inputs):
    plan = plan_of(BUILDERS["in_features"](inputs))
    # Whole-row de-duplication needs every ledger column, but nothing else of the line.
    assert "l_extendedprice" in plan and "l_tax" not in plan and "l_comment" not in plan
    accounts = plan_of(BUILDERS["bank_accounts"](inputs))
    assert "PushedFilters" in accounts and "o_orderkey" not in accounts


def test_aggregations_combine_before_the_shuffle(inputs):
    for name in ("numeric_stats", "tx_mix", "gd_round", "val_metrics"):
        assert "partial_sum" in plan_of(BUILDERS[name](inputs)), name
