"""Hand-made edge tables for cleaning, views and features."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions.coerce import as_id, as_number, as_utc
from ledgerweave.operators import features, ledger
from ledgerweave.sources import testdata
from ledgerweave.sources.durable import durable


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_ids(spark):
    texts = ["7", " 8 ", "9.0", "x", "1.5", "", None, "-3", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(as_id(df, "v")).collect()]
    assert got == [7, 8, 9, None, None, None, None, -3, None]


def test_numbers(spark):
    texts = ["12.5", " 3 ", "1e3", "NaN", "abc", "", None, "1.5d", "-inf"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(as_number(df, "v")).collect()]
    assert got == [12.5, 3.0, 1000.0, None, None, None, None, None, float("-inf")]
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(as_number(df, "v")).collect()] == [None, 2.0, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_timestamps_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2020-01-01", "2020-01-01 10:00:00", "2020-01-01T23:30:00-05:00", "x", None]
        df = spark.createDataFrame([(t,) for t in texts], "v string")
        got = [r[0] for r in df.select(as_utc(df, "v").alias("t")).collect()]
        assert got == [
            dt.datetime(2020, 1, 1),
            dt.datetime(2020, 1, 1, 10),
            dt.datetime(2020, 1, 2, 4, 30),
            None,
            None,
        ]
        instant = df.select(F.timestamp_seconds(F.lit(86_399)).alias("v"))
        assert instant.select(as_utc(instant, "v")).first()[0] == dt.datetime(1970, 1, 1, 23, 59, 59)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def accounts(spark):
    rows = [(1, 10.0, "CA", "a"), (2, 20.0, "NY", "a"), (3, None, None, "b"), (None, 1.0, "TX", "b")]
    return spark.createDataFrame(
        rows, "acct_id bigint, initial_deposit double, state string, bank_id string"
    )


@pytest.fixture
def transfers(spark):
    day = dt.datetime(2024, 5, 1, 9)
    rows = [
        (1, day, 1, 2, Decimal("5.00")),
        (2, day.replace(hour=23), 1, 3, Decimal("7.00")),
        (3, day.replace(day=2), 1, 3, Decimal("1.00")),
        (4, day, None, 2, Decimal("2.00")),
        (5, day, 1, None, Decimal("3.00")),
        (6, None, 1, 2, Decimal("4.00")),
        (7, day, 2, 2, None),
        (8, day, 2, 9, Decimal("6.00")),
        (9, day, 8, 9, Decimal("6.00")),
    ]
    return spark.createDataFrame(
        rows,
        "tran_id bigint, tran_timestamp timestamp_ntz, orig_acct bigint, bene_acct bigint, "
        "base_amt decimal(18,2)",
    )


@pytest.fixture
def sar(spark):
    rows = [(1, "YES"), (1, "YES"), (2, "yes"), (3, "NO"), (None, "YES"), (77, "YES")]
    return spark.createDataFrame(rows, "acct_id bigint, is_sar_text string")


def test_label_is_exact_and_never_null(accounts, sar):
    got = dict(values(ledger.label_accounts(accounts, sar), "acct_id", "is_sar"))
    assert got == {1: True, 2: False, 3: False, None: False}


def test_views_hold_every_touching_transfer_once(accounts, transfers):
    got = sorted(values(ledger.bank_views(transfers, accounts), "bank_id", "tran_id", "internal"))
    assert got == [
        ("a", 1, True),
        ("a", 2, False),
        ("a", 3, False),
        ("a", 4, False),
        ("a", 5, False),
        ("a", 6, True),
        ("a", 7, True),
        ("a", 8, False),
        ("b", 2, False),
        ("b", 3, False),
    ]
    mix = {r["bank_id"]: r for r in ledger.transfer_mix(transfers, accounts).collect()}
    assert (mix["a"]["tx_total"], mix["a"]["tx_internal"], mix["a"]["tx_cross"]) == (8, 3, 5)
    assert (mix["b"]["tx_total"], mix["b"]["tx_internal"]) == (2, 0)


def test_an_account_in_two_banks_counts_once_per_bank(spark, transfers):
    twice = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "a")], "acct_id bigint, bank_id string"
    )
    one = transfers.where("tran_id = 1")
    got = sorted(values(ledger.bank_views(one, twice), "bank_id", "internal"))
    assert got == [("a", True), ("b", False)]


def test_features(accounts, transfers, sar):
    rows = {r["acct_id"]: r.asDict() for r in features.account_features(accounts, transfers, sar).collect()}
    first = rows[1]
    # Six outgoing rows: the one without receiver counts, but is no counterparty; the
    # undated one counts, but belongs to no day.
    assert (first["out_cnt"], first["out_sum"], first["out_nuniq_bene"]) == (5, 20.0, 2)
    assert (first["out_max_daily_cnt"], first["out_max_daily_sum"]) == (3, 15.0)
    assert (first["in_cnt"], first["net_flow"]) == (0, -20.0)
    second = rows[2]
    assert (second["in_cnt"], second["in_sum"], second["in_nuniq_orig"]) == (4, 11.0, 2)
    assert (second["out_cnt"], second["out_sum"], second["out_nuniq_bene"]) == (2, 6.0, 2)
    assert second["in_max_daily_cnt"] == 3 and second["in_max_daily_sum"] == 7.0
    silent = rows[None]
    assert silent["out_cnt"] == 0 and silent["in_sum"] == 0.0 and silent["net_flow"] == 0.0
    assert set(rows) == {1, 2, 3, None}


def test_features_equal_those_of_each_bank_view(inputs):
    """Aggregating the whole ledger gives what building every view first would."""
    whole = inputs.features
    views = ledger.bank_views(inputs.ledger, inputs.accounts).drop("internal")
    for bank in ("bank_l", "bank_m", "bank_s"):
        own = ledger.bank_accounts(inputs.accounts, bank)
        view = views.where(F.col("bank_id") == bank).drop("bank_id")
        alone = features.account_features(own, view, inputs.sar)
        assert alone.exceptAll(whole.where(F.col("bank_id") == bank)).isEmpty()
        assert alone.count() == own.count()


def test_a_task_counts_an_even_share_of_the_ledger(spark):
    """AQE merges small partitions by their bytes; those whose facets are counted stay apart."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    raw = spark.range(8000).select(
        F.col("id").alias("tran_id"),
        (F.col("id") % 3).alias("orig_acct"),
        F.lit(7).alias("bene_acct"),
        F.lit(1).cast("decimal(18,2)").alias("base_amt"),
        at.alias("tran_timestamp"),
    )
    cleaned = ledger.clean_transactions(raw.union(raw))
    profile = features._profile(cleaned)
    got = {r["acct_id"]: (r["out_cnt"], r["in_cnt"], r["in_nuniq_orig"]) for r in profile.collect()}
    assert got == {0: (2667, None, 0), 1: (2667, None, 0), 2: (2666, None, 0), 7: (None, 8000, 3)}
    assert "REPARTITION_BY_NUM" in profile._jdf.queryExecution().executedPlan().toString()
    shares = [r["count"] for r in features._spread(cleaned).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == parts and max(shares) < 2 * 8000 / parts


def test_the_rows_of_a_ledger_set_the_number_of_its_tasks(spark, monkeypatch):
    """Copies, facets and fold: each in as many tasks as the rows need, with whole results."""
    monkeypatch.setattr(ledger, "TASK_ROWS", 100)
    raw = spark.range(3000).select(
        F.col("id").alias("tran_id"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 50).alias("orig_acct"),
        F.lit(7).cast("bigint").alias("bene_acct"),
        F.lit(1).cast("decimal(18,2)").alias("base_amt"),
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("tran_timestamp"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ledger.task_count(spark) == ledger.task_count(spark, 100) == parts
    cleaned = ledger.clean_transactions(raw.union(raw), 6000)
    assert ledger.dealt_parts(cleaned) == 60 > parts
    assert ledger.dealt_parts(cleaned.where("tran_id > 0")) is None
    profile = features._profile(cleaned)
    plan = profile._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 60), REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 3
    rows = {r["acct_id"]: r.asDict() for r in profile.collect()}
    assert set(rows) == {a for a in range(50) if a % 10}
    assert {(r["out_cnt"], r["out_sum"], r["out_nuniq_bene"], r["out_max_daily_cnt"]) for r in rows.values()} == {
        (60, 60, 1, 60)
    }
    # Transfers without a sender count, but are no counterparty.
    assert (rows[7]["in_cnt"], rows[7]["in_nuniq_orig"], rows[7]["in_max_daily_sum"]) == (3000, 45, 3000)


def test_line_items_meet_their_orders_in_as_many_tasks_as_the_rows_need(spark, small_dir, monkeypatch):
    plain = testdata.transactions(spark, small_dir)
    rows = plain.count()
    for module in (ledger, testdata):
        monkeypatch.setattr(module, "TASK_ROWS", 300)
    parts = -(-rows // 300)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = testdata.transactions(spark, small_dir)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {parts}), REPARTITION_BY_NUM") == 2
    assert dealt.count() == rows and dealt.exceptAll(plain).isEmpty()


def test_separate_feature_operators_agree_with_the_profile(inputs):
    one = inputs.features.where("out_cnt > 0").select(
        "acct_id", "out_cnt", "out_sum", "out_nuniq_bene"
    )
    assert one.exceptAll(features.out_features(inputs.ledger)).isEmpty()
    burst = features.burst_features(features.daily_activity(inputs.ledger))
    peaks = burst.select("acct_id", "out_max_daily_cnt", "in_max_daily_cnt")
    assert peaks.exceptAll(inputs.features.select(*peaks.columns)).isEmpty()


def test_integrity(accounts, transfers, sar):
    built = features.account_features(accounts, transfers, sar)
    checks = ledger.integrity_checks(accounts, transfers, sar, built)
    got = {r["check"]: r["failures"] for r in checks.collect()}
    assert got == {
        "sar_without_account": 2,
        "transfer_without_account": 1,
        "account_without_features": 0,
        "features_without_account": 0,
        "repeated_account_id": 0,
    }
    with pytest.raises(ValueError, match="sar_without_account"):
        ledger.require_healthy(checks)


def test_whole_row_repeats_are_dropped_before_projection(spark):
    raw = spark.createDataFrame(
        [("1", "5", "CA", "a", "n1"), ("1", "5", "CA", "a", "n1"), ("1", "5", "CA", "a", "n2")],
        "acct_id string, initial_deposit string, state string, bank_id string, note string",
    )
    # Two different source rows remain although their used columns are equal.
    assert ledger.clean_accounts(raw).count() == 2


def test_uneven_account_join_is_split_by_aqe(spark):
    """A third of all transfers leave one account; the view join must not put them in
    one task. Thresholds are lowered so that small data counts as skewed."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).repartition(8).select(
            F.col("id").alias("tran_id"),
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("orig_acct"),
            F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 400).alias("bene_acct"),
        )
        # Stored, as real accounts are: a range would come already partitioned.
        homes = durable(
            spark.range(500).select(F.col("id").alias("acct_id"), F.lit("a").alias("bank_id")),
            "homes",
        )
        views = ledger.bank_views(rows, homes)
        assert len(views.collect()) == 60_000
        plan = views._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert final.count("SortMergeJoin(skew=true)") == 2
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hub_rows(spark):
    """A third of all transfers leave account 1, another third reach it; some ids are null
    or belong to no bank."""
    rows = spark.range(30_000).repartition(8).select(
        F.col("id").alias("tran_id"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 100 == 7, None).otherwise(F.col("id") % 700).alias("orig_acct"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") % 400).alias("bene_acct"),
    )
    homes = spark.range(500).select(
        F.col("id").alias("acct_id"), F.concat(F.lit("bank "), F.col("id") % 3).alias("bank_id")
    )
    return rows, homes


def test_hubs_are_found_and_few(hub_rows, monkeypatch):
    rows, _ = hub_rows
    assert ledger.hub_accounts(rows) == []
    monkeypatch.setattr(ledger, "HUB_ROWS", 1_000)
    assert ledger.hub_accounts(rows) == [1]
    assert len(ledger.hub_accounts(rows, share=1 / 100)) <= 2 * 100
    assert ledger.hub_accounts(rows.limit(0)) == []


def test_hubs_change_no_row(hub_rows):
    rows, homes = hub_rows
    plain = ledger.bank_views(rows, homes, hubs=[])
    apart = ledger.bank_views(rows, homes, hubs=[1, 2, 499, 650, 10**9])
    assert plain.columns == apart.columns
    assert plain.exceptAll(apart).isEmpty() and apart.exceptAll(plain).isEmpty()


def test_accounts_are_copied_for_no_one(hub_rows):
    """Plain joins without hubs; with them, a broadcast of the hubs' rows alone."""
    rows, homes = hub_rows
    plain = ledger.bank_views(rows, homes, hubs=[])
    apart = ledger.bank_views(rows, homes, hubs=[1])
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (plain, apart)]
    # The one array that is spread out is that of a transfer's banks.
    assert all(p.count("Generate explode") == 1 for p in plans)
    assert "broadcast" not in plans[0]
    assert plans[1].count("strategy=broadcast") == 2 and plans[1].count("IN (1)") + plans[1].count("= 1)") >= 2
