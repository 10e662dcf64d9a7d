"""Views the order/customer star schema as a ledger: customers become accounts,
line items become transfers, customers with a high balance become reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators.ledger import TASK_ROWS, task_count

# Columns in use. Stating them spares a schema-inference job per read.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("c_custkey") % 20
    bank = F.when(slot < 11, "bank_l").when(slot < 17, "bank_m").otherwise("bank_s")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state")
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").alias("acct_id"),
            F.col("c_acctbal").alias("initial_deposit"),
            "state",
            bank.alias("bank_id"),
        )
    )


def transactions(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """Line items with the customer of their order. Above the rows of one task both sides are
    dealt by order over a stated number of partitions: AQE would size the tasks that sort them
    by compressed bytes, and cannot make more than ``spark.sql.shuffle.partitions``. ``rows``
    is the number of line items, counted here if not given."""
    customers = table(spark, sf_dir, "customer").select(F.count("*").alias("n")).scalar()
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("orig_acct")
    )
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count() if rows is None else rows
    if rows > TASK_ROWS:
        parts = task_count(spark, rows)
        lines, orders = (side.repartition(parts, "l_orderkey") for side in (lines, orders))
    return (
        lines.join(orders, "l_orderkey")
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tran_id"),
            "orig_acct",
            ((F.col("l_partkey") * 131 + F.col("l_suppkey") * 17) % customers).alias("bene_acct"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("base_amt"),
            F.col("l_shipdate").alias("tran_timestamp"),
        )
    )


def sar_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return (
        table(spark, sf_dir, "customer")
        .where(balance > 9000)
        .select(
            F.col("c_custkey").alias("ACCOUNT_ID"),
            F.when(balance > 9200, "YES").otherwise("NO").alias("IS_SAR"),
        )
    )


def repeated_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with some rows delivered twice."""
    ledger = transactions(spark, sf_dir)
    return ledger.unionByName(ledger.where(F.col("tran_id") % 97 == 0))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger with time-of-day, taken from the event table."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tran_id"),
        F.col("user_id").alias("orig_acct"),
        ((F.col("event_id") * 7 + 3) % 150).alias("bene_acct"),
        F.col("value").cast("decimal(18,2)").alias("base_amt"),
        F.col("ts").alias("tran_timestamp"),
    )
