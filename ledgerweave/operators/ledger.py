"""Cleaning of the raw tables and the per-bank views of the shared ledger.

Canonical columns after cleaning
    accounts      acct_id, initial_deposit, state, bank_id
    transactions  tran_id, tran_timestamp (UTC), orig_acct, bene_acct, base_amt
    sar           acct_id, is_sar_text
"""

from __future__ import annotations

import math
import weakref
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions.coerce import as_id, as_number, as_utc
from ledgerweave.sources.durable import durable

# Fixed value: the only flag text that confirms a report (case matters).
CONFIRMED = "YES"
# An account at one end of a larger share of all rows, and of more rows than a task takes
# easily, is joined apart.
HUB_SHARE = 1 / 1000
HUB_ROWS = 100_000
# Rows of a ledger that one task de-duplicates and counts; what it holds grows with them.
TASK_ROWS = 200_000
# Ledgers that lie dealt by whole row, and over how many partitions.
_DEALT: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def task_count(spark: SparkSession, rows: int | None = None) -> int:
    """Partitions for about ``rows`` rows of a ledger: ``spark.sql.shuffle.partitions``, or
    more where a task would get more than ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows or 0) / TASK_ROWS))


def dealt_parts(ledger: DataFrame) -> int | None:
    """Over how many partitions a ledger lies dealt in even shares, if it does."""
    return _DEALT.get(ledger)


def drop_repeats(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication.

    All columns are grouping keys, so copies collapse on the map side before the
    shuffle and even a row repeated a billion times sends one record per task.
    """
    return df.dropDuplicates()


def _money_type(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    return kind.simpleString() if isinstance(kind, T.DecimalType) else "double"


def clean_accounts(raw: DataFrame) -> DataFrame:
    return drop_repeats(raw).select(
        as_id(raw, "acct_id").alias("acct_id"),
        as_number(raw, "initial_deposit", _money_type(raw, "initial_deposit")).alias(
            "initial_deposit"
        ),
        "state",
        "bank_id",
    )


def clean_transactions(raw: DataFrame, rows: int | None = None) -> DataFrame:
    """Amounts stay DECIMAL when the source is DECIMAL, so that sums are exact and
    do not depend on the order in which tasks finish.

    The ledger is the one raw table that outgrows memory, so it is dealt by whole row over
    a stated number of partitions, which AQE does not merge, before copies are dropped.
    AQE would size tasks by the compressed bytes they read, and a transfer takes few.
    ``rows``, about how many there are, raises that number (see :func:`task_count`).
    """
    parts = task_count(raw.sparkSession, rows)
    cleaned = drop_repeats(raw.repartition(parts, *raw.columns)).select(
        "tran_id",
        as_utc(raw, "tran_timestamp").alias("tran_timestamp"),
        as_id(raw, "orig_acct").alias("orig_acct"),
        as_id(raw, "bene_acct").alias("bene_acct"),
        as_number(raw, "base_amt", _money_type(raw, "base_amt")).alias("base_amt"),
    )
    _DEALT[cleaned] = parts
    return cleaned


def clean_sar(raw: DataFrame) -> DataFrame:
    return drop_repeats(raw).select(
        as_id(raw, "ACCOUNT_ID").alias("acct_id"), F.col("IS_SAR").alias("is_sar_text")
    )


def bank_accounts(accounts: DataFrame, bank: str) -> DataFrame:
    return accounts.where(F.col("bank_id") == bank)


def confirmed_sar(sar: DataFrame) -> DataFrame:
    return sar.where(F.col("is_sar_text") == CONFIRMED)


def label_accounts(accounts: DataFrame, sar: DataFrame) -> DataFrame:
    """Adds ``is_sar``: does the account have a confirmed report? Never null."""
    flagged = (
        confirmed_sar(sar)
        .where(F.col("acct_id").isNotNull())
        .select("acct_id", F.lit(True).alias("_hit"))
        .distinct()
    )
    return (
        accounts.join(flagged, "acct_id", "left")
        .withColumn("is_sar", F.col("_hit").isNotNull())
        .drop("_hit")
    )


def account_homes(accounts: DataFrame) -> DataFrame:
    """acct_id -> the banks holding it (one for a well-formed ledger). The array is
    bounded by the number of banks, never by the number of rows."""
    return (
        accounts.where(F.col("acct_id").isNotNull() & F.col("bank_id").isNotNull())
        .groupBy("acct_id")
        .agg(F.collect_set("bank_id").alias("homes"))
    )


def hub_accounts(rows: DataFrame, share: float = HUB_SHARE) -> list[int]:
    """Ids at an end of more than ``share`` of the rows: at most 2 / share of them.

    One pass with a mergeable frequent-items sketch, whose size does not depend on the rows
    or the ids; nothing is shuffled. Its counts are estimates, which is enough: an id on
    either side of the border is joined correctly in either way.
    """
    most = math.ceil(1 / share)
    tracked = min(1 << 20, 1 << (4 * most).bit_length())
    sketch = F.expr(f"approx_top_k(end, {most}, {tracked})")
    found: set[int] = set()
    for end in ("orig_acct", "bene_acct"):
        ids = rows.select(F.col(end).alias("end")).where(F.col("end").isNotNull())
        total, top = ids.agg(F.count("*"), sketch).first()
        found |= {r["item"] for r in top or () if r["count"] > share * total and r["count"] > HUB_ROWS}
    return sorted(found)


def _attach_views(rows: DataFrame, accounts: DataFrame, hubs: Sequence[int] | None = None) -> DataFrame:
    """One output row per (input row, bank at either end), with ``internal``.

    Membership at either end is a disjunction, which as a join condition would become a
    nested loop; two equi-joins keep it hash partitioned. An account may be at one end of a
    third of all rows. Such hubs (found by :func:`hub_accounts` unless given) are few; their
    banks are a small table of at most one row each, which is broadcast, and the rows that
    meet it are spread by their own hash through the other join, where they match nothing.
    Without hubs both joins are plain, and the account side is not copied in either case.
    The account side is stored, so that AQE can split what is still uneven.
    """
    homes = durable(account_homes(accounts), "account-homes")
    hubs = hub_accounts(rows) if hubs is None else hubs
    nowhere = F.array().cast("array<string>")
    own = rows.columns

    def joined(left: DataFrame, end: str, name: str) -> DataFrame:
        if not hubs:
            return left.join(homes.select(F.col("acct_id").alias(end), F.col("homes").alias(name)), end, "left")
        is_hub = F.coalesce(F.col(end).isin(*hubs), F.lit(False))
        # One row for each hub, so the bound of the list is the bound of the broadcast.
        few = homes.where(F.col("acct_id").isin(*hubs)).select(
            F.col("acct_id").alias(end), F.col("homes").alias(f"{name}_hub")
        )
        rest = homes.select(
            F.lit(False).alias("_hub"), F.col("acct_id").alias("_key"), F.col("homes").alias(f"{name}_rest")
        )
        spread = F.when(is_hub, F.xxhash64(*own)).otherwise(F.col(end))
        return (
            left.withColumns({"_hub": is_hub, "_key": spread})
            .join(rest, ["_hub", "_key"], "left")
            .join(F.broadcast(few), end, "left")
            .withColumn(name, F.coalesce(f"{name}_hub", f"{name}_rest"))
            .drop("_hub", "_key", f"{name}_hub", f"{name}_rest")
        )

    both = joined(joined(rows, "orig_acct", "_from"), "bene_acct", "_to")
    sender = F.coalesce("_from", nowhere)
    receiver = F.coalesce("_to", nowhere)
    return both.select(
        *own,
        F.explode(F.array_union(sender, receiver)).alias("bank_id"),
        sender.alias("_s"),
        receiver.alias("_r"),
    ).select(
        *own,
        "bank_id",
        (
            F.array_contains("_s", F.col("bank_id"))
            & F.array_contains("_r", F.col("bank_id"))
        ).alias("internal"),
    )


def bank_views(ledger: DataFrame, accounts: DataFrame, hubs: Sequence[int] | None = None) -> DataFrame:
    """The ledger as each bank sees it: every transfer touching one of its accounts.
    A transfer between two banks appears in both views. Unless ``hubs`` are given, the
    ledger is read twice, so it should be a stored table."""
    return _attach_views(ledger, accounts, hubs)


def transfer_mix(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Internal and cross-bank transfer counts and shares per bank.

    Counts only need (sender, receiver) pairs, so repeated pairs are collapsed
    before they travel to the account lookup. A bank without transfers has zero counts
    and null shares.
    """
    pairs = durable(
        ledger.groupBy("orig_acct", "bene_acct").agg(F.count("*").alias("_n")), "transfer-pairs"
    )
    n = F.col("_n")
    mix = (
        _attach_views(pairs, accounts)
        .groupBy("bank_id")
        .agg(
            F.sum(n).alias("tx_total"),
            F.sum(F.when(F.col("internal"), n).otherwise(0)).alias("tx_internal"),
        )
    )
    banks = accounts.where(F.col("bank_id").isNotNull()).select("bank_id").distinct()
    whole = banks.join(mix, "bank_id", "left").fillna(0, ["tx_total", "tx_internal"])
    total = F.col("tx_total")
    shared = F.when(total > 0, total)
    return whole.withColumn("tx_cross", total - F.col("tx_internal")).select(
        "bank_id",
        "tx_total",
        "tx_internal",
        "tx_cross",
        (F.col("tx_internal") / shared).alias("internal_share"),
        (F.col("tx_cross") / shared).alias("cross_share"),
    )


def bank_sar(sar: DataFrame, accounts: DataFrame) -> DataFrame:
    """Report rows of each bank; rows with a null or foreign id match no bank."""
    return sar.join(accounts.select("acct_id", "bank_id").distinct(), "acct_id")


def bank_overview(accounts: DataFrame, ledger: DataFrame, sar: DataFrame) -> DataFrame:
    """Accounts, reports and transfer volumes per bank, with the ratios between them."""
    held = accounts.groupBy("bank_id").agg(F.countDistinct("acct_id").alias("accounts"))
    reported = (
        bank_sar(confirmed_sar(sar), accounts)
        .groupBy("bank_id")
        .agg(F.countDistinct("acct_id").alias("sar_yes"))
    )
    mix = transfer_mix(ledger, accounts).drop("internal_share", "cross_share")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def ratio(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))

    return (
        held.join(reported, "bank_id", "left")
        .join(mix, "bank_id", "left")
        .select(
            "bank_id",
            "accounts",
            *(count(c).alias(c) for c in ("sar_yes", "tx_total", "tx_internal", "tx_cross")),
        )
        .select(
            "*",
            ratio("sar_yes", "accounts").alias("sar_rate"),
            ratio("tx_total", "accounts").alias("tx_per_acct"),
            ratio("tx_cross", "tx_total").alias("cross_ratio"),
        )
    )


def integrity_checks(
    accounts: DataFrame, ledger: DataFrame, sar: DataFrame, features: DataFrame
) -> DataFrame:
    """(check, failures) rows; a healthy delivery has zeros throughout.

    Reads accounts and features by distinct id *and* by row, because equal distinct
    counts alone would hide duplicated ids.
    """
    ids = accounts.select("acct_id").where(F.col("acct_id").isNotNull()).distinct()
    covered = features.select("acct_id").where(F.col("acct_id").isNotNull()).distinct()

    def tally(check: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("failures")).select(
            F.lit(check).alias("check"), "failures"
        )

    per_id = accounts.groupBy("bank_id", "acct_id").agg(F.count("*").alias("_n"))
    # Not made distinct: an anti join does not mind, and AQE can only split a hub
    # account's partition when both sides come straight from an exchange.
    known_sender = accounts.select(F.col("acct_id").alias("orig_acct"))
    known_receiver = accounts.select(F.col("acct_id").alias("bene_acct"))
    pairs = ledger.groupBy("orig_acct", "bene_acct").agg(F.count("*").alias("_n"))
    orphans = pairs.join(known_sender, "orig_acct", "left_anti").join(
        known_receiver, "bene_acct", "left_anti"
    )
    return reduce(
        DataFrame.unionByName,
        (
            tally("sar_without_account", sar.join(ids, "acct_id", "left_anti")),
            orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("failures")).select(
                F.lit("transfer_without_account").alias("check"), "failures"
            ),
            tally("account_without_features", ids.join(covered, "acct_id", "left_anti")),
            tally("features_without_account", covered.join(ids, "acct_id", "left_anti")),
            tally("repeated_account_id", per_id.where(F.col("_n") > 1)),
        ),
    )


def require_healthy(checks: DataFrame) -> None:
    """Raises when a check of :func:`integrity_checks` failed."""
    broken = {r["check"]: r["failures"] for r in checks.where("failures > 0").collect()}
    if broken:
        raise ValueError(f"integrity checks failed: {broken}")
