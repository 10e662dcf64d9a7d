"""Account behaviour features from the shared ledger.

Every transfer touching an account is in that account's bank view, so aggregating
the ledger once, over all banks, gives the same features as building each view
first; no view is materialised here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.ledger import dealt_parts, label_accounts, task_count

# Facets a transfer is counted under: its two accounts, and either account with the day.
PAIR, OUT_DAY, IN_DAY = range(3)
# What an account gets from them: volumes and counterparties, and daily bursts.
OUT_PEER, IN_PEER = PAIR, IN_DAY + 1

SUM_COLUMNS = (
    "out_sum",
    "in_sum",
    "net_flow",
    "out_max_daily_sum",
    "in_max_daily_sum",
)
FEATURE_COLUMNS = (
    "acct_id",
    "bank_id",
    "initial_deposit",
    "state",
    "is_sar",
    "out_cnt",
    "out_sum",
    "out_nuniq_bene",
    "in_cnt",
    "in_sum",
    "in_nuniq_orig",
    "net_flow",
    "out_max_daily_cnt",
    "out_max_daily_sum",
    "in_max_daily_cnt",
    "in_max_daily_sum",
)


def day_of(timestamp: Column) -> Column:
    """UTC day of a zone-less UTC timestamp."""
    return F.to_date(timestamp)


def _volume(amount: str) -> Column:
    """Sum that is 0, not null, for an account whose amounts are all missing."""
    return F.coalesce(F.sum(amount), F.lit(0))


def _flow(ledger: DataFrame, end: str, peer: str, names: tuple[str, str, str]) -> DataFrame:
    count, total, distinct = names
    return (
        ledger.where(F.col(end).isNotNull())
        .groupBy(F.col(end).alias("acct_id"))
        .agg(
            F.count("*").alias(count),
            _volume("base_amt").cast("double").alias(total),
            F.countDistinct(peer).alias(distinct),
        )
    )


def out_features(ledger: DataFrame) -> DataFrame:
    return _flow(ledger, "orig_acct", "bene_acct", ("out_cnt", "out_sum", "out_nuniq_bene"))


def in_features(ledger: DataFrame) -> DataFrame:
    return _flow(ledger, "bene_acct", "orig_acct", ("in_cnt", "in_sum", "in_nuniq_orig"))


def daily_activity(ledger: DataFrame) -> DataFrame:
    """(acct_id, direction, day) -> daily_cnt, daily_sum; undated rows are left out."""
    ends = F.inline(
        F.array(
            F.struct(F.col("orig_acct").alias("acct_id"), F.lit("out").alias("direction")),
            F.struct(F.col("bene_acct").alias("acct_id"), F.lit("in").alias("direction")),
        )
    )
    return (
        ledger.select(day_of(F.col("tran_timestamp")).alias("day"), "base_amt", ends)
        .where(F.col("acct_id").isNotNull() & F.col("day").isNotNull())
        .groupBy("acct_id", "direction", "day")
        .agg(F.count("*").alias("daily_cnt"), _volume("base_amt").alias("daily_sum"))
    )


def burst_features(daily: DataFrame) -> DataFrame:
    """Largest daily count and sum per account and direction."""

    def peak(direction: str, column: str) -> Column:
        return F.max(F.when(F.col("direction") == direction, F.col(column)))

    return daily.groupBy("acct_id").agg(
        *(
            F.coalesce(peak(d, f"daily_{what}"), F.lit(0)).alias(f"{d}_max_daily_{what}")
            for d in ("out", "in")
            for what in ("cnt", "sum")
        )
    )


def _spread(ledger: DataFrame) -> DataFrame:
    """The ledger dealt evenly over a stated number of partitions, which AQE does not merge.

    AQE sizes tasks by the compressed bytes they read, and a transfer takes few: millions of
    them would share a task, and three facets of each its hash table. A ledger that lies
    dealt (see :func:`ledgerweave.operators.ledger.clean_transactions`) stays where it is.
    """
    if dealt_parts(ledger):
        return ledger
    return ledger.repartition(task_count(ledger.sparkSession), F.xxhash64(*ledger.columns))


def _profile(ledger: DataFrame) -> DataFrame:
    """All ledger features of an account in one pass over the transfers.

    Each transfer becomes three facet rows, aggregated on (facet, account, counterparty
    or day); the pair facet then serves both of its accounts, and the results are folded
    per account. That is two shuffles for everything, against two per distinct count and
    per burst. A hub account is spread over its counterparties and days first, and arrives
    in the fold as a row for each, not for each transfer. Both shuffles have as many
    partitions as the ledger, so a task counts a share of it (see :func:`_spread`) and its
    memory does not grow with the ledger. Nothing is combined before them: a share has
    hardly two rows of one facet, and none but a few of one account, so that would only
    fill a hash table and send wider rows.
    """
    day = "unix_date(to_date(tran_timestamp))"
    facets = F.expr(
        f"""inline(array(
            struct({PAIR}Y AS facet, orig_acct AS a, bene_acct AS b),
            struct({OUT_DAY}Y AS facet, orig_acct AS a, CAST({day} AS BIGINT) AS b),
            struct({IN_DAY}Y AS facet, bene_acct AS a, CAST({day} AS BIGINT) AS b)))"""
    )
    parts = dealt_parts(ledger) or task_count(ledger.sparkSession)
    counted = (
        _spread(ledger)
        .select("base_amt", facets)
        .where(f"facet = {PAIR} OR (a IS NOT NULL AND b IS NOT NULL)")
        .repartition(parts, "facet", "a", "b")
        .groupBy("facet", "a", "b")
        .agg(F.count("*").alias("n"), _volume("base_amt").alias("amount"))
    )
    ends = F.expr(
        f"""inline(CASE WHEN facet = {PAIR} THEN array(
                struct({OUT_PEER}Y AS role, a AS acct_id, b IS NOT NULL AS known),
                struct({IN_PEER}Y AS role, b AS acct_id, a IS NOT NULL AS known))
            ELSE array(struct(facet AS role, a AS acct_id, true AS known)) END)"""
    )

    def of(role: int, value: str) -> str:
        return f"CASE WHEN role = {role} THEN {value} END"

    folded = {
        "out_cnt": f"sum({of(OUT_PEER, 'n')})",
        "out_sum": f"sum({of(OUT_PEER, 'amount')})",
        "out_nuniq_bene": f"count_if(role = {OUT_PEER} AND known)",
        "in_cnt": f"sum({of(IN_PEER, 'n')})",
        "in_sum": f"sum({of(IN_PEER, 'amount')})",
        "in_nuniq_orig": f"count_if(role = {IN_PEER} AND known)",
        "out_max_daily_cnt": f"max({of(OUT_DAY, 'n')})",
        "out_max_daily_sum": f"max({of(OUT_DAY, 'amount')})",
        "in_max_daily_cnt": f"max({of(IN_DAY, 'n')})",
        "in_max_daily_sum": f"max({of(IN_DAY, 'amount')})",
    }
    return (
        counted.select("n", "amount", ends)
        .where("acct_id IS NOT NULL")
        .repartition(parts, "acct_id")
        .groupBy("acct_id")
        .agg(*(F.expr(sql).alias(name) for name, sql in folded.items()))
    )


def account_features(accounts: DataFrame, ledger: DataFrame, sar: DataFrame) -> DataFrame:
    """One row per account of every bank: static columns, label, behaviour.

    Inputs are the cleaned tables of :mod:`ledgerweave.operators.ledger`. The
    profile leaves its aggregation partitioned by account, so only the (much
    smaller) account side moves for the join.
    """
    profile = _profile(ledger)
    measured = [c for c in profile.columns if c != "acct_id"]
    joined = label_accounts(accounts, sar).join(profile, "acct_id", "left")
    filled = joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in measured}
    ).withColumn("net_flow", F.col("in_sum") - F.col("out_sum"))
    as_double = {c: F.col(c).cast("double") for c in (*SUM_COLUMNS, "initial_deposit")}
    return filled.withColumns(as_double).select(*FEATURE_COLUMNS)
