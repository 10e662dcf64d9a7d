"""Federated averaging and model selection over long tables.

Parameters of any model are rows (key, pos, value): ``key`` names an array and ``pos``
is the flat position in it, so averaging needs to know nothing about the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flatten_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_train, key, values array) -> one row per scalar parameter."""
    return updates.select(*keys, "n_train", "key", F.posexplode("values").alias("pos", "value"))


def fedavg(
    updates: DataFrame, members: Sequence[str] = ("bank_id",), run: Sequence[str] = ()
) -> DataFrame:
    """(run, key, pos, value, n_train): the n-weighted mean of the members' parameters.

    Members without rows are ignored; a member without a row count is an error, and so
    is a position not every member reports, which would silently be a mean over fewer.
    That is checked on a fingerprint of the contributing members per position, so the
    updates (often the output of a training job) are read once. ``run`` columns (alpha,
    round) average independently.
    """
    run = list(run)
    counted = F.coalesce(
        F.col("n_train"), F.raise_error(F.lit("update without n_train")).cast("bigint")
    )
    usable = updates.withColumn("n_train", counted).where(F.col("n_train") > 0)
    merged = usable.groupBy(*run, "key", "pos").agg(
        (F.sum(F.col("n_train") * F.col("value")) / F.sum("n_train")).alias("value"),
        F.sum("n_train").alias("n_train"),
        F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*members)).alias("x")).alias("who"),
    )
    whole = W.partitionBy(*(run or [F.lit(0)]))
    complete = F.min("who").over(whole) == F.max("who").over(whole)
    value = F.when(complete, F.col("value")).otherwise(
        F.raise_error(F.lit("updates disagree on their parameters")).cast("double")
    )
    return merged.select(*run, "key", "pos", value.alias("value"), "n_train")


def early_stopping(
    log: DataFrame,
    patience: int,
    keys: Sequence[str] = ("alpha",),
    loss: str = "loss",
) -> DataFrame:
    """Replays best-so-far and patience over a metric log (keys, round, loss).

    Adds best_loss, best_round, no_improve and stopped_at (the round patience runs out,
    null if it never does), and keeps the rounds up to there. A round improves when its
    loss is below every loss before it.
    """
    keys = list(keys)
    upto = W.partitionBy(*keys).orderBy("round")
    before = upto.rowsBetween(W.unboundedPreceding, -1)
    through = upto.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    value = F.col(loss)
    previous = F.min(value).over(before)
    improves = previous.isNull() | (value < previous)
    marked = log.withColumn("_better", improves).withColumns(
        {
            "best_loss": F.min(F.when(F.col("_better"), value)).over(through),
            "best_round": F.max(F.when(F.col("_better"), F.col("round"))).over(through),
        }
    )
    counted = marked.withColumn("no_improve", F.col("round") - F.col("best_round"))
    return (
        counted.withColumn(
            "stopped_at",
            F.min(F.when(F.col("no_improve") >= patience, F.col("round"))).over(whole),
        )
        .where(F.col("stopped_at").isNull() | (F.col("round") <= F.col("stopped_at")))
        .drop("_better")
    )


def select_best(
    candidates: DataFrame, keys: Sequence[str] = (), loss: str = "loss"
) -> DataFrame:
    """The candidate (alpha, round) with the lowest loss; ties go to the alpha tried
    first (``alpha_order``), then the earlier round."""
    rest = [c for c in candidates.columns if c not in keys]
    rank = F.struct(F.col(loss), F.col("alpha_order"), F.col("round"))
    best = F.min_by(F.struct(*rest), rank).alias("best")
    return candidates.groupBy(*keys).agg(best).select(*keys, "best.*")
