"""Full-batch gradient step of the logistic objective, entirely in Spark SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.scoring import literal_vector, logit, probability
from ledgerweave.settings import FeatureSpec

INTERCEPT_SLOT = -1


def gradient_updates(
    encoded: DataFrame,
    coef: Sequence[float],
    intercept: float,
    alpha: float,
    eta: float,
    features: FeatureSpec,
    members: Sequence[str] = ("bank_id",),
) -> DataFrame:
    """One step from the given parameters for every member: (members, n_train, key, pos,
    value), ready for averaging.

    Only stored vector entries are summed, combined before the shuffle; positions a
    member has no entry for get a zero gradient, so all members report all positions.
    """
    members = list(members)
    start = [float(v) for v in coef]
    z = logit("_coef", f"{float(intercept)!r}D", len(features.num_cols), len(features.cat_cols))
    error = probability(z) - F.col("y")

    def slot(index, value):
        return F.struct(index.cast("int").alias("slot"), value.cast("double").alias("x"))

    entries = F.concat(
        F.array(slot(F.lit(INTERCEPT_SLOT), F.lit(1.0))),
        F.transform("num", lambda v, i: slot(i, v)),
        F.transform(F.filter("cat", lambda i: i.isNotNull()), lambda i: slot(i, F.lit(1.0))),
    )
    sums = (
        encoded.withColumn("_coef", literal_vector(start))
        .select(*members, error.alias("g"), F.inline(entries))
        .groupBy(*members, "slot")
        .agg(F.sum(F.col("g") * F.col("x")).alias("total"), F.count("*").alias("n"))
        .groupBy(*members)
        .agg(
            F.max(F.when(F.col("slot") == INTERCEPT_SLOT, F.col("n"))).alias("n_train"),
            F.map_from_entries(F.collect_list(F.struct("slot", "total"))).alias("totals"),
        )
    )

    def mean_gradient(i):
        total = F.coalesce(F.try_element_at("totals", i.cast("int")), F.lit(0.0))
        return total / F.col("n_train")

    step = F.transform(
        F.sequence(F.lit(0), F.lit(len(start) - 1)),
        lambda i: F.get(literal_vector(start), i) * F.lit(1.0 - eta * alpha)
        - F.lit(eta) * mean_gradient(i),
    )
    bias = F.lit(float(intercept)) - F.lit(eta) * mean_gradient(F.lit(INTERCEPT_SLOT))
    arrays = F.inline(
        F.array(
            F.struct(F.lit("coef").alias("key"), step.alias("values")),
            F.struct(F.lit("intercept").alias("key"), F.array(bias).alias("values")),
        )
    )
    return sums.select(*members, "n_train", arrays).select(
        *members, "n_train", "key", F.posexplode("values").alias("pos", "value")
    )
