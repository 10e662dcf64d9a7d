"""Masked metric sums.

Every pair of banks derives the same pseudo-random number from a shared secret; one
adds it, the other subtracts it. Sums over all banks are exact up to rounding while a
single bank's report stays hidden. Only metrics are masked: model updates travel in the
clear, as in the scheme this follows.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.settings import MASK_SCALE, SECRET_VARIABLE
from ledgerweave.sources.small import small_table

# Digest layout of the two uniforms, and how close alphas must be.
UNIFORM_DIGITS = 13
UNIFORM_BITS = 52
ALPHA_TOLERANCE = 1e-12
# Weights are row counts; what masks leave behind of a sum of zeros is far below this.
WEIGHT_ROUNDING = 1e-3


def resolve_secret(configured: str | None = None, simulation: bool = False) -> str:
    """The shared secret: from the environment, or, in simulation mode only, from an
    argument. An empty secret is refused in both cases."""
    secret = (configured or "") if simulation else os.environ.get(SECRET_VARIABLE, "")
    if not secret.strip():
        source = "the simulation argument" if simulation else f"variable {SECRET_VARIABLE}"
        raise RuntimeError(f"no secure aggregation secret in {source}")
    return secret.strip()


def secret_column(spark: SparkSession, secret: str) -> Column:
    """The secret as a scalar subquery over a one-row table, so that it is data and
    never shows up as a literal in explained or logged plans."""
    return small_table(spark, pa.schema([("secret", pa.string())]), [(secret,)]).scalar()


def _uniform(digest: str, start: int) -> str:
    digits = f"conv(substring({digest}, {start}, {UNIFORM_DIGITS}), 16, 10)"
    return f"((CAST({digits} AS BIGINT) + 0.5D) / {float(2**UNIFORM_BITS)!r}D)"


def pair_mask(secret: str, me: str, other: str, round_id: str, tag: str, scale: float) -> str:
    """SQL text of the Normal(0, scale) number two banks share (Box-Muller on two slices
    of a SHA-256 digest), with opposite signs at the two ends. All arguments but the
    scale are SQL expressions; the secret must be a column, not a literal."""
    text = f"concat_ws('|', {secret}, least({me}, {other}), greatest({me}, {other}), {round_id}, {tag})"
    digest = f"sha2({text}, 256)"
    first, second = _uniform(digest, 1), _uniform(digest, 1 + UNIFORM_DIGITS)
    normal = f"sqrt(-2D * ln({first})) * cos({2.0 * math.pi!r}D * {second})"
    return f"IF({me} < {other}, {float(scale)!r}D, {-float(scale)!r}D) * {normal}"


def bank_array(names: Sequence[str]) -> Column:
    return F.array(*(F.lit(n) for n in sorted(names)))


def pairwise_masks(
    participants: DataFrame, names: Sequence[str], secret: Column, round_id: int, tag: str
) -> DataFrame:
    """(bank_id, other, mask) for every ordered pair of the configured banks."""
    pairs = participants.select(
        "bank_id",
        F.explode(bank_array(names)).alias("other"),
        secret.alias("_secret"),
        F.lit(round_id).alias("_round"),
        F.lit(tag).alias("_tag"),
    ).where("bank_id <> other")
    mask = pair_mask("_secret", "bank_id", "other", "_round", "_tag", MASK_SCALE)
    return pairs.select("bank_id", "other", F.expr(mask).alias("mask"))


def mask_metrics(
    reports: DataFrame,
    participants: Sequence[str],
    secret: Column,
    scale: float = MASK_SCALE,
) -> DataFrame:
    """Replaces num and den of reports (bank_id, alpha, round, metric, num, den) by
    num_masked and den_masked; every metric and either part has masks of its own.

    The other banks are a short configured list, so a bank's masks are added up inside
    its own row: no pairing of rows, no shuffle."""
    keyed = reports.withColumns({"_secret": secret, "_banks": bank_array(participants)})

    def masked(part: str) -> Column:
        tag = f"concat(metric, '_{part}')"
        mask = pair_mask("_secret", "bank_id", "other", "round", tag, scale)
        return F.expr(
            f"CAST({part} AS DOUBLE) + aggregate(_banks, 0D, "
            f"(total, other) -> total + IF(bank_id <> other, {mask}, 0D))"
        ).alias(f"{part}_masked")

    return keyed.select("bank_id", "alpha", "round", "metric", masked("num"), masked("den"))


def metric_fractions(metrics: DataFrame, names: Sequence[str], prefix: Column) -> DataFrame:
    """Metrics of scored sets as long fractions: adds metric, num and den, one row per
    name in ``names`` plus the loss.

    AP, AUC and the like are not additive and are averaged by validation size ``n``; an
    undefined metric weighs 0. The loss is its weighted sum over its sum of weights.
    """

    def fraction(name: str, num: Column, den: Column) -> Column:
        return F.struct(
            F.concat(prefix, F.lit(f"_val_{name}")).alias("metric"),
            num.cast("double").alias("num"),
            den.cast("double").alias("den"),
        )

    parts = [fraction("wlogloss", F.col("wloss_sum"), F.col("w_sum"))]
    for name in names:
        weight = F.when(F.col(name).isNotNull(), F.col("n")).otherwise(F.lit(0))
        parts.append(fraction(name, F.coalesce(F.col(name), F.lit(0.0)) * weight, weight))
    return metrics.select("*", F.inline(F.array(*parts)))


def in_run(round_id: int, alpha: float | None) -> Column:
    """Records of a round; a record without alpha belongs to every alpha."""
    this_round = F.col("round") == round_id
    if alpha is None:
        return this_round
    close = F.abs(F.col("alpha") - F.lit(alpha)) <= F.lit(ALPHA_TOLERANCE)
    return this_round & (F.col("alpha").isNull() | close)


def missing_participants(reports: DataFrame, participants: DataFrame) -> DataFrame:
    """Banks that did not report; masks only cancel when this is empty."""
    return participants.join(reports.select("bank_id").distinct(), "bank_id", "left_anti")


def secure_mean(
    reports: DataFrame,
    participants: Sequence[str],
    keys: Sequence[str] = ("alpha", "round", "metric"),
    undefined: str = "error",
) -> DataFrame:
    """(keys, value): sum of masked numerators over sum of masked denominators.

    Each configured bank counts once (the smallest record if it reported twice);
    strangers are left out. A missing bank, a missing field or a sum of weights that is
    not positive is an error, since the masks would not cancel. With ``undefined`` "null" a
    metric that no bank could compute (all weights zero, up to the rounding of the masks)
    has no value instead.
    """
    keys = list(keys)
    weightless = F.col("den") <= WEIGHT_ROUNDING
    first = (
        reports.where(F.col("bank_id").isin(*participants))
        .groupBy(*keys, "bank_id")
        .agg(F.min(F.struct("num_masked", "den_masked")).alias("r"))
    )
    summed = first.groupBy(*keys).agg(
        F.sum("r.num_masked").alias("num"),
        F.sum("r.den_masked").alias("den"),
        F.count_if(F.col("r.num_masked").isNull() | F.col("r.den_masked").isNull()).alias(
            "absent"
        ),
        F.array_except(bank_array(participants), F.collect_set("bank_id")).alias("missing"),
    )

    def failure(text: Column) -> Column:
        return F.raise_error(text).cast("double")

    silent = F.concat(F.lit("banks without a report: "), F.array_join("missing", ", "))
    value = (
        F.when(F.size("missing") > 0, failure(silent))
        .when(F.col("absent") > 0, failure(F.lit("masked field missing")))
        .when(
            weightless,
            failure(F.lit("sum of weights is not positive")) if undefined == "error" else F.lit(None),
        )
        .otherwise(F.col("num") / F.col("den"))
    )
    return summed.select(*keys, value.alias("value"))
