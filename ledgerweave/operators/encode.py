"""Rows into the shared feature space of a plan.

An encoded row keeps ``num``, the scaled numeric block, and ``cat``, for every
categorical column the feature index of its value (null when the plan does not know
the value: an all-zero block). This is the row's sparse vector without its zeros; the
feature index of ``num[i]`` is ``i``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.settings import FeatureSpec
from ledgerweave.sources.durable import durable

MISSING_POLICIES = ("error", "mean")


def numeric_scaling(plan: DataFrame) -> dict[str, tuple[float, float]]:
    """Column -> (mean, std). One pair per configured column reaches the driver, so
    scaling is plain arithmetic on literals inside generated code."""
    rows = plan.where(F.col("kind") == "num").select("col", "mean", "std").collect()
    return {r["col"]: (r["mean"], r["std"]) for r in rows}


def scaled(name: str, mean: Column, std: Column, missing: str = "error") -> Column:
    """(x - mean) / std. A value that is missing, NaN or infinite is an error, or the mean
    on request: the statistics leave such values out."""
    if missing not in MISSING_POLICIES:
        raise ValueError(f"missing must be one of {MISSING_POLICIES}")
    x = F.col(name).cast("double")
    z = (x - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    absent = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    if missing == "mean":
        return F.when(absent, F.lit(0.0)).otherwise(z)
    return F.when(
        absent, F.raise_error(F.lit(f"missing or infinite value in feature {name}")).cast("double")
    ).otherwise(z)


def standardize(
    rows: DataFrame, plan: DataFrame, spec: FeatureSpec, missing: str = "error"
) -> DataFrame:
    """Adds one ``z_<col>`` per numeric column."""
    scaling = numeric_scaling(plan)
    return rows.withColumns(
        {
            f"z_{c}": scaled(c, F.lit(scaling[c][0]), F.lit(scaling[c][1]), missing)
            for c in spec.num_cols
        }
    )


def category_index(rows: DataFrame, plan: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Adds one ``cat_<col>`` per categorical column: the feature index, or null.

    A left join per column. A stored plan has a known size, so Catalyst broadcasts it
    while it is small; a huge vocabulary is shuffled, and AQE splits a frequent value.
    """
    out = rows
    for c in spec.cat_cols:
        vocab = plan.where((F.col("kind") == "cat") & (F.col("col") == c)).select(
            F.col("value").alias("_value"), F.col("idx").alias(f"cat_{c}")
        )
        out = out.join(vocab, out[c].cast("string") == vocab["_value"], "left").drop("_value")
    return out


def encode(
    rows: DataFrame,
    plan: DataFrame,
    spec: FeatureSpec,
    label_col: str = "is_sar",
    missing: str = "error",
) -> DataFrame:
    """(acct_id, bank_id, split, y, num, cat) of split account rows."""
    wide = category_index(standardize(rows, plan, spec, missing), plan, spec)
    return wide.select(
        "acct_id",
        "bank_id",
        "split",
        F.col(label_col).cast("int").alias("y"),
        F.array(*(f"z_{c}" for c in spec.num_cols)).alias("num"),
        F.array(*(F.col(f"cat_{c}") for c in spec.cat_cols)).cast("array<int>").alias("cat"),
    )


def nonzero_entries(encoded: DataFrame) -> DataFrame:
    """(acct_id, bank_id, idx, value): the stored entries of every row's vector."""
    entries = F.concat(
        F.transform("num", lambda v, i: F.struct(i.alias("idx"), v.alias("value"))),
        F.transform(
            F.filter("cat", lambda i: i.isNotNull()),
            lambda i: F.struct(i.alias("idx"), F.lit(1.0).alias("value")),
        ),
    )
    return encoded.select("acct_id", "bank_id", F.inline(entries))


def dense_vector(encoded: DataFrame, width: int) -> DataFrame:
    """Adds ``x``, the full vector; meant for models that need it and modest widths."""
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    numeric = F.size("num")
    return encoded.withColumn(
        "x",
        F.transform(
            positions,
            lambda i: F.when(i < numeric, F.get("num", i)).otherwise(
                F.coalesce(F.array_contains("cat", i), F.lit(False)).cast("double")
            ),
        ),
    )


def one_hot(rows: DataFrame, plan: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(acct_id, bank_id, name): the indicator that is 1 for each known category.
    Unknown and null categories have no row, which is their all-zero block."""
    names = plan.where(F.col("kind") == "cat").select("idx", "name")
    active = F.array(*(F.col(f"cat_{c}") for c in spec.cat_cols))
    return (
        category_index(rows, plan, spec)
        .select("acct_id", "bank_id", F.explode(active).alias("idx"))
        .join(names, "idx")
    )


def local_encode(
    rows: DataFrame,
    numeric: DataFrame,
    vocab: DataFrame,
    spec: FeatureSpec,
    missing: str = "error",
) -> DataFrame:
    """Each bank in its *own* feature space (categories first, then numerics).

    ``numeric`` is (bank_id, col, mean, std) and ``vocab`` (bank_id, col, value, pos),
    the statistics finalised with ``bank_id`` in the key. Both are stored first: their
    size is then known, and while small they are broadcast instead of gathering a bank's
    rows in one task. Returns (acct_id, bank_id, name, value) with the numerics and the
    one category indicator per column.
    """
    pick = {
        c: F.max(F.when(F.col("col") == c, F.struct("mean", "std"))).alias(f"_{c}")
        for c in spec.num_cols
    }
    per_bank = durable(numeric.groupBy("bank_id").agg(*pick.values()), "local-scaling")
    vocab = durable(vocab, "local-vocab")
    z = F.inline(
        F.array(
            *(
                F.struct(
                    F.lit(f"num__{c}").alias("name"),
                    scaled(c, F.col(f"_{c}.mean"), F.col(f"_{c}.std"), missing).alias("value"),
                )
                for c in spec.num_cols
            )
        )
    )
    numerics = rows.join(per_bank, "bank_id").select("acct_id", "bank_id", z)
    values = F.inline(
        F.array(
            *(
                F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                for c in spec.cat_cols
            )
        )
    )
    hits = (
        rows.select("acct_id", "bank_id", values)
        .join(vocab, ["bank_id", "col", "value"])
        .select(
            "acct_id",
            "bank_id",
            F.concat(F.lit("cat__"), F.col("col"), F.lit("_"), F.col("value")).alias("name"),
            F.lit(1.0).alias("value"),
        )
    )
    return numerics.unionByName(hits)
