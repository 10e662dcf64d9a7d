"""Federated model against each bank's own baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short names of compared metrics, and metrics where lower is better.
COMPARED = {
    "p": "test_p",
    "r": "test_r",
    "ap": "test_ap",
    "auc": "test_roc_auc",
    "wlogloss": "test_wlogloss",
    "f1": "test_f1",
}
LOWER_IS_BETTER = ("wlogloss",)
NOT_AVAILABLE = "NA"


def _present(df: DataFrame, *names: str) -> Column:
    """First non-null of the columns the table has; older reports use other names."""
    known = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*known) if known else F.lit(None).cast("double")


def compare_models(federated: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per bank with base_*, fl_* and delta_* of every metric.

    A bank without a baseline keeps its row with nulls. ``split_differs`` warns that
    the two reports were not computed on the same test rows.
    """
    base = baseline.select(
        "bank_id",
        F.lit(True).alias("_has_base"),
        F.col("test_n").alias("_base_n"),
        F.col("test_pos").alias("_base_pos"),
        *(
            _present(baseline, name, name.replace("wlogloss", "logloss")).alias(f"base_{short}")
            for short, name in COMPARED.items()
        ),
    )
    fl = federated.select(
        "bank_id",
        "test_n",
        "test_pos",
        *(F.col(name).alias(f"fl_{short}") for short, name in COMPARED.items()),
    )
    columns = []
    for short in COMPARED:
        ours, theirs = F.col(f"fl_{short}"), F.col(f"base_{short}")
        columns += [theirs, ours, (ours - theirs).alias(f"delta_{short}")]
    differs = (F.col("_base_n") != F.col("test_n")) | (F.col("_base_pos") != F.col("test_pos"))
    return fl.join(base, "bank_id", "left").select(
        "bank_id",
        *columns,
        F.coalesce("_has_base", F.lit(False)).alias("has_baseline"),
        F.coalesce(differs, F.lit(False)).alias("split_differs"),
    )


def signed_text(value: Column, digits: int = 3) -> Column:
    return F.coalesce(
        F.when(value.isNotNull(), F.format_string(f"%+.{digits}f", value)), F.lit(NOT_AVAILABLE)
    )


def delta_report(compared: DataFrame) -> DataFrame:
    """Signed text per delta and the loss improvement (a lower loss is positive)."""
    return compared.select(
        "bank_id",
        *(signed_text(F.col(f"delta_{s}")).alias(f"delta_{s}") for s in COMPARED),
        *((-F.col(f"delta_{s}")).alias(f"{s}_improvement") for s in LOWER_IS_BETTER),
    )
