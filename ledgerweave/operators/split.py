"""Deterministic stratified train / val / test split with exact quotas.

Within a bank the accounts are ordered by a hash of seed and id; the first quota of
every stratum is train, the next val, the rest test. Nothing is ranked globally:

1. count accounts per (bank, label, leading hash digits),
2. running counts name the one bucket per stratum in which a quota ends,
3. only accounts of those buckets are ranked, which yields the exact hash (the cut)
   at which train ends and the one at which val ends,
4. every account's hash is compared with the two cuts.

Steps 1, 3 and 4 are narrow passes and the ranking sees one bucket in 65,536 per cut,
so a bank holding most of all accounts never becomes one task. Banks of every size are
split this way.

Ties: only account rows equal in every column have equal hashes. They are not told apart,
so all of them fall into the same split, and a quota that would end among them is
exceeded. Rows without an id are ordered by a hash of the whole row.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerweave.settings import SplitSpec
from ledgerweave.sources.durable import durable
from ledgerweave.sources.small import small_table

# Hash digits per bucket, and slack against float noise in quotas.
BUCKET_DIGITS = 4
CEIL_SLACK = 1e-9
WHOLE_BANK = -1

QUOTA_SCHEMA = pa.schema(
    [
        ("bank_id", pa.string()),
        ("label", pa.int32()),
        ("train_stratum", pa.int32()),
        ("train_quota", pa.int64()),
        ("val_stratum", pa.int32()),
        ("val_quota", pa.int64()),
    ]
)
BORDER_SCHEMA = pa.schema(
    [
        ("bank_id", pa.string()),
        ("cut", pa.string()),
        ("stratum", pa.int32()),
        ("bucket", pa.string()),
        ("rank", pa.int64()),
    ]
)
CUT_SCHEMA = pa.schema(
    [
        ("bank_id", pa.string()),
        ("label", pa.int32()),
        ("train_cut", pa.string()),
        ("val_cut", pa.string()),
    ]
)


def order_key(df: DataFrame, seed: int, id_col: str = "acct_id") -> Column:
    """Hash that orders accounts; missing and equal ids fall back to a hash of the whole
    row, so only rows equal in every column can tie, and those always land together."""
    row = F.hex(F.xxhash64(*df.columns))
    identity = F.coalesce(F.col(id_col).cast("string"), row)
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), identity)), F.lit("-"), row)


def _held_out(n: int, share: float) -> int:
    return math.ceil(n * share - CEIL_SLACK)


def _largest_remainder(take: int, sizes: dict[int, int]) -> dict[int, int]:
    """Share ``take`` in proportion to ``sizes``; leftovers go to the largest
    remainders, ties to the lower label."""
    total = sum(sizes.values())
    quota = {label: take * n // total for label, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda label: (-(take * sizes[label] % total), label))
    for label in by_rest[: take - sum(quota.values())]:
        quota[label] += 1
    return quota


def _stratified(sizes: dict[int, int]) -> bool:
    present = [n for n in sizes.values() if n > 0]
    return len(present) >= 2 and min(present) >= 2


def bank_quotas(sizes: dict[int, int], spec: SplitSpec) -> list[tuple[int, int, int, int, int]]:
    """(label, train stratum, train quota, val stratum, val quota) rows of one bank
    with ``sizes`` accounts per label.

    A bank is stratified when it has two classes with two rows each. The held-out part
    is tested again, and falls back to one stratum on its own.
    """
    held_share = spec.val + spec.test
    n = sum(sizes.values())
    n_held = _held_out(n, held_share)
    n_val = n_held - _held_out(n_held, spec.test / held_share)
    whole = dict.fromkeys(sizes, WHOLE_BANK)
    if not _stratified(sizes):
        train_of, train = whole, dict.fromkeys(sizes, n - n_held)
        val_of, val = whole, dict.fromkeys(sizes, n_val)
    else:
        train_of, train = {c: c for c in sizes}, _largest_remainder(n - n_held, sizes)
        held = {c: sizes[c] - train[c] for c in sizes}
        if _stratified(held):
            val_of, val = train_of, _largest_remainder(n_val, held)
        else:
            val_of, val = whole, dict.fromkeys(sizes, n_val)
    return [(c, train_of[c], train[c], val_of[c], val[c]) for c in sorted(sizes)]


def _class_sizes(counts: DataFrame) -> dict[str, dict[int, int]]:
    """Accounts per bank and label; one row per pair goes through the driver."""
    sizes: dict[str, dict[int, int]] = {}
    for bank, label, n in counts.collect():
        sizes.setdefault(bank, {})[label] = n
    if not sizes:
        raise ValueError("no labelled accounts to split")
    return sizes


def _borders(histogram: DataFrame, quotas: DataFrame) -> DataFrame:
    """(bank, cut, stratum, bucket, rank): the bucket each quota ends in, and how many
    accounts of that bucket still belong inside."""

    def border(counts: DataFrame, cut: str) -> DataFrame:
        before = F.col("upto") - F.col("n")
        quota = F.col(f"{cut}_quota")
        return counts.where((before < quota) & (quota <= F.col("upto"))).select(
            "bank_id",
            F.lit(cut).alias("cut"),
            F.col(f"{cut}_stratum").alias("stratum"),
            "bucket",
            (quota - before).alias("rank"),
        )

    def cumulated(counts: DataFrame, cut: str) -> DataFrame:
        ordered = W.partitionBy("bank_id", f"{cut}_stratum").orderBy("bucket")
        return counts.withColumn("upto", F.sum("n").over(ordered))

    strata = ["bank_id", "train_stratum", "train_quota", "val_stratum", "val_quota"]
    train = cumulated(
        histogram.join(quotas, ["bank_id", "label"])
        .groupBy(*strata, "bucket")
        .agg(F.sum("n").alias("n")),
        "train",
    )
    not_train = F.least(F.col("n"), F.greatest(F.col("upto") - F.col("train_quota"), F.lit(0)))
    val = cumulated(
        train.groupBy("bank_id", "val_stratum", "val_quota", "bucket").agg(
            F.sum(not_train).alias("n")
        ),
        "val",
    )
    return border(train, "train").unionByName(border(val, "val"))


def _cuts(keyed: DataFrame, quotas: DataFrame, borders: DataFrame) -> DataFrame:
    """Per bank and label the last key of train and of val ('' when there is none)."""

    def edge(cut: str) -> DataFrame:
        return borders.where(F.col("cut") == cut).select(
            "bank_id",
            F.col("stratum").alias(f"{cut}_stratum"),
            F.col("bucket").alias(f"{cut}_bucket"),
            F.col("rank").alias(f"{cut}_rank"),
        )

    strata = (
        quotas.select("bank_id", "label", "train_stratum", "val_stratum")
        .join(edge("train"), ["bank_id", "train_stratum"], "left")
        .join(edge("val"), ["bank_id", "val_stratum"], "left")
    )
    near = durable(
        keyed.join(strata, ["bank_id", "label"]).where(
            (F.col("bucket") == F.col("train_bucket")) | (F.col("bucket") == F.col("val_bucket"))
        ),
        "split-near",
    )

    def nth(rows: DataFrame, cut: str) -> DataFrame:
        ordered = W.partitionBy("bank_id", f"{cut}_stratum").orderBy("key")
        return (
            rows.withColumn("nth", F.row_number().over(ordered))
            .where(F.col("nth") == F.col(f"{cut}_rank"))
            .select("bank_id", f"{cut}_stratum", F.col("key").alias(f"{cut}_cut"))
        )

    none = F.lit("")
    train = nth(near.where(F.col("bucket") == F.col("train_bucket")), "train")
    val = nth(
        near.where(F.col("bucket") == F.col("val_bucket"))
        .join(train, ["bank_id", "train_stratum"], "left")
        .where(F.col("key") > F.coalesce("train_cut", none)),
        "val",
    )
    return (
        strata.join(train, ["bank_id", "train_stratum"], "left")
        .join(val, ["bank_id", "val_stratum"], "left")
        .select(
            "bank_id",
            "label",
            F.coalesce("train_cut", none).alias("train_cut"),
            F.coalesce("val_cut", none).alias("val_cut"),
        )
    )


def _cut_split(keyed: DataFrame, quotas: DataFrame) -> DataFrame:
    """Compares every account with its cuts; nothing but ``keyed`` is large."""
    spark = keyed.sparkSession
    slim = keyed.select("bank_id", "label", "bucket", "key")
    histogram = durable(
        slim.groupBy("bank_id", "label", "bucket").agg(F.count("*").alias("n")),
        "split-histogram",
    )
    borders = small_table(spark, BORDER_SCHEMA, _borders(histogram, quotas).collect())
    cuts = small_table(spark, CUT_SCHEMA, _cuts(slim, quotas, borders).collect())
    return keyed.join(cuts, ["bank_id", "label"]).withColumn(
        "split",
        F.when(F.col("key") <= F.col("train_cut"), "train")
        .when(F.col("key") <= F.col("val_cut"), "val")
        .otherwise("test"),
    )


def split_accounts(
    features: DataFrame,
    spec: SplitSpec | None = None,
    label_col: str = "is_sar",
) -> DataFrame:
    """Adds ``split`` (train / val / test); accounts without a label are dropped.

    ``features`` is read four times, so pass a stored table (see ``durable``). Quotas,
    borders and cuts have a row or two per bank and label and pass through the driver.
    """
    spec = spec or SplitSpec()
    labelled = features.where(F.col(label_col).isNotNull()).withColumn(
        "label", F.col(label_col).cast("int")
    )
    sizes = _class_sizes(labelled.groupBy("bank_id", "label").agg(F.count("*").alias("n")))
    rows = [(bank, *row) for bank in sorted(sizes) for row in bank_quotas(sizes[bank], spec)]
    quotas = small_table(features.sparkSession, QUOTA_SCHEMA, rows)
    keyed = labelled.withColumn("key", order_key(features, spec.seed)).withColumn(
        "bucket", F.substring("key", 1, BUCKET_DIGITS)
    )
    return _cut_split(keyed, quotas).select(*features.columns, "split")


def split_counts(split_rows: DataFrame, label_col: str = "is_sar") -> DataFrame:
    """Rows and positives per bank and split."""
    return split_rows.groupBy("bank_id", "split").agg(
        F.count("*").alias("n"), F.sum(F.col(label_col).cast("int")).alias("pos")
    )


def train_and_val(split_rows: DataFrame) -> DataFrame:
    """The rows a final fit may use once validation is no longer needed."""
    return split_rows.where(F.col("split").isin("train", "val"))
