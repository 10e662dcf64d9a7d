from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.operators.split import bank_quotas, order_key, split_accounts
from ledgerweave.settings import SplitSpec


def accounts(spark, rows):
    return spark.createDataFrame(rows, "acct_id bigint, bank_id string, is_sar boolean")


def assignment(df):
    return {(r["bank_id"], r["acct_id"]): r["split"] for r in df.collect()}


@given(st.dictionaries(st.integers(0, 3), st.integers(1, 10**12), min_size=1, max_size=4))
def test_quotas_add_up(sizes):
    rows = bank_quotas(sizes, SplitSpec())
    n = sum(sizes.values())
    by_stratum: dict = {}
    for _, train_stratum, train, val_stratum, val in rows:
        by_stratum[("train", train_stratum)] = train
        by_stratum[("val", val_stratum)] = val
    train = sum(v for (cut, _), v in by_stratum.items() if cut == "train")
    val = sum(v for (cut, _), v in by_stratum.items() if cut == "val")
    assert 0 <= train <= n and 0 <= val <= n - train
    assert abs(train - 0.7 * n) <= 1 + 1e-9 * n
    for label, train_stratum, quota, _, _ in rows:
        if train_stratum == label:
            assert abs(quota - train * sizes[label] / n) < 1 + 1e-3


def test_known_quotas():
    # 100 rows, 10 positives: 70 / 15 / 15 with 7 / 1 or 2 / the rest positives.
    assert bank_quotas({0: 90, 1: 10}, SplitSpec()) == [(0, 0, 63, 0, 14), (1, 1, 7, 1, 1)]
    # One positive cannot be stratified.
    assert bank_quotas({0: 20, 1: 1}, SplitSpec()) == [(0, -1, 14, -1, 3), (1, -1, 14, -1, 3)]
    # Three positives: train is stratified, but one positive is left for val and test.
    rows = bank_quotas({0: 39, 1: 3}, SplitSpec())
    assert [(r[1], r[3]) for r in rows] == [(0, -1), (1, -1)]


def ranked(df, spec):
    """The split by sorting every stratum in one place."""
    keyed = df.withColumn("key", order_key(df, spec.seed)).collect()
    out = {}
    for bank in {r["bank_id"] for r in keyed}:
        rows = sorted((r for r in keyed if r["bank_id"] == bank), key=lambda r: r["key"])
        sizes = Counter(int(r["is_sar"]) for r in rows)
        quotas = {q[0]: q[1:] for q in bank_quotas(dict(sizes), spec)}
        train, val = Counter(), Counter()
        for r in rows:
            train_stratum, train_quota, val_stratum, val_quota = quotas[int(r["is_sar"])]
            if train[train_stratum] < train_quota:
                train[train_stratum] += 1
                out[bank, r["acct_id"]] = "train"
            elif val[val_stratum] < val_quota:
                val[val_stratum] += 1
                out[bank, r["acct_id"]] = "val"
            else:
                out[bank, r["acct_id"]] = "test"
    return out


@pytest.mark.parametrize("positives", [0, 1, 3, 4, 40])
def test_cuts_give_the_ranked_split(spark, positives):
    rows = [(i, bank, i < positives) for bank in ("a", "b") for i in range(120 if bank == "a" else 33)]
    df = accounts(spark, rows)
    got = assignment(split_accounts(df))
    assert got == ranked(df, SplitSpec())
    held = [s for (bank, _), s in got.items() if bank == "a"]
    assert (held.count("train"), held.count("val"), held.count("test")) == (84, 18, 18)


def test_the_split_depends_on_the_seed_only(spark):
    df = accounts(spark, [(i, "a", i % 5 == 0) for i in range(200)])
    one = assignment(split_accounts(df))
    assert one == assignment(split_accounts(df.repartition(7)))
    assert one != assignment(split_accounts(df, SplitSpec(seed=7)))


def test_unlabelled_rows_are_dropped(spark):
    df = accounts(spark, [(i, "a", None if i < 5 else i % 2 == 0) for i in range(30)])
    assert split_accounts(df).count() == 25
    with pytest.raises(ValueError, match="no labelled"):
        split_accounts(df.where(F.col("is_sar").isNull()))


@pytest.mark.parametrize("shares", [(0.7, 0.2, 0.2), (1.0, 0.0, 0.0), (0.9, 0.2, -0.1)])
def test_bad_fractions(shares):
    with pytest.raises(ValueError):
        SplitSpec(*shares)


def test_repeated_ids_stay_together_only_when_rows_are_equal(spark):
    rows = [(1, "a", True)] * 2 + [(i, "a", i % 2 == 0) for i in range(2, 40)]
    got = split_accounts(accounts(spark, rows))
    assert got.count() == 40 and got.where("acct_id = 1").select("split").distinct().count() == 1
    # Twenty equal rows without an id are one tie; the other class is split as usual.
    equal = [(None, "a", False)] * 20 + [(i, "a", True) for i in range(20)]
    split = [r["split"] for r in split_accounts(accounts(spark, equal)).where("acct_id IS NULL").collect()]
    assert split == ["train"] * 20


def test_rows_without_an_id_are_told_apart_by_their_columns(spark):
    rows = [(None, "a", i % 2 == 0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "acct_id bigint, bank_id string, is_sar boolean, x double")
    got = {r["x"]: r["split"] for r in split_accounts(df).collect()}
    assert [list(got.values()).count(s) for s in ("train", "val", "test")] == [70, 15, 15]
    assert got == {r["x"]: r["split"] for r in split_accounts(df.repartition(3)).collect()}
