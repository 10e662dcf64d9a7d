from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerweave.operators import encode, statistics as stats
from ledgerweave.settings import FeatureSpec
from ledgerweave.sources import tables
from ledgerweave.sources.durable import fresh_path

SPEC = FeatureSpec(cat_cols=("home", "work"), num_cols=("x", "y", "w"))


def plan_of(spark, numeric, vocab):
    """A plan from given (mean, std) and vocabularies, via the statistics that imply it."""
    rows = [
        ("a", c, 2, 2.0 * m, (m - s) ** 2 + (m + s) ** 2) for c, (m, s) in numeric.items()
    ]
    n = spark.createDataFrame(rows, "bank_id string, col string, n bigint, sum double, sumsq double")
    v = spark.createDataFrame(
        [("a", c, x) for c, xs in vocab.items() for x in xs], "bank_id string, col string, value string"
    )
    return stats.feature_plan(n, v, SPEC)


@pytest.fixture
def plan(spark):
    return plan_of(
        spark,
        {"x": (10.0, 2.0), "y": (100.0, 50.0), "w": (120.0, 60.0)},
        {"home": ["NY", "CA"], "work": ["TX", "CA"]},
    )


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [
            (1, "a", "train", True, 10.0, 100.0, 120.0, "CA", "TX"),
            (2, "a", "train", False, 12.0, 150.0, 60.0, "TX", "WA"),
            (3, "a", "val", False, 8.0, 0.0, 120.0, None, "CA"),
        ],
        "acct_id bigint, bank_id string, split string, is_sar boolean, x double, y double, w double, "
        "home string, work string",
    )


def test_plan_order_and_names(plan):
    names = [r["name"] for r in plan.orderBy("idx").collect()]
    assert names == [
        "num__x",
        "num__y",
        "num__w",
        "cat__home_CA",
        "cat__home_NY",
        "cat__work_CA",
        "cat__work_TX",
    ]
    assert [r["idx"] for r in plan.orderBy("idx").collect()] == list(range(7))


def test_encoding(plan, rows):
    encoded = {r["acct_id"]: r for r in encode.encode(rows, plan, SPEC).collect()}
    assert encoded[1]["num"] == pytest.approx([0, 0, 0])
    assert encoded[1]["cat"] == [3, 6]
    assert encoded[2]["num"] == pytest.approx([1, 1, -1])
    # Values the plan does not know, and nulls, are all-zero blocks.
    assert encoded[2]["cat"] == [None, None]
    assert encoded[3]["cat"] == [None, 5]


def test_dense_and_sparse_forms_agree(plan, rows):
    encoded = encode.encode(rows, plan, SPEC)
    dense = {r["acct_id"]: r["x"] for r in encode.dense_vector(encoded, 7).collect()}
    for r in encode.nonzero_entries(encoded).collect():
        assert dense[r["acct_id"]][r["idx"]] == pytest.approx(r["value"])
    assert dense[2] == pytest.approx([1, 1, -1, 0, 0, 0, 0])
    assert dense[3] == pytest.approx([-1, -2, 0, 0, 0, 1, 0])
    hot = sorted((r["acct_id"], r["name"]) for r in encode.one_hot(rows, plan, SPEC).collect())
    assert hot == [(1, "cat__home_CA"), (1, "cat__work_TX"), (3, "cat__work_CA")]


def test_missing_numbers_are_an_error_or_the_mean(plan, rows):
    broken = rows.withColumn("x", F.when(F.col("acct_id") > 1, F.col("x")))
    with pytest.raises(PySparkException, match="missing or infinite value in feature x"):
        encode.encode(broken, plan, SPEC).collect()
    filled = encode.encode(broken, plan, SPEC, missing="mean")
    assert filled.where("acct_id = 1").first()["num"][0] == 0.0
    with pytest.raises(ValueError):
        encode.encode(rows, plan, SPEC, missing="guess")


def test_statistics_of_odd_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", "train", 1.0, 5.0, None, "p", None),
        ("a", "train", nan, 5.0, None, "q", None),
        ("a", "train", inf, 5.0, None, None, None),
        ("a", "val", 99.0, 99.0, 99.0, "z", "z"),
        ("b", "train", -inf, 5.0, 4.0, "p", "r"),
    ]
    df = spark.createDataFrame(
        rows, "bank_id string, split string, x double, y double, w double, home string, work string"
    )
    got = {(r["bank_id"], r["col"]): r for r in stats.numeric_stats(df, SPEC).collect()}
    assert (got["a", "x"]["n"], got["a", "x"]["sum"], got["a", "x"]["sumsq"]) == (1, 1.0, 1.0)
    assert (got["a", "w"]["n"], got["a", "w"]["sum"]) == (0, 0.0)
    final = {r["col"]: (r["mean"], r["std"]) for r in stats.finalise_numeric(stats.numeric_stats(df, SPEC)).collect()}
    assert final == {"x": (0.0, 1.0), "y": (5.0, 1.0), "w": (0.0, 1.0)}
    vocab = stats.category_vocab(df, SPEC)
    assert sorted((r["bank_id"], r["col"], r["value"]) for r in vocab.collect()) == [
        ("a", "home", "p"),
        ("a", "home", "q"),
        ("b", "home", "p"),
        ("b", "work", "r"),
    ]
    merged = stats.union_vocab(vocab)
    assert sorted((r["col"], r["value"], r["pos"]) for r in merged.collect()) == [
        ("home", "p", 0),
        ("home", "q", 1),
        ("work", "r", 0),
    ]


def test_merged_std_is_the_population_std(spark):
    xs = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame(
        [("ab"[i % 2], "train", x, x, x, "p", "p") for i, x in enumerate(xs)],
        "bank_id string, split string, x double, y double, w double, home string, work string",
    )
    row = stats.finalise_numeric(stats.numeric_stats(df, SPEC)).where("col = 'x'").first()
    mean = sum(xs) / 5
    assert row["mean"] == pytest.approx(mean)
    assert row["std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in xs) / 5))


def test_plan_survives_its_document(spark, plan):
    path = fresh_path(spark, "plan-test")
    tables.save_plan(plan, SPEC, path)
    back = tables.load_plan(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, plan.collect()), key=str)
    with pytest.raises(PySparkException):
        tables.save_plan(plan, SPEC, path)
    same = stats.plan_fingerprint(back, SPEC).first()["plan_hash"]
    assert same == stats.plan_fingerprint(plan, SPEC).first()["plan_hash"]
    moved = plan.withColumn("mean", F.col("mean") + 1e-3)
    assert stats.plan_fingerprint(moved, SPEC).first()["plan_hash"] != same


def test_positions_of_a_wide_vocabulary(spark):
    """A million values of one column are ranked in ranges, none of them by the column alone."""
    n = 1_000_000
    vocab = spark.range(n).select(
        F.concat(F.lit("b"), F.col("id") % 3).alias("bank_id"),
        F.lit("c").alias("col"),
        F.sha1(F.col("id").cast("string")).alias("value"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = stats.union_vocab(vocab)
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        ranks = [line for line in plan.splitlines() if "row_number" in line and "windowspec" in line]
        assert ranks and all("[col" in line and "range#" in line for line in ranks)
        ranked = placed.orderBy("value").select("value", "pos").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert ranked["pos"].tolist() == list(range(n))


def test_positions_of_several_columns(spark):
    rows = [(f"b{i % 2}", f"c{i % 5}", f"v{i * 7919 % 1000}") for i in range(3000)]
    vocab = spark.createDataFrame(rows, "bank_id string, col string, value string").repartition(4)
    wanted = {
        (c, v, k)
        for c in {r[1] for r in rows}
        for k, v in enumerate(sorted({r[2] for r in rows if r[1] == c}))
    }
    assert {tuple(r) for r in stats.union_vocab(vocab).collect()} == wanted


def test_fingerprint_is_the_root_of_ranges(spark, monkeypatch):
    spec = FeatureSpec(cat_cols=("c",), num_cols=("x",))
    rows = [(i, "cat", "c", f"v{i}", None, None, f"cat__c_v{i}") for i in range(100)]
    schema = "idx int, kind string, col string, value string, mean double, std double, name string"

    def root(some):
        return stats.plan_fingerprint(spark.createDataFrame(some, schema).repartition(3), spec).first()

    monkeypatch.setattr(stats, "DIGEST_RANGE", 4)
    whole = root(rows)
    assert whole["width"] == 100 and whole["plan_id"] == whole["plan_hash"][:8]
    assert root(rows[::-1]) == whole
    hashes = {whole["plan_hash"]}
    for k in (0, 3, 50, 99):
        changed = [r if r[0] != k else (*r[:3], "other", *r[4:]) for r in rows]
        hashes.add(root(changed)["plan_hash"])
    hashes.add(root(rows[:-1])["plan_hash"])
    assert len(hashes) == 6
