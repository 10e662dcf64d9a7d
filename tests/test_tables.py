from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerweave.sources import durable as lineage
from ledgerweave.sources import tables
from ledgerweave.sources.durable import discard, durable, fresh_path


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [("007", 1, 1.5, "x,\"y\""), ("1e3", 2, None, "z"), ("b", 3, 2.5, None)],
        "bank_id string, acct_id int, amount double, note string",
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_by_bank(spark, rows, fmt):
    path = fresh_path(spark, "by-bank")
    tables.write_by_bank(rows, path, fmt)
    if fmt == "parquet":
        back = tables.read_by_bank(spark, path).select(*rows.columns)
        assert sorted(back.collect()) == sorted(rows.collect())
        one = tables.read_by_bank(spark, path, "007")
        assert one.count() == 1
        assert "PartitionFilters: [isnotnull(bank_id" in one._jdf.queryExecution().executedPlan().toString()
    else:
        back = tables.scan_csv(spark, path)
        assert {f.dataType.simpleString() for f in back.schema} == {"string"}
        got = sorted((r["bank_id"], r["acct_id"], r["note"]) for r in back.collect() if r["note"])
        assert got == [("007", "1", "x,\"y\""), ("1e3", "2", "z")]


def test_writing_a_bank_again_replaces_only_that_bank(spark, rows):
    path = fresh_path(spark, "replace")
    tables.write_by_bank(rows, path)
    tables.write_by_bank(rows.where("bank_id = 'b'").withColumn("acct_id", F.lit(9)), path)
    got = {r["bank_id"]: r["acct_id"] for r in tables.read_by_bank(spark, path).collect()}
    assert got == {"007": 1, "1e3": 2, "b": 9}
    with pytest.raises(PySparkException):
        tables.write_by_bank(rows, path, mode="errorifexists")
    with pytest.raises(ValueError):
        tables.write_by_bank(rows, path, mode="whatever")


def test_datasets_are_pinned_to_their_plan(spark, rows):
    path = fresh_path(spark, "pinned")
    encoded = rows.select("acct_id", "bank_id", F.lit("train").alias("split"), F.lit(1).alias("y"))
    tables.save_dataset(encoded, "12345678", path)
    assert tables.load_dataset(spark, path, "12345678").count() == 3
    with pytest.raises(ValueError, match="no dataset for plan"):
        tables.load_dataset(spark, path, "other")
    with pytest.raises(PySparkException):
        tables.save_dataset(encoded, "12345678", path)
    tables.save_dataset(encoded.limit(1), "other", path, mode="overwrite")
    assert tables.load_dataset(spark, path, "12345678").count() == 3
    unpinned = fresh_path(spark, "unpinned")
    rows.write.parquet(unpinned)
    with pytest.raises(ValueError, match="does not say"):
        tables.load_dataset(spark, unpinned, "12345678")


def test_parameters_round_trip(spark):
    path = fresh_path(spark, "params-test")
    small = {"coef": np.array([[1.0, -2.5, 1e-300]]), "intercept": np.array([0.1])}
    deep = {"layer.weight": np.arange(6.0).reshape(2, 3), "scalar": np.array(3.0)}
    tables.save_params(spark, path, "lr", small, alpha=1e-5, round_id=1, meta={"n": "7"})
    tables.save_params(spark, path, "lr", {k: v + 1 for k, v in small.items()}, alpha=1e-6, round_id=1)
    tables.save_params(spark, path, "deep", deep)
    back, meta = tables.load_params(spark, path, "lr", 1e-5, 1)
    assert meta == {"n": "7"}
    assert all(np.array_equal(back[k], small[k]) for k in small)
    other, none = tables.load_params(spark, path, "lr", 1e-6, 1)
    assert other["intercept"][0] == 1.1 and none == {}
    shaped, _ = tables.load_params(spark, path, "deep")
    assert shaped["layer.weight"].shape == (2, 3) and shaped["scalar"].shape == ()
    with pytest.raises(FileNotFoundError):
        tables.load_params(spark, path, "lr", 1e-5, 2)


def test_round_log_truncates_then_appends(spark):
    path = fresh_path(spark, "log-test")
    line = {"alpha": 1e-5, "round": 1, "loss": 0.5}
    tables.write_round_log(spark, [line], path)
    tables.write_round_log(spark, [line | {"round": 2}], path, "append")
    assert spark.read.json(path).count() == 2
    tables.write_round_log(spark, [line], path)
    assert spark.read.json(path).count() == 1


def test_summary_is_one_sorted_file(spark, rows):
    path = fresh_path(spark, "summary")
    tables.write_summary(rows, path)
    text = spark.read.text(path).collect()
    assert len(text) == 4
    assert [t["value"].split(",")[0] for t in text[1:]] == ["007", "1e3", "b"]


def test_durable_cuts_lineage_and_knows_its_size(spark, rows):
    stored = durable(rows.withColumn("twice", F.col("acct_id") * 2), "cut")
    plan = stored._jdf.queryExecution().optimizedPlan()
    assert "LogicalRDD" not in plan.toString() and stored.count() == 3
    assert plan.stats().sizeInBytes() < 1_000_000


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, _key, _default=None):
            return self.value

    class Session:
        def __init__(self, master, value):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})()

    assert lineage.shared_root(Session("spark://host:7077", "s3a://bucket/x/")) == "s3a://bucket/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_root(Session("yarn", None))
    assert lineage.shared_root(Session("local[2]", None)) == lineage.shared_root(Session("local[2]", None))


def test_stored_tables_can_be_discarded(spark, monkeypatch):
    monkeypatch.setattr(lineage, "_STORED", {})
    kept = durable(spark.range(5), "gone")
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.exists(path)
    assert discard(spark) == 1 and discard(spark) == 0
    assert not os.path.exists(path)
