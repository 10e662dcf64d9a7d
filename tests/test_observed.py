from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerweave.plans import experiment
from ledgerweave.sources import tables
from ledgerweave.sources.durable import fresh_path, shared_root


def names(spark):
    return {p.name for p in Path(shared_root(spark)).iterdir()}


def test_counts_are_taken_while_writing(inputs):
    rows, seen = experiment.observed_split(inputs.accounts, inputs.ledger, inputs.sar)
    assert seen["split"]["rows"] == seen["features"]["rows"] == inputs.accounts.count() == rows.count()
    assert seen["split"]["reported"] == seen["features"]["reported"] == rows.where("is_sar").count()
    assert seen["split"]["unassigned"] == 0
    experiment.require_whole(seen)


@pytest.mark.parametrize(
    ("change", "named"),
    [
        (lambda rows: rows.where(F.crc32(F.col("acct_id").cast("string")) % 5 > 0), "rows"),
        (lambda rows: rows.withColumn("split", F.when(F.col("split") != "val", F.col("split"))), "unassigned"),
        (lambda rows: rows.withColumn("is_sar", F.lit(False)), "reported"),
        (lambda rows: rows.withColumn("acct_id", F.lit(None).cast("long")), "without_id"),
    ],
)
def test_a_split_that_loses_something_is_refused(inputs, monkeypatch, change, named):
    whole = experiment.split_accounts
    monkeypatch.setattr(experiment, "split_accounts", lambda *args: change(whole(*args)))
    with pytest.raises(ValueError, match=named):
        experiment.prepare_split(inputs.accounts, inputs.ledger, inputs.sar)


def test_preparing_leaves_split_plan_and_encoded_rows_only(spark, inputs):
    before = names(spark)
    split = experiment.prepare_split(inputs.accounts, inputs.ledger, inputs.sar)
    prepared = experiment.prepare_encoded(split)
    left = sorted(name.rsplit("-", 1)[0] for name in names(spark) - before)
    assert left == ["encoded", "plan", "split"]
    assert prepared.encoded.count() == split.count() == inputs.accounts.count()


def test_documents_come_back_and_text_that_is_none_is_refused(spark):
    path = fresh_path(spark, "documents")
    rows = spark.createDataFrame([("007", [1, 2], None), ("b", [], "x")], "bank_id string, a array<int>, t string")
    tables.write_documents(rows, path)
    tables.write_documents(rows.where("bank_id = 'b'").withColumn("t", F.lit("y")), path)
    back = tables.read_documents(spark, path, "a array<int>, t string, later double")
    assert sorted((r["bank_id"], r["a"], r["t"], r["later"]) for r in back.collect()) == [
        ("007", [1, 2], None, None), ("b", [], "y", None),
    ]
    broken = fresh_path(spark, "broken")
    spark.createDataFrame([("{",)], "value string").write.text(f"{broken}/bank_id=b")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        tables.read_documents(spark, broken, "a array<int>").collect()


def test_a_summary_is_in_order(spark):
    path = fresh_path(spark, "summary")
    rows = spark.createDataFrame([(f"b{i:02}", i) for i in range(20)], "bank_id string, n int").repartition(7)
    tables.write_summary(rows, path)
    back = tables.read_summary(spark, path, "bank_id string, n int").collect()
    assert [(r["place"], r["bank_id"], r["n"]) for r in sorted(back)] == [(i + 1, f"b{i:02}", i) for i in range(20)]
