from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerweave.sources.durable import durable, settled, shared_root


@pytest.fixture
def stored(spark):
    """Names of the tables stored since the test began, without their numbers."""
    root = Path(shared_root(spark))
    before = set(root.iterdir()) if root.exists() else set()
    return lambda: sorted(p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before)


def test_only_the_result_of_a_step_stays(spark, stored):
    def inner():
        halves = durable(spark.range(100).where("id % 2 = 0"), "halves")
        return halves.select((F.col("id") / 2).cast("long").alias("id"))

    def outer():
        first = settled(spark, "inner", inner)
        assert stored() == ["inner", "outside"]
        return first.union(durable(spark.range(3), "three"))

    outside = durable(spark.range(5), "outside")
    result = settled(spark, "outer", outer)
    assert stored() == ["outer", "outside"]
    assert result.count() == 53 and result.agg(F.max("id")).first()[0] == 49
    assert outside.count() == 5


def test_a_step_that_fails_leaves_nothing(spark, stored):
    def plan_fails():
        durable(spark.range(4), "four")
        raise ValueError("no")

    def job_fails():
        return durable(spark.range(4), "four").select(F.raise_error(F.lit("no")).cast("long").alias("id"))

    with pytest.raises(ValueError):
        settled(spark, "never", plan_fails)
    with pytest.raises(Exception, match="no"):
        settled(spark, "never", job_fails)
    assert stored() == []
    assert settled(spark, "after", lambda: spark.range(2)).count() == 2


def test_partitions_of_a_settled_table(spark, stored):
    rows = settled(spark, "parts", lambda: spark.range(6).withColumn("p", F.col("id") % 2), ("p",))
    assert rows.where("p = 1").count() == 3 and stored() == ["parts"]
