from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerweave.operators import secure

SECRET = "one shared secret"


def reports(spark, banks, round_id=1, alpha=0.1, metric="loss"):
    rows = [(b, alpha, round_id, metric, 10.0 * (i + 1), 4.0 * (i + 1)) for i, b in enumerate(banks)]
    return spark.createDataFrame(
        rows, "bank_id string, alpha double, round int, metric string, num double, den double"
    )


def masked(spark, banks, **kw):
    return secure.mask_metrics(
        reports(spark, banks, **kw), banks, secure.secret_column(spark, SECRET)
    )


@pytest.mark.parametrize("banks", [["a"], ["a", "b"], ["a", "b", "c"], list("edcba")])
def test_masks_cancel(spark, banks):
    rows = masked(spark, banks).collect()
    plain = reports(spark, banks).agg(F.sum("num"), F.sum("den")).first()
    assert sum(r["num_masked"] for r in rows) == pytest.approx(plain[0], abs=1e-9)
    assert sum(r["den_masked"] for r in rows) == pytest.approx(plain[1], abs=1e-9)
    if len(banks) > 1:
        assert all(abs(r["num_masked"]) > 50 or abs(r["den_masked"]) > 50 for r in rows)
    value = secure.secure_mean(masked(spark, banks), banks).first()["value"]
    assert value == pytest.approx(2.5, abs=1e-9)


def test_mask_formula(spark):
    row = masked(spark, ["a", "b"]).where("bank_id = 'b'").first()
    digest = hashlib.sha256(f"{SECRET}|a|b|1|loss_num".encode()).hexdigest()
    u, v = ((int(digest[i : i + 13], 16) + 0.5) / 2**52 for i in (0, 13))
    mask = 1000 * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
    assert row["num_masked"] == pytest.approx(20.0 - mask, abs=1e-6)


def test_masks_differ_by_round_metric_and_part(spark):
    def mask(**kw):
        row = masked(spark, ["a", "b"], **kw).where("bank_id = 'a'").first()
        return row["num_masked"] - 10.0, row["den_masked"] - 4.0

    seen = {*mask(), *mask(round_id=2), *mask(metric="ap")}
    assert len({round(m, 6) for m in seen}) == 6
    assert mask() == mask(alpha=0.2)


def test_incomplete_reports_are_refused(spark):
    full = masked(spark, ["a", "b", "c"])
    with pytest.raises(PySparkException, match="without a report: c"):
        secure.secure_mean(full.where("bank_id <> 'c'"), ["a", "b", "c"]).collect()
    broken = full.withColumn("den_masked", F.when(F.col("bank_id") != "b", F.col("den_masked")))
    with pytest.raises(PySparkException, match="field missing"):
        secure.secure_mean(broken, ["a", "b", "c"]).collect()
    with pytest.raises(PySparkException, match="not positive"):
        secure.secure_mean(full.withColumn("den_masked", F.lit(-1.0)), ["a", "b", "c"]).collect()


def test_repeated_and_foreign_reports_do_not_count(spark):
    full = masked(spark, ["a", "b"])
    stranger = reports(spark, ["z"]).withColumnsRenamed({"num": "num_masked", "den": "den_masked"})
    more = full.unionByName(full).unionByName(stranger)
    assert secure.secure_mean(more, ["a", "b"]).first()["value"] == pytest.approx(2.5, abs=1e-9)


def test_alpha_filter(spark):
    rows = [(1, 0.1), (1, 0.1 + 1e-14), (1, None), (1, 0.2), (2, 0.1)]
    df = spark.createDataFrame(rows, "round int, alpha double")
    assert df.where(secure.in_run(1, 0.1)).count() == 3
    assert df.where(secure.in_run(1, None)).count() == 4


def test_secret_sources(monkeypatch):
    monkeypatch.delenv("FL_SECURE_AGG_KEY", raising=False)
    with pytest.raises(RuntimeError):
        secure.resolve_secret()
    with pytest.raises(RuntimeError):
        secure.resolve_secret("  ", simulation=True)
    assert secure.resolve_secret("s", simulation=True) == "s"
    monkeypatch.setenv("FL_SECURE_AGG_KEY", " from environment ")
    assert secure.resolve_secret("ignored") == "from environment"


def test_the_secret_is_not_in_any_plan(spark):
    df = masked(spark, ["a", "b", "c"])
    df.collect()
    assert SECRET not in df._jdf.queryExecution().toString()
    mean = secure.secure_mean(df, ["a", "b", "c"])
    mean.collect()
    assert SECRET not in mean._jdf.queryExecution().toString()
