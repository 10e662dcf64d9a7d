"""Committed rounds, runs that go on, and what every round's evaluation says."""

from __future__ import annotations

import json
import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.evaluate import metric_bundle, model_table, score_models
from ledgerweave.plans import baseline, experiment, federated, rounds
from ledgerweave.plans.federated import _scorer, _vectors
from ledgerweave.plans.models import LogisticSGD
from ledgerweave.settings import FeatureSpec, TrainSpec
from ledgerweave.sources import tables

SPEC = FeatureSpec(cat_cols=("c",), num_cols=("x", "y"))
WIDTH = 5
SECRET = "s"
TRAINING = TrainSpec(alpha_grid=(1e-5, 10.0), rounds=6, patience=2, shards=2)


@pytest.fixture(scope="module")
def encoded(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        x, y = rng.normal(size=2)
        label = int(x - y + rng.normal() > 0.2)
        split = ("train", "train", "val", "test")[i % 4]
        rows.append((i, "a" if i % 3 else "b", split, label, [float(x), float(y)], [[None, 2, 3, 4][i % 4]]))
    schema = "acct_id bigint, bank_id string, split string, y int, num array<double>, cat array<int>"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def trained(encoded, spec=TRAINING, **given):
    return federated.train_federated(encoded, WIDTH, SECRET, SPEC, spec, **given)


@pytest.fixture(scope="module")
def unbroken(encoded):
    return trained(encoded)


def test_a_broken_run_goes_on_as_if_unbroken(spark, encoded, unbroken, tmp_path):
    path = str(tmp_path / "run")
    trained(encoded, replace(TRAINING, rounds=2), store=rounds.RoundStore(spark, path))
    assert rounds.RoundStore(spark, path).committed() == [1, 2]
    # Files that no commit names: a third round that was being written.
    tables.save_models(spark, f"{path}/rounds/3-cut", [("running", 1e-5, 3, {"coef": np.ones(1)}, {})])
    (tmp_path / "run/log/part-cut.json").write_text('{"alpha":1.0E-5,"round":3}\n')
    store = rounds.RoundStore(spark, path)
    run = trained(encoded, store=store)
    assert run.log == unbroken.log
    assert (run.best.alpha, run.best.round_id, run.best.loss) == (
        unbroken.best.alpha, unbroken.best.round_id, unbroken.best.loss,
    )
    for key, value in unbroken.best.params.items():
        assert (run.best.params[key] == value).all()
    alpha, round_id, params = store.best_model()
    assert (alpha, round_id) == (run.best.alpha, run.best.round_id)
    assert (params["coef"] == run.best.params["coef"]).all()
    lines = [json.loads(t) for f in Path(path, "log").glob("*.json") for t in f.read_text().splitlines()]
    order = lambda r: (r["round"], r["alpha"])
    assert sorted(lines, key=order) == sorted(run.log, key=order)


def test_a_finished_run_trains_no_more(spark, encoded, unbroken, tmp_path):
    path = str(tmp_path / "run")
    trained(encoded, store=rounds.RoundStore(spark, path))
    before = rounds.RoundStore(spark, path).committed()
    again = trained(encoded, store=rounds.RoundStore(spark, path))
    assert again.log == unbroken.log
    assert rounds.RoundStore(spark, path).committed() == before


def test_other_settings_are_refused(spark, encoded, tmp_path):
    store = rounds.RoundStore(spark, str(tmp_path / "run"))
    trained(encoded, replace(TRAINING, rounds=1), store=store)
    with pytest.raises(ValueError, match="other settings"):
        trained(encoded, replace(TRAINING, rounds=2, seed=7), store=store)


def test_an_empty_store_has_no_model(spark, tmp_path):
    store = rounds.RoundStore(spark, str(tmp_path / "none"))
    assert store.committed() == []
    with pytest.raises(FileNotFoundError):
        store.best_model()


def test_best_model_is_on_disk_after_each_round(spark, encoded, unbroken, tmp_path):
    store = rounds.RoundStore(spark, str(tmp_path / "run"))
    for n in (1, 2, 3):
        trained(encoded, replace(TRAINING, rounds=n), store=store)
        upto = [r for r in unbroken.log if r["round"] <= n]
        least = min(upto, key=lambda r: r["avg_val_wlogloss"])
        assert store.best_model()[:2] == (least["alpha"], least["round"])


def test_every_round_is_evaluated(spark, encoded, unbroken):
    run = trained(encoded, evaluate=True)
    pairs = {(r["alpha"], r["round"]) for r in run.log}
    assert {(r["alpha"], r["round"]) for r in run.evaluation} == pairs
    assert len(run.evaluation) == 10 * len(pairs)
    for line, plain in zip(run.log, unbroken.log):
        assert line["round"] == plain["round"]
        assert math.isclose(line["avg_val_wlogloss"], plain["avg_val_wlogloss"], rel_tol=1e-9)
    # One metric by hand: AP of the kept model, weighted by validation rows.
    val = encoded.where(F.col("split") == "val")
    models = [("m", b, _vectors(run.best.params)) for b in ("a", "b")]
    scored = score_models(val, model_table(spark, models), _scorer(LogisticSGD(), SPEC))
    banks = metric_bundle(scored, ["bank_id"]).collect()
    wanted = sum(r["ap"] * r["n"] for r in banks) / sum(r["n"] for r in banks)
    got = [
        r["value"]
        for r in run.evaluation
        if (r["alpha"], r["round"], r["metric"]) == (run.best.alpha, run.best.round_id, "global_val_ap")
    ]
    assert math.isclose(got[0], wanted, rel_tol=1e-9)


def test_an_undefined_metric_has_no_value(encoded):
    """Validation rows of one class only: no bank has an AUC, and the run goes on."""
    rows = encoded.where((F.col("split") != "val") | (F.col("y") == 0))
    run = trained(rows, replace(TRAINING, rounds=1), evaluate=True)
    values = {r["metric"]: r["value"] for r in run.evaluation if r["alpha"] == 1e-5}
    assert values["global_val_auc"] is None and values["local_val_auc"] is None
    assert values["global_val_wlogloss"] > 0 and values["global_val_ap"] == 0


def test_evaluation_survives_a_break(spark, encoded, tmp_path):
    whole = trained(encoded, evaluate=True)
    store = rounds.RoundStore(spark, str(tmp_path / "run"))
    trained(encoded, replace(TRAINING, rounds=2), store=store, evaluate=True)
    again = trained(encoded, store=store, evaluate=True)
    assert again.evaluation == whole.evaluation


def test_reports_refuse_a_model_of_another_width(encoded, unbroken):
    with pytest.raises(ValueError, match="shape"):
        experiment.federated_report(encoded, unbroken.best.params, SPEC, width=WIDTH + 1)
    local = baseline.train_local(encoded, WIDTH, SPEC, replace(TRAINING, rounds=1))
    with pytest.raises(ValueError, match="shape"):
        baseline.baseline_report(encoded, local, SPEC, width=WIDTH + 1)
    assert experiment.federated_report(encoded, unbroken.best.params, SPEC, width=WIDTH).count() == 2
