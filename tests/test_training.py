from __future__ import annotations

import hashlib
import math
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerweave.operators.averaging import fedavg
from ledgerweave.plans import baseline, experiment, federated, gradient, shards
from ledgerweave.plans.models import LogisticSGD, Shard, ShardModel
from ledgerweave.settings import FeatureSpec, TrainSpec

SPEC = FeatureSpec(cat_cols=("c",), num_cols=("x", "y"))
WIDTH = 5
SECRET = "s"
# A model of one's own must reach the executors; here it lives in this file only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def encoded(spark):
    """Two banks, an unknown category now and then, labels that follow the features."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x, y = rng.normal(size=2)
        cat = [None, 2, 3, 4][int(rng.integers(0, 4))]
        label = int(1.5 * x - y + (1.0 if cat == 3 else 0.0) + rng.normal() > 0.5)
        split = ("train", "train", "train", "val", "test")[i % 5]
        rows.append((i, "a" if i % 3 else "b", split, label, [float(x), float(y)], [cat]))
    df = spark.createDataFrame(
        rows,
        "acct_id bigint, bank_id string, split string, y int, num array<double>, cat array<int>",
    )
    return df.repartition(5).cache()


def plain_sgd(rows, params, alpha, order, eta=0.01, decay=0.01):
    """The training rule on dense vectors, as a reader would write it down."""
    w, b = params["coef"][0].copy(), float(params["intercept"][0])
    for i in order:
        _, x, label = rows[i]
        p = 1 / (1 + math.exp(-(w @ x + b)))
        w = (1 - eta * alpha) * w - eta * (p - label) * x
        b -= eta * (p - label) * decay
    return w, b


def dense_rows(encoded, bank, splits=("train",)):
    out = []
    for r in encoded.where(F.col("bank_id") == bank).where(F.col("split").isin(*splits)).collect():
        x = np.zeros(WIDTH)
        x[:2] = r["num"]
        if r["cat"][0] is not None:
            x[r["cat"][0]] = 1
        out.append((r["acct_id"], x, r["y"]))
    return sorted(out, key=lambda t: t[0])


def pass_order(rows, seed, round_id, epoch):
    keys = [hashlib.md5(f"{seed}:{round_id}:{epoch}:{r[0]}".encode()).hexdigest() for r in rows]
    return sorted(range(len(rows)), key=keys.__getitem__)


def test_one_shard_is_sequential_sgd(encoded):
    spec = TrainSpec(alpha_grid=(0.01,), local_epochs=2, shards=1)
    model = LogisticSGD()
    start = {"coef": np.array([[0.1, -0.2, 0.3, 0.0, 0.05]]), "intercept": np.array([0.2])}
    placed = shards.place_shards(encoded, spec)
    updates = shards.train_shards(placed, model, {(0.01, None): start}, 4, spec)
    got = shards.restore(shards.bank_updates(updates), model, WIDTH, ("alpha", "bank_id"))
    for bank in ("a", "b"):
        rows = dense_rows(encoded, bank)
        order = [i for epoch in (1, 2) for i in pass_order(rows, spec.seed, 4, epoch)]
        w, b = plain_sgd(rows, start, 0.01, order)
        assert got[0.01, bank]["coef"][0] == pytest.approx(w, abs=1e-12)
        assert got[0.01, bank]["intercept"][0] == pytest.approx(b, abs=1e-12)
    placed.release()


def test_alphas_and_batches_train_side_by_side(encoded):
    model, rng = LogisticSGD(), np.random.default_rng(4)
    rows = Shard(rng.normal(size=(90, 2)), rng.integers(-1, 3, (90, 1)) + 2, rng.integers(0, 2, 90))
    start = {"coef": rng.normal(size=(1, WIDTH)), "intercept": np.zeros(1)}
    state = model.begin([start, start], [0.5, 1e-3])
    for i in range(0, 90, 30):
        model.step(state, Shard(rows.num[i : i + 30], rows.cat[i : i + 30], rows.y[i : i + 30]))
    for got, alpha in zip(model.finish(state), (0.5, 1e-3)):
        alone = model.train(rows, start, alpha)
        assert all(np.allclose(got[k], alone[k], atol=1e-12) for k in start)


def test_a_pass_is_sequential_sgd_at_a_few_microseconds_a_row():
    """Rounds go over millions of rows one by one; a NumPy call for each product took
    over 50 microseconds a row where this takes 7."""
    rng, n = np.random.default_rng(8), 20_000
    rows = Shard(rng.normal(size=(n, 6)), rng.integers(6, 31, (n, 1)), rng.integers(0, 2, n))
    rows.cat[::50] = -1
    model, start = LogisticSGD(), {"coef": rng.normal(size=(1, 31)), "intercept": np.array([0.5])}
    spent = []
    for _ in range(3):
        began = time.process_time()
        state = model.begin([start, start], [0.5, 1e-3])
        model.step(state, rows)
        spent.append(time.process_time() - began)
    assert min(spent) / n < 25e-6
    dense = [(i, x, label) for i, (x, label) in enumerate(zip(rows.dense(31), rows.y))]
    for got, alpha in zip(model.finish(state), (0.5, 1e-3)):
        w, b = plain_sgd(dense, start, alpha, range(n))
        assert got["coef"][0] == pytest.approx(w, abs=1e-9)
        assert got["intercept"][0] == pytest.approx(b, abs=1e-9)


def test_accounts_without_an_id_are_spread_and_reproducible(spark):
    rows = [(None, "a", "train", i % 2, [float(i), 1.0], [2]) for i in range(200)]
    df = spark.createDataFrame(
        rows, "acct_id bigint, bank_id string, split string, y int, num array<double>, cat array<int>"
    )
    seen = []
    for frame in (df, df.repartition(3)):
        placed = shards.place_shards(frame, TrainSpec())
        sizes = [r["count"] for r in placed.rows.groupBy("shard").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 90
        merged = federated.average_round(
            placed, LogisticSGD(), {1e-5: LogisticSGD().initial(3)}, 1, 3, TrainSpec()
        )
        seen.append(merged[1e-5]["coef"])
        placed.release()
    assert np.allclose(*seen, atol=1e-12)


def test_a_bank_without_validation_rows_reports_zeros(encoded):
    part = encoded.where("NOT (bank_id = 'b' AND split = 'val')")
    spec = TrainSpec(rounds=3, alpha_grid=(1e-5,))
    run = federated.train_federated(part, WIDTH, SECRET, SPEC, spec)
    alone = federated.train_federated(
        encoded.where("NOT (bank_id = 'b' AND split = 'val')"), WIDTH, "other", SPEC, spec
    )
    assert 0 < run.best.loss < 1 and run.best.loss == pytest.approx(alone.best.loss, abs=1e-6)
    row = federated.compare_round_one(part, WIDTH, 1e-5, SECRET, SPEC).first()
    assert 0 < row["avg_local_val_wlogloss"] < 1
    local = baseline.train_local(part, WIDTH, SPEC, spec)
    assert local.best["b"].loss is None and local.best["b"].round_id == 1
    assert local.best["a"].loss is not None


def test_rounds_do_not_shuffle_the_rows_again(encoded):
    spec = TrainSpec()
    placed = shards.place_shards(encoded, spec)
    updates = shards.train_shards(placed, LogisticSGD(), {(1e-5, None): LogisticSGD().initial(WIDTH)}, 1, spec)
    updates.collect()
    plan = updates._jdf.queryExecution().executedPlan().toString()
    above_cache = plan.split("InMemoryTableScan")[0]
    assert "Exchange" not in above_cache and "InMemoryTableScan" in plan
    placed.release()


def test_banks_of_every_size_have_the_same_number_of_shards(encoded):
    spec = TrainSpec(shards=3)
    placed = shards.place_shards(encoded, spec)
    # 360 training rows: 240 of bank a, 120 of bank b.
    assert placed.count == 3 + 3 and placed.n_train == {"a": 240, "b": 120}
    sizes = placed.rows.groupBy("bank_id", "shard").count().collect()
    assert len(sizes) == 6 and sum(r["count"] for r in sizes) == 360
    model = LogisticSGD()
    updates = shards.train_shards(placed, model, {(1e-5, None): model.initial(WIDTH)}, 1, spec)
    per_shard = updates.where("key = 'coef'").collect()
    total = sum(r["n_train"] * np.array(r["values"]) for r in per_shard) / 360
    merged = federated.average_round(placed, model, {1e-5: model.initial(WIDTH)}, 1, WIDTH, spec)
    assert merged[1e-5]["coef"][0] == pytest.approx(total, abs=1e-12)
    placed.release()


def test_federated_training(encoded):
    spec = TrainSpec(alpha_grid=(1e-5, 0.5), rounds=6, patience=2)
    one = federated.train_federated(encoded, WIDTH, SECRET, SPEC, spec)
    losses = [r["avg_val_wlogloss"] for r in one.log if r["alpha"] == 1e-5]
    assert losses[-1] < losses[0] < 0.6931
    assert one.best.loss == min(r["avg_val_wlogloss"] for r in one.log)
    again = federated.train_federated(encoded.repartition(3), WIDTH, SECRET, SPEC, spec)
    assert [r["avg_val_wlogloss"] for r in again.log] == pytest.approx(
        [r["avg_val_wlogloss"] for r in one.log], abs=1e-9
    )
    alone = federated.train_federated(
        encoded, WIDTH, SECRET, SPEC, TrainSpec(alpha_grid=(0.5,), rounds=6, patience=2)
    )
    mine = [r["avg_val_wlogloss"] for r in one.log if r["alpha"] == 0.5]
    assert mine == pytest.approx([r["avg_val_wlogloss"] for r in alone.log], abs=1e-9)


class Backwards(ShardModel):
    """A model that gets worse every round; also a second kind of model to plug in."""

    def initial(self, width):
        return {"weights": np.zeros(width), "step": np.zeros(())}

    def begin(self, params, alphas):
        return [{k: v + 1.0 for k, v in p.items()} for p in params]

    def step(self, state, rows):
        assert len(rows)

    def finish(self, state):
        return state

    def score(self, param, spec):
        z = F.get(param("step"), F.lit(0)) - F.get(param("weights"), F.lit(0))
        distance = F.get(param("step"), F.lit(0))
        return F.lit(0.5) + z + F.when(F.col("y") == 1, -0.02 * distance).otherwise(0.02 * distance)


def test_other_models_plug_in_and_patience_stops_them(encoded):
    spec = TrainSpec(alpha_grid=(0.1, 0.2), rounds=10, patience=3)
    run = federated.train_federated(encoded, WIDTH, SECRET, SPEC, spec, Backwards())
    assert (run.best.alpha, run.best.round_id) == (0.1, 1)
    assert max(r["round"] for r in run.log) == 4
    assert run.best.params["step"].shape == () and float(run.best.params["step"]) == 1.0


def test_baseline(encoded):
    spec = TrainSpec(alpha_grid=(1e-5, 0.3), rounds=4)
    run = baseline.train_local(encoded, WIDTH, SPEC, spec)
    assert set(run.best) == {"a", "b"}
    for bank in ("a", "b"):
        mine = [r for r in run.log if r["bank_id"] == bank]
        assert run.best[bank].loss == min(r["val_wlogloss"] for r in mine)
    # A bank's baseline does not depend on the others.
    alone = baseline.train_local(encoded.where("bank_id = 'a'"), WIDTH, SPEC, spec)
    assert [r["val_wlogloss"] for r in alone.log] == pytest.approx(
        [r["val_wlogloss"] for r in run.log if r["bank_id"] == "a"], abs=1e-9
    )
    report = {r["bank_id"]: r for r in baseline.baseline_report(encoded, run, SPEC).collect()}
    assert report["a"]["val_wlogloss"] == pytest.approx(run.best["a"].loss, abs=1e-9)
    assert report["a"]["test_roc_auc"] > 0.7


def test_baseline_starts_from_one_step(encoded):
    model = LogisticSGD()
    first = baseline._first_rows(encoded, TrainSpec())["a"]
    assert len(first) == 1
    got = model.train(first, model.initial(WIDTH), 1e-5)
    g = 0.5 - first.y[0]
    assert got["coef"][0] == pytest.approx(-0.01 * g * first.dense(WIDTH)[0], abs=1e-15)
    assert got["intercept"][0] == pytest.approx(-0.01 * g * 0.01, abs=1e-15)


def test_round_one_comparison(encoded):
    row = federated.compare_round_one(encoded, WIDTH, 1e-5, SECRET, SPEC).first()
    run = federated.train_federated(encoded, WIDTH, SECRET, SPEC, TrainSpec(rounds=1))
    assert row["avg_global_val_wlogloss"] == pytest.approx(run.best.loss, abs=1e-9)
    assert 0 < row["avg_local_val_wlogloss"] < 1


def test_gradient_step(encoded):
    start = [0.3, -0.1, 0.2, 0.0, 0.4]
    updates = gradient.gradient_updates(
        encoded.where("split = 'train'"), start, 0.1, 0.05, 0.5, SPEC
    )
    got = {(r["bank_id"], r["key"], r["pos"]): r["value"] for r in updates.collect()}
    for bank in ("a", "b"):
        rows = dense_rows(encoded, bank)
        x = np.array([r[1] for r in rows])
        y = np.array([r[2] for r in rows])
        error = 1 / (1 + np.exp(-(x @ start + 0.1))) - y
        w = np.array(start) * (1 - 0.5 * 0.05) - 0.5 * (error @ x) / len(rows)
        assert [got[bank, "coef", i] for i in range(WIDTH)] == pytest.approx(w, abs=1e-9)
        assert got[bank, "intercept", 0] == pytest.approx(0.1 - 0.5 * error.mean(), abs=1e-9)
    assert fedavg(updates).count() == WIDTH + 1


def test_parameter_checks():
    model = LogisticSGD()
    good = model.initial(3)
    model.check(good, 3)
    with pytest.raises(KeyError):
        model.check({"coef": good["coef"]}, 3)
    with pytest.raises(ValueError):
        model.check({"coef": np.zeros((1, 2)), "intercept": np.zeros(1)}, 3)
    shard = Shard(np.zeros((1, 2)), np.array([[7]]), np.array([1]))
    with pytest.raises(ValueError):
        model.train(shard, good, 0.1)


def test_dense_and_sparse_intercepts_differ():
    rng = np.random.default_rng(1)
    shard = Shard(rng.normal(size=(300, 10)), np.full((300, 1), -1), rng.integers(0, 2, 300))
    start = LogisticSGD().initial(10)
    sparse = LogisticSGD(0.05, 0.01).train(shard, start, 1e-6)
    dense = LogisticSGD(0.05, 1.0).train(shard, start, 1e-6)
    assert not np.allclose(sparse["intercept"], dense["intercept"])
    assert not np.allclose(sparse["coef"], start["coef"])
    assert np.all(start["coef"] == 0)


@pytest.mark.parametrize(
    "bad", [{"alpha_grid": ()}, {"rounds": 0}, {"shards": 0}, {"splits": ("test",)}]
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        TrainSpec(**bad)


def test_training_on_train_and_val(encoded):
    placed = shards.place_shards(encoded, TrainSpec(splits=("train", "val")))
    assert sum(placed.n_train.values()) == 480
    placed.release()


def test_whole_study(inputs):
    spec = TrainSpec(alpha_grid=(1e-5,), rounds=2)
    study = experiment.run_study(inputs.prepared, SECRET, spec=spec)
    rows = study.comparison.collect()
    assert {r["bank_id"] for r in rows} == {"bank_l", "bank_m", "bank_s"}
    assert all(r["has_baseline"] and not r["split_differs"] for r in rows)
