"""Federated training: local rounds, averaging, masked validation, early stopping.

The driver keeps one parameter vector per alpha and the metric log. Each round is one
map-only training job with its averaging, and one scoring job over the validation rows;
plans do not grow with the number of rounds because parameters come back as values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.averaging import fedavg, flatten_updates
from ledgerweave.operators.evaluate import (
    metric_bundle,
    model_table,
    score_models,
    score_shared,
    weighted_log_loss,
)
from ledgerweave.operators.secure import (
    mask_metrics,
    metric_fractions,
    secret_column,
    secure_mean,
)
from ledgerweave.plans.models import LogisticSGD, Params, ShardModel
from ledgerweave.plans.rounds import RoundStore, settings_text
from ledgerweave.plans.shards import ShardSet, bank_updates, place_shards, restore, train_shards
from ledgerweave.settings import FeatureSpec, TrainSpec

AVERAGED_METRICS = ("ap", "auc", "p", "r")


def _vectors(params: Params) -> dict[str, list[float]]:
    return {k: v.ravel().tolist() for k, v in params.items()}


def _scorer(model: ShardModel, features: FeatureSpec):
    return lambda param: model.score(param, features)


@dataclass
class Selected:
    """The model a run keeps, and where it came from."""

    alpha: float
    round_id: int
    loss: float | None
    params: Params


@dataclass
class FederatedRun:
    """The kept model, the metric log and, where asked for, what every round's evaluation
    found: (alpha, round, metric, value), a row per metric of the global and local models."""

    best: Selected
    log: list[dict] = field(default_factory=list)
    evaluation: list[dict] = field(default_factory=list)


def average_round(
    shards: ShardSet,
    model: ShardModel,
    states: Mapping[float, Params],
    round_id: int,
    width: int,
    spec: TrainSpec,
) -> dict[float, Params]:
    """Train every alpha's parameters on all shards and average over all of them. Both
    levels, shards of a bank and banks, weigh by rows, so one average does both."""
    updates = train_shards(shards, model, {(a, None): p for a, p in states.items()}, round_id, spec)
    flat = flatten_updates(updates, ["alpha", "bank_id", "shard"])
    merged = fedavg(flat, members=("bank_id", "shard"), run=("alpha",))
    return {alpha: p for (alpha,), p in restore(merged, model, width, ("alpha",)).items()}


def local_round(
    shards: ShardSet,
    model: ShardModel,
    states: Mapping[float, Params],
    round_id: int,
    width: int,
    spec: TrainSpec,
) -> tuple[dict[float, Params], dict[tuple[float, str], Params]]:
    """A round that also keeps every bank's own model: (averages by alpha, local models by
    alpha and bank). One training job; the banks' results are averaged on the driver, which
    has them for the evaluation."""
    updates = train_shards(shards, model, {(a, None): p for a, p in states.items()}, round_id, spec)
    local = restore(bank_updates(updates), model, width, ("alpha", "bank_id"))
    total = sum(shards.n_train.values())
    merged = {
        alpha: {
            key: sum(local[alpha, bank][key] * (n / total) for bank, n in shards.n_train.items())
            for key in model.initial(width)
        }
        for alpha in states
    }
    return merged, local


def _every_bank(table: DataFrame, models: Iterable, banks: Sequence[str]) -> DataFrame:
    """``table`` (model, bank_id, metrics) with a row for every model and bank; a bank that
    has no rows gets zero sums and undefined metrics."""
    spark = table.sparkSession
    pairs = [(m, b) for m in models for b in banks]
    kind = dict(table.dtypes)["model"]
    expected = spark.createDataFrame(pairs, f"model {kind}, bank_id string")
    zero = ["n", "pos", "wloss_sum", "w_sum"]
    return expected.join(table, ["model", "bank_id"], "left").fillna(0, zero)


def validation_losses(
    val: DataFrame,
    states: Mapping[float, Params],
    round_id: int,
    banks: Sequence[str],
    width: int,
    model: ShardModel,
    features: FeatureSpec,
    secret: Column,
    spec: TrainSpec,
) -> dict[float, float]:
    """alpha -> weighted validation loss over all banks, from masked sums only: each
    bank reports one masked record per alpha, and only the mean leaves Spark. A bank
    without validation rows reports zeros, so that the masks still cancel."""
    for params in states.values():
        model.check(params, width)
    vectors = {alpha: _vectors(p) for alpha, p in states.items()}
    scored = score_shared(val, vectors, _scorer(model, features), kind="double")
    losses = _every_bank(weighted_log_loss(scored, ["model", "bank_id"]), states, banks).withColumns(
        {"alpha": F.col("model"), "round": F.lit(round_id)}
    )
    fractions = metric_fractions(losses, (), F.lit("global"))
    means = secure_mean(mask_metrics(fractions, banks, secret, spec.mask_scale), banks).collect()
    if len(means) != len(states):
        raise RuntimeError("validation produced no report for some alpha")
    return {row["alpha"]: row["value"] for row in means}


def train_federated(
    encoded: DataFrame,
    width: int,
    secret: str,
    features: FeatureSpec | None = None,
    spec: TrainSpec | None = None,
    model: ShardModel | None = None,
    store: RoundStore | None = None,
    evaluate: bool = False,
) -> FederatedRun:
    """Run all alphas of the grid side by side and keep the best model over all rounds.

    Each round is committed to ``store``, with all parameters that are needed to go on; a
    run that finds committed rounds there goes on after the last one and ends like one that
    was never broken off. ``evaluate`` scores the global and all local models of a round in
    one pass over the validation rows, and the loss that decides is taken from it.

    Every alpha starts from the model's initial parameters and stops on its own after
    ``patience`` rounds without a lower loss; a finished alpha takes no further work.
    Ties go to the alpha earlier in the grid, then to the earlier round. ``encoded``
    should be a stored table.
    """
    features, spec = features or FeatureSpec(), spec or TrainSpec()
    model = model or LogisticSGD(spec.eta0, spec.intercept_decay)
    key = secret_column(encoded.sparkSession, secret)
    shards = place_shards(encoded, spec)
    val = encoded.where(F.col("split") == "val").persist(StorageLevel.MEMORY_AND_DISK)
    active = {alpha: model.initial(width) for alpha in spec.alpha_grid}
    best = {alpha: Selected(alpha, 0, math.inf, {}) for alpha in spec.alpha_grid}
    log: list[dict] = []
    evaluation: list[dict] = []
    done, settings = 0, settings_text(width, features, spec, model)
    progress = store.begin(settings) if store else None
    if progress:
        done, log, evaluation = progress.round_id, progress.log, progress.evaluation
        active = {a: progress.running[a] for a in spec.alpha_grid if a in progress.running}
        least = {line["alpha"]: line["best_loss"] for line in log}
        best |= {a: Selected(a, r, least[a], p) for a, (r, p) in progress.best.items()}
        store.rewind_log(log)
    try:
        for round_id in range(done + 1, spec.rounds + 1 if active else 0):
            if evaluate:
                active, local = local_round(shards, model, active, round_id, width, spec)
                records = evaluate_models(
                    val, active, local, round_id, shards.banks, width, model, features, key, spec
                )
                means = secure_mean(records, shards.banks, undefined="null")
                found = [r.asDict() for r in means.orderBy("alpha", "metric").collect()]
                evaluation += found
                losses = {r["alpha"]: r["value"] for r in found if r["metric"] == "global_val_wlogloss"}
            else:
                active = average_round(shards, model, active, round_id, width, spec)
                losses = validation_losses(
                    val, active, round_id, shards.banks, width, model, features, key, spec
                )
            for alpha in [a for a in spec.alpha_grid if a in active]:
                loss = losses[alpha]
                if loss < best[alpha].loss:
                    best[alpha] = Selected(alpha, round_id, loss, active[alpha])
                waited = round_id - best[alpha].round_id
                log.append(
                    {
                        "alpha": alpha,
                        "round": round_id,
                        "avg_val_wlogloss": loss,
                        "best_loss": best[alpha].loss,
                        "no_improve": waited,
                    }
                )
                if waited >= spec.patience:
                    del active[alpha]
            if store:
                kept = {a: (s.round_id, s.params) for a, s in best.items()}
                store.save(round_id, settings, active, kept, log, evaluation)
            if not active:
                break
    finally:
        shards.release()
        val.unpersist()
    chosen = min((best[a] for a in spec.alpha_grid), key=lambda s: s.loss)
    if not chosen.params:
        raise RuntimeError("no round produced a usable validation loss")
    return FederatedRun(chosen, log, evaluation)


def evaluate_models(
    val: DataFrame,
    states: Mapping[float, Params],
    local_params: Mapping[tuple[float, str], Params],
    round_id: int,
    banks: Sequence[str],
    width: int,
    model: ShardModel,
    features: FeatureSpec,
    secret: Column,
    spec: TrainSpec,
) -> DataFrame:
    """Masked records (bank_id, alpha, round, metric, num_masked, den_masked) of every
    alpha's global model and the banks' own: loss, AP, AUC, precision and recall of each.

    The models are a table that meets a bank's validation rows by bank, so all of them are
    scored in one pass, and one curve aggregation serves all."""
    spark = val.sparkSession
    for params in (*states.values(), *local_params.values()):
        model.check(params, width)
    models = [(f"global|{a!r}", b, _vectors(p)) for a, p in states.items() for b in banks]
    models += [(f"local|{a!r}", b, _vectors(p)) for (a, b), p in local_params.items()]
    scored = score_models(val, model_table(spark, models), _scorer(model, features))
    bundle = metric_bundle(scored, ["model", "bank_id"])
    name = F.split("model", r"\|")
    metrics = _every_bank(bundle, sorted({m for m, _, _ in models}), banks).withColumns(
        {"kind": name[0], "alpha": name[1].cast("double"), "round": F.lit(round_id)}
    )
    fractions = metric_fractions(metrics, AVERAGED_METRICS, F.col("kind"))
    return mask_metrics(fractions, banks, secret, spec.mask_scale)


def compare_round_one(
    encoded: DataFrame,
    width: int,
    alpha: float,
    secret: str,
    features: FeatureSpec | None = None,
    spec: TrainSpec | None = None,
    model: ShardModel | None = None,
) -> DataFrame:
    """First round only, from scratch: mean loss of the banks' own updates against the
    averaged model, both from masked sums. One row (round, alpha, local, global)."""
    features, spec = features or FeatureSpec(), spec or TrainSpec()
    model = model or LogisticSGD(spec.eta0, spec.intercept_decay)
    spark = encoded.sparkSession
    key = secret_column(spark, secret)
    shards = place_shards(encoded, spec)
    try:
        merged, local = local_round(shards, model, {alpha: model.initial(width)}, 1, width, spec)
    finally:
        shards.release()
    val = encoded.where(F.col("split") == "val")
    records = evaluate_models(val, merged, local, 1, shards.banks, width, model, features, key, spec)
    return (
        secure_mean(records, shards.banks)
        .groupBy("alpha", "round")
        .agg(
            *(
                F.max(F.when(F.col("metric") == f"{kind}_val_wlogloss", F.col("value"))).alias(
                    f"avg_{kind}_val_wlogloss"
                )
                for kind in ("local", "global")
            )
        )
    )
