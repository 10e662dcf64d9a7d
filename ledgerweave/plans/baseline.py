"""Per-bank baseline: the same training without any exchange between banks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.evaluate import (
    metric_bundle,
    model_table,
    score_models,
    test_report,
    weighted_log_loss,
)
from ledgerweave.operators.split import order_key
from ledgerweave.plans.federated import Selected, _scorer, _vectors
from ledgerweave.plans.models import LogisticSGD, Params, Shard, ShardModel
from ledgerweave.plans.shards import bank_updates, place_shards, restore, train_shards
from ledgerweave.settings import FeatureSpec, TrainSpec

# Fixed value: a loss must fall by more than this to count as an improvement.
IMPROVEMENT = 1e-12


@dataclass
class BaselineRun:
    best: dict[str, Selected]
    log: list[dict]


def _first_rows(encoded: DataFrame, spec: TrainSpec) -> dict[str, Shard]:
    """The first training row of each bank in split order: one row per bank."""
    training = encoded.where(F.col("split").isin(*spec.splits))
    plain = training.select("acct_id", "bank_id")
    first = training.groupBy("bank_id").agg(
        F.min_by(F.struct("num", "cat", "y"), order_key(plain, spec.seed)).alias("row")
    )
    out = {}
    for bank, row in first.collect():
        cat = [-1 if c is None else c for c in row["cat"]]
        out[bank] = Shard(np.array([row["num"]]), np.array([cat]), np.array([row["y"]]))
    return out


def train_local(
    encoded: DataFrame,
    width: int,
    features: FeatureSpec | None = None,
    spec: TrainSpec | None = None,
    model: ShardModel | None = None,
) -> BaselineRun:
    """Train every bank on its own rows; all banks and alphas advance in one job per
    round, and a (bank, alpha) that ran out of patience drops out.

    Unlike the federated run, a bank starts from one step on its first training row.
    The kept model has the lowest validation loss; ties go to the earlier alpha.
    """
    features, spec = features or FeatureSpec(), spec or TrainSpec()
    model = model or LogisticSGD(spec.eta0, spec.intercept_decay)
    shards = place_shards(encoded, spec)
    val = encoded.where(F.col("split") == "val").persist(StorageLevel.MEMORY_AND_DISK)
    spark = encoded.sparkSession
    log: list[dict] = []
    try:
        active: dict[tuple[float, str], Params] = {
            (alpha, bank): model.train(row, model.initial(width), alpha)
            for bank, row in sorted(_first_rows(encoded, spec).items())
            for alpha in spec.alpha_grid
        }
        best = {run: Selected(run[0], 0, math.inf, {}) for run in active}
        for round_id in range(1, spec.rounds + 1):
            updates = train_shards(shards, model, active, round_id, spec)
            active = restore(bank_updates(updates), model, width, ("alpha", "bank_id"))
            for params in active.values():
                model.check(params, width)
            models = model_table(
                spark, [(repr(alpha), bank, _vectors(p)) for (alpha, bank), p in active.items()]
            )
            scored = score_models(val, models, _scorer(model, features))
            losses = {
                (float(r["model"]), r["bank_id"]): r["wloss_sum"] / r["w_sum"]
                for r in weighted_log_loss(scored, ["model", "bank_id"]).collect()
            }
            for run in sorted(active):
                # A bank without validation rows has no loss: its first model is kept.
                loss = losses.get(run)
                if loss is None:
                    if not best[run].params:
                        best[run] = Selected(run[0], round_id, None, active[run])
                elif loss < best[run].loss - IMPROVEMENT:
                    best[run] = Selected(run[0], round_id, loss, active[run])
                waited = round_id - best[run].round_id
                log.append(
                    {
                        "bank_id": run[1],
                        "alpha": run[0],
                        "round": round_id,
                        "val_wlogloss": loss,
                        "no_improve": waited,
                    }
                )
                if waited >= spec.patience:
                    del active[run]
            if not active:
                break
    finally:
        shards.release()
        val.unpersist()
    chosen: dict[str, Selected] = {}
    for bank in shards.banks:
        candidates = [best[alpha, bank] for alpha in spec.alpha_grid]
        chosen[bank] = min(candidates, key=lambda s: math.inf if s.loss is None else s.loss)
        if not chosen[bank].params:
            raise RuntimeError(f"no round produced a usable loss for {bank}")
    return BaselineRun(chosen, log)


def baseline_report(
    encoded: DataFrame,
    run: BaselineRun,
    features: FeatureSpec | None = None,
    model: ShardModel | None = None,
    width: int | None = None,
) -> DataFrame:
    """One row per bank: the kept model, its validation and its test metrics. With
    ``width``, the number of features in the plan, a model of another width is refused."""
    features, model = features or FeatureSpec(), model or LogisticSGD()
    if width is not None:
        for kept in run.best.values():
            model.check(kept.params, width)
    spark = encoded.sparkSession
    kept = [
        (bank, s.alpha, s.round_id, s.loss)
        for bank, s in sorted(run.best.items())
    ]
    selected = spark.createDataFrame(
        kept,
        "bank_id string, selected_alpha double, selected_round int, val_wlogloss_best double",
    )
    models = model_table(spark, [("local", b, _vectors(s.params)) for b, s in run.best.items()])
    scored = score_models(encoded, models, _scorer(model, features))
    validated = metric_bundle(scored.where(F.col("split") == "val"), ["bank_id"]).select(
        "bank_id",
        F.col("n").alias("val_n"),
        F.col("pos").alias("val_pos"),
        F.col("ap").alias("val_ap"),
        F.when(F.col("w_sum") > 0, F.col("wloss_sum") / F.col("w_sum")).alias("val_wlogloss"),
    )
    return (
        selected.join(validated, "bank_id", "left")
        .join(test_report(scored, ["bank_id"]), "bank_id", "left")
    )
