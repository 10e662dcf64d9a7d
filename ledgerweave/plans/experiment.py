"""The whole study, from cleaned tables to the comparison of both models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerweave.operators.compare import compare_models
from ledgerweave.operators.encode import encode
from ledgerweave.operators.evaluate import score_shared, test_report
from ledgerweave.operators.features import account_features
from ledgerweave.operators.split import split_accounts
from ledgerweave.operators.statistics import category_vocab, feature_plan, numeric_stats
from ledgerweave.plans.baseline import BaselineRun, baseline_report, train_local
from ledgerweave.plans.federated import FederatedRun, _scorer, _vectors, train_federated
from ledgerweave.plans.models import LogisticSGD, Params, ShardModel
from ledgerweave.settings import FeatureSpec, SplitSpec, TrainSpec
from ledgerweave.sources.durable import durable, settled


@dataclass
class Prepared:
    """Stored tables every later step reads: split features, plan, encoded rows."""

    split_rows: DataFrame
    plan: DataFrame
    encoded: DataFrame
    width: int


def _tally(*more: Column) -> list[Column]:
    rows = [F.count("*").alias("rows"), F.count_if(F.col("acct_id").isNull()).alias("without_id")]
    return [*rows, F.count_if(F.col("is_sar")).alias("reported"), *more]


def observed_split(
    accounts: DataFrame, ledger: DataFrame, sar: DataFrame, spec: SplitSpec | None = None
) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """The split, and what was counted of features and split while they were written, so no
    row is read for it again."""
    built, dealt = Observation("features"), Observation("split")

    def step() -> DataFrame:
        features = durable(account_features(accounts, ledger, sar).observe(built, *_tally()), "features")
        unassigned = F.count_if(F.col("split").isNull()).alias("unassigned")
        return split_accounts(features, spec).observe(dealt, *_tally(unassigned))

    rows = settled(accounts.sparkSession, "split", step)
    return rows, {"features": built.get, "split": dealt.get}


def require_whole(seen: dict[str, dict[str, int]]) -> None:
    """Raises where the split lost or made up rows or reports, or left a row without a part."""
    before, after = seen["features"], seen["split"]
    broken = {n: (before[n], after[n]) for n in before if before[n] != after[n]}
    if after["unassigned"]:
        broken["unassigned"] = (0, after["unassigned"])
    if broken:
        raise ValueError(f"the split differs from the features it was made of: {broken}")


def prepare_split(
    accounts: DataFrame, ledger: DataFrame, sar: DataFrame, spec: SplitSpec | None = None
) -> DataFrame:
    """Features of all accounts, split; refused unless every account came through."""
    rows, seen = observed_split(accounts, ledger, sar, spec)
    require_whole(seen)
    return rows


def prepare_encoded(
    split_rows: DataFrame, features: FeatureSpec | None = None, missing: str = "error"
) -> Prepared:
    """Train-only statistics of every bank, merged into a plan, applied to all rows."""
    features = features or FeatureSpec()
    spark = split_rows.sparkSession
    plan = settled(
        spark,
        "plan",
        lambda: feature_plan(
            numeric_stats(split_rows, features), category_vocab(split_rows, features), features
        ),
    )
    encoded = settled(spark, "encoded", lambda: encode(split_rows, plan, features, missing=missing))
    return Prepared(split_rows, plan, encoded, plan.count())


def federated_report(
    encoded: DataFrame,
    params: Params,
    features: FeatureSpec | None = None,
    model: ShardModel | None = None,
    width: int | None = None,
) -> DataFrame:
    """Test metrics per bank of a shared model, threshold from each bank's validation. With
    ``width``, the number of features in the plan, a model of another width is refused."""
    features, model = features or FeatureSpec(), model or LogisticSGD()
    if width is not None:
        model.check(params, width)
    held_out = encoded.where(F.col("split") != "train")
    scored = score_shared(held_out, {"federated": _vectors(params)}, _scorer(model, features))
    return test_report(scored, ["bank_id"])


@dataclass
class Study:
    federated: FederatedRun
    baseline: BaselineRun
    federated_test: DataFrame
    baseline_test: DataFrame
    comparison: DataFrame


def run_study(
    prepared: Prepared,
    secret: str,
    features: FeatureSpec | None = None,
    spec: TrainSpec | None = None,
    baseline_spec: TrainSpec | None = None,
    model: ShardModel | None = None,
) -> Study:
    """Train both sides on the same split and compare them on the test rows."""
    features, spec = features or FeatureSpec(), spec or TrainSpec()
    federated = train_federated(prepared.encoded, prepared.width, secret, features, spec, model)
    local = train_local(prepared.encoded, prepared.width, features, baseline_spec or spec, model)
    ours = federated_report(prepared.encoded, federated.best.params, features, model, prepared.width)
    theirs = baseline_report(prepared.encoded, local, features, model, prepared.width)
    return Study(federated, local, ours, theirs, compare_models(ours, theirs))
