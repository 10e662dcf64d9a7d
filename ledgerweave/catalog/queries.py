"""Every operator as a query over whole tables: name -> (spark, sf_dir) -> DataFrame.

Queries are lazy where the operator is; those that store an intermediate table (split,
plan, encoded rows) do so through ``durable``. Floats built from logarithms or long sums
are rounded at the end, for comparison with another engine only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.catalog import fixed_models as fixed
from ledgerweave.functions.coerce import as_id, as_number, as_utc
from ledgerweave.operators import averaging, compare, encode, evaluate, features, ledger, secure, split
from ledgerweave.operators import statistics as stats
from ledgerweave.plans import baseline, experiment, federated, gradient, rounds, shards
from ledgerweave.plans.models import LogisticSGD
from ledgerweave.settings import FeatureSpec, SplitSpec, TrainSpec
from ledgerweave.sources import tables, testdata
from ledgerweave.sources.durable import durable, fresh_path

Query = Callable[[SparkSession, str], DataFrame]
BUILDERS: dict[str, Callable[[Inputs], DataFrame]] = {}
QUERIES: dict[str, Query] = {}

BANKS = ("bank_l", "bank_m", "bank_s")
SECRET = "shared test secret"
MASK_ROUND = 3
SPEC = FeatureSpec()
MODEL = LogisticSGD()
TRAINING = TrainSpec(alpha_grid=(1e-5, 1e-3))
GRADIENT_STEP = 0.5


class Inputs:
    """Tables derived from one scale-factor directory, each built when first asked for
    and kept for the one query that asked."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def accounts(self) -> DataFrame:
        return ledger.clean_accounts(testdata.accounts(self.spark, self.sf_dir))

    @cached_property
    def ledger(self) -> DataFrame:
        rows = testdata.table(self.spark, self.sf_dir, "lineitem").count()
        return ledger.clean_transactions(testdata.transactions(self.spark, self.sf_dir, rows), rows)

    @cached_property
    def stored_ledger(self) -> DataFrame:
        return durable(self.ledger, "ledger")

    @cached_property
    def events(self) -> DataFrame:
        rows = testdata.table(self.spark, self.sf_dir, "events").count()
        return ledger.clean_transactions(testdata.event_transactions(self.spark, self.sf_dir), rows)

    @cached_property
    def sar(self) -> DataFrame:
        return ledger.clean_sar(testdata.sar_accounts(self.spark, self.sf_dir))

    @cached_property
    def features(self) -> DataFrame:
        return features.account_features(self.accounts, self.ledger, self.sar)

    @cached_property
    def split(self) -> DataFrame:
        return experiment.prepare_split(self.accounts, self.ledger, self.sar, SplitSpec())

    @cached_property
    def prepared(self) -> experiment.Prepared:
        return experiment.prepare_encoded(self.split, SPEC)

    @cached_property
    def shared_scores(self) -> DataFrame:
        return evaluate.score_shared(
            self.prepared.encoded, {"global": fixed.shared_params(self.prepared.width)}, self.scorer, width=self.prepared.width
        )

    @cached_property
    def both_scores(self) -> DataFrame:
        width = self.prepared.width
        models = [("global", b, fixed.shared_params(width)) for b in BANKS]
        models += [("local", b, fixed.local_params(b, width)) for b in BANKS]
        return evaluate.score_models(
            self.prepared.encoded, evaluate.model_table(self.spark, models), self.scorer, width=width
        )

    @property
    def scorer(self) -> evaluate.Scorer:
        return lambda param: MODEL.score(param, SPEC)

    @property
    def secret(self) -> Column:
        return secure.secret_column(self.spark, SECRET)


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Registers ``build`` under its own name."""
    BUILDERS[build.__name__] = build
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    return build


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _significant(df: DataFrame, *names: str) -> DataFrame:
    """Nine significant decimals after the first, for sums of any magnitude."""
    return df.withColumns(
        {n: F.when(F.col(n).isNotNull(), F.format_string("%.9e", n)).cast("double") for n in names}
    )


def _clock(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- sources and sinks ----------------------------------------------------------


@query
def scan_csv(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "csv")
    testdata.transactions(i.spark, i.sf_dir).write.option("header", True).csv(path)
    back = ledger.clean_transactions(tables.scan_csv(i.spark, path))
    return back.withColumns(
        {"tran_id": F.col("tran_id").cast("bigint"), "tran_timestamp": _clock("tran_timestamp")}
    )


@query
def sink_views(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "views")
    tables.write_by_bank(ledger.bank_views(i.stored_ledger, i.accounts), path, "csv")
    back = tables.scan_csv(i.spark, path)
    return back.groupBy("bank_id", F.col("internal").cast("boolean").alias("internal")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("base_amt").cast("decimal(18,2)")).cast("double").alias("amount"),
    )


@query
def sink_features(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "features")
    tables.write_by_bank(i.features, path)
    return tables.read_by_bank(i.spark, path)


@query
def scan_features(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "features")
    tables.write_by_bank(i.features, path)
    return tables.read_by_bank(i.spark, path, "bank_m").select(
        "acct_id", "bank_id", "state", "is_sar", "out_cnt", "in_cnt", "net_flow"
    )


@query
def round_metrics(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "log")
    log = [r.asDict() for r in _loss_path(i).collect()]
    for n, alpha in enumerate(fixed.PATH_ALPHAS):
        rows = [r for r in log if r["alpha"] == alpha]
        tables.write_round_log(i.spark, rows, path, "append" if n else "overwrite")
    return _rounded(i.spark.read.json(path).select("alpha", "round", "loss"), "loss")


@query
def params_roundtrip(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "params")
    width = i.prepared.width
    merged = _averaged_gradient(i).withColumn("alpha", F.lit(0.0))
    params = shards.restore(merged, MODEL, width, ("alpha",))[(0.0,)]
    tables.save_params(i.spark, path, "global", params, 0.0, 1, {"rounds": "1"})
    back, meta = tables.load_params(i.spark, path, "global", 0.0, 1)
    MODEL.check(back, width)
    rows = [
        (key, pos, float(v), meta["rounds"])
        for key, array in back.items()
        for pos, v in enumerate(array.ravel())
    ]
    table = i.spark.createDataFrame(rows, "key string, pos int, value double, rounds string")
    return _rounded(table, "value", digits=9)


@query
def plan_roundtrip(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "plan")
    tables.save_plan(i.prepared.plan, SPEC, path)
    return _significant(tables.load_plan(i.spark, path), "mean", "std")


@query
def dataset_guard(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "dataset")
    digest = stats.plan_fingerprint(i.prepared.plan, SPEC).first()["plan_hash"]
    tables.save_dataset(i.prepared.encoded, digest, path)
    dataset = tables.load_dataset(i.spark, path, digest)
    return tables.dataset_meta(dataset, i.prepared.width, SPEC.version).drop("plan_hash")


@query
def write_modes(i: Inputs) -> DataFrame:
    """Rows left behind by replacing, by adding, and by a refused second write."""
    rows = i.sar
    path = fresh_path(i.spark, "modes")

    def stored() -> int:
        return i.spark.read.parquet(path).count()

    outcome = []
    for mode in ("overwrite", "overwrite", "append"):
        rows.write.mode(mode).parquet(path)
        outcome.append((f"{len(outcome) + 1} {mode}", stored(), False))
    try:
        rows.write.mode("errorifexists").parquet(path)
        refused = False
    except PySparkException:
        refused = True
    outcome.append((f"{len(outcome) + 1} errorifexists", stored(), refused))
    return i.spark.createDataFrame(outcome, "step string, stored bigint, refused boolean")


@query
def sink_modes(i: Inputs) -> DataFrame:
    """Rows that the sink by bank leaves behind: all banks, one bank replaced by half of its
    accounts, all banks added, and a refused second write."""
    path = fresh_path(i.spark, "sink-modes")
    half = i.accounts.where((F.col("bank_id") == "bank_s") & (F.col("acct_id") % 2 == 0))
    steps = [("overwrite", i.accounts), ("overwrite", half), ("append", i.accounts), ("errorifexists", half)]
    outcome = []
    for number, (mode, rows) in enumerate(steps, 1):
        try:
            tables.write_by_bank(rows, path, mode=mode)
            refused = False
        except PySparkException:
            refused = True
        stored = {r["bank_id"]: r["count"] for r in tables.read_by_bank(i.spark, path).groupBy("bank_id").count().collect()}
        outcome += [(f"{number} {mode}", bank, n, refused) for bank, n in stored.items()]
    return i.spark.createDataFrame(outcome, "step string, bank_id string, stored bigint, refused boolean")


@query
def dataset_refusals(i: Inputs) -> DataFrame:
    """Rows that a dataset yields to its own plan, and what it says to others."""
    rows = i.accounts.withColumn("split", F.lit("train"))
    pinned, loose = fresh_path(i.spark, "pinned"), fresh_path(i.spark, "loose")
    tables.save_dataset(rows, "one", pinned)
    tables.write_by_bank(rows, loose)
    outcome = []
    for case, path, digest in (
        ("own plan", pinned, "one"),
        ("other plan", pinned, "two"),
        ("plan not stated", loose, "one"),
    ):
        try:
            outcome.append((case, tables.load_dataset(i.spark, path, digest).count(), "none"))
        except ValueError as refused:
            outcome.append((case, 0, str(refused).replace(path, "dataset")))
    return i.spark.createDataFrame(outcome, "case string, loaded bigint, refusal string")


@query
def stats_documents(i: Inputs) -> DataFrame:
    """Statistics of each bank written as one JSON document and read again."""
    path = fresh_path(i.spark, "stats")
    entry = F.struct("col", "n", "sum", "sumsq")
    documents = stats.numeric_stats(i.split, SPEC).groupBy("bank_id").agg(
        F.array_sort(F.collect_list(entry)).alias("stats")
    )
    tables.write_documents(documents, path)
    back = tables.read_documents(
        i.spark, path, "stats array<struct<col: string, n: bigint, sum: double, sumsq: double>>"
    )
    return _significant(back.select("bank_id", F.inline("stats")), "sum", "sumsq")


@query
def summary_csv(i: Inputs) -> DataFrame:
    """The summary of all banks as stored, with the place of each row in the file."""
    path = fresh_path(i.spark, "summary")
    tables.write_summary(ledger.bank_overview(i.accounts, i.ledger, i.sar), path)
    back = tables.read_summary(
        i.spark,
        path,
        "bank_id string, accounts bigint, sar_yes bigint, tx_total bigint, tx_internal bigint, "
        "tx_cross bigint, sar_rate double, tx_per_acct double, cross_ratio double",
    )
    return _rounded(back, "sar_rate", "tx_per_acct", "cross_ratio")


@query
def split_observed(i: Inputs) -> DataFrame:
    """What was counted while features and split were written."""
    _, seen = experiment.observed_split(i.accounts, i.ledger, i.sar, SplitSpec())
    experiment.require_whole(seen)
    counted = [(table, name, n) for table, counts in seen.items() for name, n in counts.items()]
    return i.spark.createDataFrame(counted, "observed string, counted string, n bigint")


# --- projections and filters ------------------------------------------------------


@query
def project_accounts(i: Inputs) -> DataFrame:
    return i.accounts.select("acct_id", "initial_deposit", "state")


def _untidy(i: Inputs) -> DataFrame:
    """Ledger keys and amounts as the text a careless export would hold."""
    key = F.col("l_orderkey").cast("string")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    day = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("l_linenumber")
    return testdata.table(i.spark, i.sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(kind == 1, F.concat(F.lit(" "), key, F.lit(" ")))
        .when(kind == 2, F.concat(key, F.lit(".0")))
        .when(kind == 3, F.concat(key, F.lit(".5")))
        .when(kind == 4, F.concat(F.lit("x"), key))
        .when(kind == 5, F.lit(""))
        .otherwise(key)
        .alias("id_text"),
        F.when(kind == 1, F.lit("NaN"))
        .when(kind == 2, F.concat(price, F.lit(" USD")))
        .when(kind == 3, F.lit(None).cast("string"))
        .otherwise(price)
        .alias("amount_text"),
        F.when(kind == 1, F.lit("not a time"))
        .when(kind == 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(kind == 3, F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T05:30:00+02:00")))
        .otherwise(day)
        .alias("time_text"),
    )


@query
def coerce_numeric(i: Inputs) -> DataFrame:
    rows = _untidy(i)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        as_id(rows, "id_text").alias("id"),
        as_number(rows, "amount_text").alias("amount"),
    )


@query
def coerce_timestamp(i: Inputs) -> DataFrame:
    rows = _untidy(i)
    parsed = rows.select("l_orderkey", "l_linenumber", as_utc(rows, "time_text").alias("at"))
    return parsed.withColumn("at", _clock("at"))


@query
def bank_accounts(i: Inputs) -> DataFrame:
    return ledger.bank_accounts(i.accounts, "bank_s")


@query
def sar_confirmed(i: Inputs) -> DataFrame:
    return ledger.confirmed_sar(i.sar).select("acct_id")


@query
def trainval(i: Inputs) -> DataFrame:
    return split.train_and_val(i.split).select("acct_id", "bank_id", "split")


# --- ledger -------------------------------------------------------------------------


@query
def dedupe_tx(i: Inputs) -> DataFrame:
    kept = ledger.drop_repeats(testdata.repeated_transactions(i.spark, i.sf_dir))
    return kept.withColumns(
        {"base_amt": F.col("base_amt").cast("double"), "tran_timestamp": _clock("tran_timestamp")}
    )


@query
def sar_label(i: Inputs) -> DataFrame:
    return ledger.label_accounts(i.accounts, i.sar).select("acct_id", "bank_id", "is_sar")


@query
def bank_view_tx(i: Inputs) -> DataFrame:
    return ledger.bank_views(i.stored_ledger, i.accounts).select(
        "bank_id",
        "tran_id",
        "orig_acct",
        "bene_acct",
        F.col("base_amt").cast("double").alias("base_amt"),
        "internal",
    )


@query
def tx_mix(i: Inputs) -> DataFrame:
    return _rounded(ledger.transfer_mix(i.ledger, i.accounts), "internal_share", "cross_share")


@query
def bank_sar(i: Inputs) -> DataFrame:
    return ledger.bank_sar(i.sar, i.accounts)


@query
def bank_overview(i: Inputs) -> DataFrame:
    table = ledger.bank_overview(i.accounts, i.ledger, i.sar)
    return _rounded(table, "sar_rate", "tx_per_acct", "cross_ratio")


@query
def integrity_checks(i: Inputs) -> DataFrame:
    """The event ledger reaches beyond the accounts of the smallest tables, so the checks
    have something to find there."""
    built = features.account_features(i.accounts, i.events, i.sar)
    return ledger.integrity_checks(
        ledger.bank_accounts(i.accounts, "bank_l"), i.events, i.sar, built
    )


# --- features -------------------------------------------------------------------------


@query
def account_features(i: Inputs) -> DataFrame:
    return i.features


@query
def event_features(i: Inputs) -> DataFrame:
    """The same features where transfers have a time of day."""
    return features.account_features(i.accounts, i.events, i.sar)


@query
def out_features(i: Inputs) -> DataFrame:
    return features.out_features(i.ledger)


@query
def in_features(i: Inputs) -> DataFrame:
    return features.in_features(i.ledger)


@query
def daily_activity(i: Inputs) -> DataFrame:
    daily = features.daily_activity(i.events)
    return _day(daily).withColumn("daily_sum", F.col("daily_sum").cast("double"))


@query
def burst_features(i: Inputs) -> DataFrame:
    peaks = features.burst_features(features.daily_activity(i.events))
    return peaks.withColumns(
        {c: F.col(c).cast("double") for c in ("out_max_daily_sum", "in_max_daily_sum")}
    )


# --- split and statistics ----------------------------------------------------------------


@query
def split_assign(i: Inputs) -> DataFrame:
    return i.split.select("acct_id", "bank_id", "is_sar", "split")


@query
def split_by_cuts(i: Inputs) -> DataFrame:
    """The same split from features that were stored once more."""
    stored = durable(i.features, "features")
    return split.split_accounts(stored, SplitSpec()).select(
        "acct_id", "bank_id", "is_sar", "split"
    )


@query
def split_counts(i: Inputs) -> DataFrame:
    return split.split_counts(i.split)


@query
def category_vocab(i: Inputs) -> DataFrame:
    return stats.category_vocab(i.split, SPEC)


@query
def numeric_stats(i: Inputs) -> DataFrame:
    return _significant(stats.numeric_stats(i.split, SPEC), "sum", "sumsq")


@query
def global_numeric(i: Inputs) -> DataFrame:
    table = stats.finalise_numeric(stats.numeric_stats(i.split, SPEC))
    return _significant(table, "mean", "std")


@query
def global_vocab(i: Inputs) -> DataFrame:
    return stats.union_vocab(stats.category_vocab(i.split, SPEC))


@query
def feature_names(i: Inputs) -> DataFrame:
    return i.prepared.plan.select("idx", "name")


@query
def plan_hash(i: Inputs) -> DataFrame:
    return stats.plan_fingerprint(i.prepared.plan, SPEC)


# --- encoding ---------------------------------------------------------------------------


@query
def standardize(i: Inputs) -> DataFrame:
    z = encode.standardize(i.split, i.prepared.plan, SPEC)
    names = [f"z_{c}" for c in SPEC.num_cols]
    return _rounded(z.select("acct_id", "bank_id", *names), *names)


@query
def one_hot(i: Inputs) -> DataFrame:
    return encode.one_hot(i.split, i.prepared.plan, SPEC).select("acct_id", "bank_id", "name")


@query
def encode_long(i: Inputs) -> DataFrame:
    return _rounded(encode.nonzero_entries(i.prepared.encoded), "value")


@query
def local_encode(i: Inputs) -> DataFrame:
    keys = ("bank_id", "col")
    numeric = stats.finalise_numeric(stats.numeric_stats(i.split, SPEC), keys)
    vocab = stats.union_vocab(stats.category_vocab(i.split, SPEC), keys)
    return _rounded(encode.local_encode(i.split, numeric, vocab, SPEC), "value")


# --- scores and metrics -----------------------------------------------------------------


@query
def predict_scores(i: Inputs) -> DataFrame:
    scored = i.shared_scores.select("acct_id", "bank_id", "split", "y", "p")
    return _rounded(scored, "p")


@query
def class_weights(i: Inputs) -> DataFrame:
    table = evaluate.class_weights(i.prepared.encoded, ["bank_id", "split"])
    return _rounded(table, "w_pos", "w_neg")


@query
def weighted_logloss(i: Inputs) -> DataFrame:
    table = evaluate.weighted_log_loss(i.shared_scores, ["bank_id", "split"])
    return _rounded(table, "wloss_sum", "w_sum")


@query
def pr_curve(i: Inputs) -> DataFrame:
    curve = evaluate.precision_recall_curve(i.shared_scores, ["bank_id", "split"])
    kept = curve.select("bank_id", "split", "p", "pos", "neg", "tp", "fp", "n_pos", "n_neg")
    return _rounded(kept, "p", digits=9)


def _curve_metric(i: Inputs, name: str, metric: Column) -> DataFrame:
    curve = evaluate.precision_recall_curve(i.both_scores, ["model", "bank_id", "split"])
    return _rounded(curve.groupBy("model", "bank_id", "split").agg(metric.alias(name)), name)


@query
def average_precision(i: Inputs) -> DataFrame:
    return _curve_metric(i, "ap", evaluate.average_precision())


@query
def roc_auc(i: Inputs) -> DataFrame:
    return _curve_metric(i, "auc", evaluate.roc_auc())


@query
def best_f1_threshold(i: Inputs) -> DataFrame:
    curve = evaluate.precision_recall_curve(i.both_scores, ["model", "bank_id", "split"])
    best = (
        evaluate.with_threshold_rates(curve)
        .groupBy("model", "bank_id", "split")
        .agg(evaluate.best_f1().alias("best"))
        .select("model", "bank_id", "split", "best.*")
    )
    return _rounded(best, "thr", "precision", "recall", "f1")


@query
def confusion_at_threshold(i: Inputs) -> DataFrame:
    table = evaluate.confusion_at(i.both_scores, ["model", "bank_id", "split"], F.lit(0.5))
    return _rounded(table, "precision", "recall", "f1")


def _val_metrics(i: Inputs) -> DataFrame:
    val = i.both_scores.where(F.col("split") == "val")
    return evaluate.metric_bundle(val, ["model", "bank_id"])


@query
def val_metrics(i: Inputs) -> DataFrame:
    return _rounded(
        _val_metrics(i), "ap", "auc", "thr", "p", "r", "f1", "wloss_sum", "w_sum"
    )


@query
def weighted_metric_mean(i: Inputs) -> DataFrame:
    names = federated.AVERAGED_METRICS
    return _rounded(evaluate.weighted_mean(_val_metrics(i), names, ["model"]), *names)


def _test_report(i: Inputs, model: str) -> DataFrame:
    return evaluate.test_report(i.both_scores.where(F.col("model") == model), ["bank_id"])


TEST_COLUMNS = (
    "val_threshold",
    "val_p",
    "val_r",
    "val_f1",
    "test_ap",
    "test_roc_auc",
    "test_p",
    "test_r",
    "test_f1",
    "test_wlogloss",
)


@query
def test_report(i: Inputs) -> DataFrame:
    table = evaluate.test_report(i.both_scores, ["model", "bank_id"])
    return _rounded(table, *TEST_COLUMNS)


def _comparison(i: Inputs) -> DataFrame:
    """Shared model against local ones; one bank has no baseline."""
    local = _test_report(i, "local").where(F.col("bank_id") != "bank_s")
    return compare.compare_models(_test_report(i, "global"), local)


@query
def compare_models(i: Inputs) -> DataFrame:
    names = [f"{side}_{m}" for m in compare.COMPARED for side in ("base", "fl", "delta")]
    return _rounded(_comparison(i), *names)


@query
def delta_report(i: Inputs) -> DataFrame:
    return _rounded(compare.delta_report(_comparison(i)), "wlogloss_improvement")


# --- secure metrics -------------------------------------------------------------------


@query
def pairwise_masks(i: Inputs) -> DataFrame:
    banks = i.accounts.select("bank_id").distinct()
    masks = secure.pairwise_masks(banks, BANKS, i.secret, MASK_ROUND, "val_loss_num")
    return _rounded(masks, "mask")


def _masked(i: Inputs) -> DataFrame:
    metrics = _val_metrics(i).withColumns({"round": F.lit(MASK_ROUND), "alpha": F.lit(1e-5)})
    fractions = secure.metric_fractions(metrics, federated.AVERAGED_METRICS, F.col("model"))
    return secure.mask_metrics(fractions, BANKS, i.secret)


@query
def masked_metrics(i: Inputs) -> DataFrame:
    return _rounded(_masked(i), "num_masked", "den_masked")


@query
def secure_metric_mean(i: Inputs) -> DataFrame:
    reports = _masked(i).where(secure.in_run(MASK_ROUND, 1e-5))
    return _rounded(secure.secure_mean(reports, BANKS).drop("alpha"), "value")


@query
def missing_clients(i: Inputs) -> DataFrame:
    """Banks with fewer than ten validation positives stay silent here."""
    val = split.split_counts(i.split).where((F.col("split") == "val") & (F.col("pos") >= 10))
    return secure.missing_participants(val, i.accounts.select("bank_id").distinct())


# What refusals say, in part.
REFUSALS = (
    "banks without a report",
    "masked field missing",
    "sum of weights is not positive",
    "update without n_train",
    "no secure aggregation secret",
)


@query
def guards(i: Inputs) -> DataFrame:
    """Which malformed sets of reports and updates are refused, and for which reason."""
    reports = durable(_masked(i), "masked")
    last = F.col("bank_id") == BANKS[-1]
    cases = {
        "complete": reports,
        "bank missing": reports.where(~last),
        "field missing": reports.withColumn(
            "num_masked", F.when(~last, F.col("num_masked"))
        ),
        "weights not positive": reports.withColumn("den_masked", F.lit(0.0)),
    }
    update = i.spark.createDataFrame(
        [("a", None, "coef", 0, 1.0)], "bank_id string, n_train long, key string, pos int, value double"
    )
    tried = {name: lambda rows=rows: secure.secure_mean(rows, BANKS) for name, rows in cases.items()}
    tried["update without rows"] = lambda: averaging.fedavg(update)
    outcome = []
    for name, build in tried.items():
        try:
            outcome.append((name, len(build().collect()), None))
        except PySparkException as error:
            known = [text for text in REFUSALS if text in str(error)]
            if not known:
                raise
            outcome.append((name, 0, known[0]))
    try:
        secure.resolve_secret("", simulation=True)
    except RuntimeError as error:
        outcome.append(("empty secret", 0, str(error)[: len(REFUSALS[-1])]))
    return i.spark.createDataFrame(outcome, "case string, values int, reason string").withColumn(
        "refused", F.col("reason").isNotNull()
    )


# --- averaging, selection, training ---------------------------------------------------------


def _loss_path(i: Inputs) -> DataFrame:
    """(alpha, round, loss): validation loss along a fixed path of models."""
    models = {f"{a}|{r}": params for a, r, params in fixed.path_models(i.prepared.width)}
    val = i.prepared.encoded.where(F.col("split") == "val")
    scored = evaluate.score_shared(val, models, i.scorer, width=i.prepared.width)
    name = F.split("model", r"\|")
    return (
        evaluate.weighted_log_loss(scored, ["model", "bank_id"])
        .groupBy(name[0].cast("double").alias("alpha"), name[1].cast("int").alias("round"))
        .agg((F.sum("wloss_sum") / F.sum("w_sum")).alias("loss"))
    )


@query
def early_stopping(i: Inputs) -> DataFrame:
    return _rounded(averaging.early_stopping(_loss_path(i), patience=2), "loss", "best_loss")


@query
def select_best_model(i: Inputs) -> DataFrame:
    order = F.array_position(F.array(*(F.lit(a) for a in fixed.PATH_ALPHAS)), F.col("alpha"))
    stopped = averaging.early_stopping(_loss_path(i), patience=2).withColumn("alpha_order", order)
    best = averaging.select_best(stopped.select("alpha", "round", "loss", "alpha_order"))
    return _rounded(best.select("alpha", "round", "loss"), "loss")


def _gradient(i: Inputs, members: tuple[str, ...], rows: DataFrame) -> DataFrame:
    zeros = [0.0] * i.prepared.width
    return gradient.gradient_updates(rows, zeros, 0.0, 0.0, GRADIENT_STEP, SPEC, members)


def _averaged_gradient(i: Inputs) -> DataFrame:
    rows = stats.train_rows(i.prepared.encoded).withColumn("part", F.pmod("acct_id", F.lit(4)))
    members = ("bank_id", "part")
    return averaging.fedavg(_gradient(i, members, rows), members)


@query
def gd_round(i: Inputs) -> DataFrame:
    table = _gradient(i, ("bank_id",), stats.train_rows(i.prepared.encoded))
    return _rounded(table, "value", digits=9)


@query
def fedavg(i: Inputs) -> DataFrame:
    return _rounded(_averaged_gradient(i), "value", digits=9)


@query
def local_update(i: Inputs) -> DataFrame:
    """One local round: every bank's parameters after one pass from zero."""
    placed = shards.place_shards(i.prepared.encoded, TRAINING)
    start = {(1e-5, None): MODEL.initial(i.prepared.width)}
    updates = shards.train_shards(placed, MODEL, start, 1, TRAINING)
    return _rounded(shards.bank_updates(updates), "value", digits=9)


@query
def federated_round(i: Inputs) -> DataFrame:
    """One full round with its validation loss."""
    spec = TrainSpec(rounds=1)
    run = federated.train_federated(i.prepared.encoded, i.prepared.width, SECRET, SPEC, spec)
    return _rounded(i.spark.createDataFrame(run.log), "avg_val_wlogloss", "best_loss")


@query
def federated_train(i: Inputs) -> DataFrame:
    run = federated.train_federated(
        i.prepared.encoded, i.prepared.width, SECRET, SPEC, TRAINING
    )
    report = experiment.federated_report(i.prepared.encoded, run.best.params, SPEC, width=i.prepared.width)
    named = report.withColumns(
        {"alpha": F.lit(run.best.alpha), "round": F.lit(run.best.round_id)}
    )
    return _rounded(named, *TEST_COLUMNS)


@query
def round_evaluation(i: Inputs) -> DataFrame:
    """Ten metrics of every round: the global model's and the mean of the local ones'."""
    run = federated.train_federated(
        i.prepared.encoded, i.prepared.width, SECRET, SPEC, TRAINING, evaluate=True
    )
    rows = [(r["alpha"], r["round"], r["metric"], r["value"]) for r in run.evaluation]
    return _rounded(i.spark.createDataFrame(rows, rounds.EVALUATION), "value")


@query
def federated_resume(i: Inputs) -> DataFrame:
    """The log of a run that stopped after its third round, with a round cut off after that,
    and went on from what was committed; the best model comes from the store."""
    store = rounds.RoundStore(i.spark, fresh_path(i.spark, "rounds"))
    arguments = (i.prepared.encoded, i.prepared.width, SECRET, SPEC)
    federated.train_federated(*arguments, replace(TRAINING, rounds=3), store=store)
    # What a dying run leaves behind: files of a fourth round that no commit names.
    tables.save_models(i.spark, f"{store.path}/rounds/4-cut", [("running", 1e-5, 4, MODEL.initial(1), {})])
    again = rounds.RoundStore(i.spark, store.path)
    federated.train_federated(*arguments, TRAINING, store=again)
    alpha, round_id, params = again.best_model()
    MODEL.check(params, i.prepared.width)
    log = i.spark.read.schema(rounds.LOG).json(f"{store.path}/log")
    kept = (F.col("alpha") == alpha) & (F.col("round") == round_id)
    return _rounded(log.withColumn("kept", kept), "avg_val_wlogloss", "best_loss")


@query
def local_baseline(i: Inputs) -> DataFrame:
    run = baseline.train_local(i.prepared.encoded, i.prepared.width, SPEC, TRAINING)
    report = baseline.baseline_report(i.prepared.encoded, run, SPEC, width=i.prepared.width)
    return _rounded(report, "val_wlogloss_best", "val_ap", "val_wlogloss", *TEST_COLUMNS)


@query
def round1_compare(i: Inputs) -> DataFrame:
    table = federated.compare_round_one(
        i.prepared.encoded, i.prepared.width, 1e-5, SECRET, SPEC, TRAINING
    )
    return _rounded(table, "avg_local_val_wlogloss", "avg_global_val_wlogloss")


@query
def study(i: Inputs) -> DataFrame:
    """Both sides trained on one split and compared on its test rows."""
    table = experiment.run_study(i.prepared, SECRET, SPEC, TRAINING).comparison
    return _rounded(table, *[f"{side}_{m}" for m in compare.COMPARED for side in ("base", "fl", "delta")])
