"""Exact ranking and threshold metrics for many models and banks at once.

A scored table has key columns (model, bank_id, ...), a label ``y`` and a score ``p``.
Equal scores are collapsed first; everything else works on distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerweave.functions.scoring import class_weight, literal_vector, log_loss
from ledgerweave.sources.durable import durable
from ledgerweave.sources.small import small_table

# Distinct scores one task ranks, quantiles asked for, and their rank accuracy.
SCORES_PER_BUCKET = 500_000
QUANTILE_ACCURACY = 20_000
# Threshold reported for an empty set, decimals in which metrics tie.
EMPTY_THRESHOLD = 0.5
TIE_DIGITS = 12

MODEL_SCHEMA = pa.schema(
    [
        ("model", pa.string()),
        ("bank_id", pa.string()),
        ("params", pa.map_(pa.string(), pa.list_(pa.float64()))),
    ]
)


# Builds the score column of encoded rows; the argument maps a parameter's key to the
# (quoted) name of the array column holding it.
Scorer = Callable[[Callable[[str], str]], Column]


# --- scoring -----------------------------------------------------------------


def model_table(
    spark: SparkSession, models: Sequence[tuple[str, str, Mapping[str, Sequence[float]]]]
) -> DataFrame:
    """(model, bank_id, params): which parameters score which bank's rows."""
    rows = [
        (model, bank, [(k, [float(v) for v in values]) for k, values in params.items()])
        for model, bank, params in models
    ]
    return small_table(spark, MODEL_SCHEMA, rows)


def _named(keys: list[str], prefix: str) -> Callable[[str], str]:
    """Parameter key -> column name; remembers the keys a scorer asked for."""

    def name(key: str) -> str:
        if key not in keys:
            keys.append(key)
        return f"`{prefix}{key}`"

    return name


def _of_width(params: Mapping[str, Sequence[float]], width: int | None) -> None:
    if width is not None and "coef" in params and len(params["coef"]) != width:
        raise ValueError(f"a model of {len(params['coef'])} features meets a plan of {width}")


def score_models(
    encoded: DataFrame, models: DataFrame, scorer: Scorer, width: int | None = None
) -> DataFrame:
    """Scores every row with each model registered for its bank: adds model and ``p``.
    With ``width``, the number of features in the plan, a model of another width is an
    error."""
    if width is not None:
        size = F.size(F.element_at("params", F.lit("coef")))
        text = F.concat(F.lit("a model of "), size, F.lit(f" features meets a plan of {width}"))
        known = F.map_contains_key("params", "coef")
        models = models.withColumn(
            "params", F.when(known & (size != width), F.raise_error(text)).otherwise(F.col("params"))
        )
    keys: list[str] = []
    p = scorer(_named(keys, "_param_"))
    params = {f"_param_{k}": F.element_at("params", F.lit(k)) for k in keys}
    joined = encoded.join(models, "bank_id").withColumns(params)
    return joined.withColumn("p", p).drop("params", *params)


def score_shared(
    encoded: DataFrame,
    models: Mapping[str, Mapping[str, Sequence[float]]],
    scorer: Scorer,
    kind: str = "string",
    width: int | None = None,
) -> DataFrame:
    """Scores every row with each of a few models shared by all banks; the parameters
    travel as literals. ``kind`` is the type of the ``model`` column; with ``width``, the
    number of features in the plan, a model of another width is an error."""
    params: dict[str, Column] = {}
    scores = []
    for i, (name, vectors) in enumerate(models.items()):
        _of_width(vectors, width)
        keys: list[str] = []
        p = scorer(_named(keys, f"_{i}_"))
        params |= {f"_{i}_{k}": literal_vector(vectors[k]) for k in keys}
        scores.append(F.struct(F.lit(name).cast(kind).alias("model"), p.alias("p")))
    return encoded.withColumns(params).select(*encoded.columns, F.inline(F.array(*scores)))


# --- curves ------------------------------------------------------------------


def distinct_scores(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p, pos, neg): labels per distinct score, combined before the shuffle."""
    return scored.groupBy(*keys, "p").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).alias("neg"),
    )


def score_bounds(collapsed: DataFrame, per_bucket: int = SCORES_PER_BUCKET) -> list[float]:
    """Score values that cut the distinct scores of all groups into even buckets.

    The bounds only decide which task ranks which scores, so approximate quantiles are
    enough; being pooled, no (group, bucket) can exceed a bucket of the pool.
    """
    total = collapsed.count()
    buckets = -(-total // per_bucket)
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    accuracy = max(QUANTILE_ACCURACY, 10 * buckets)
    found = collapsed.agg(F.percentile_approx("p", shares, accuracy)).first()[0]
    return sorted(set(found))


def _bucket(bounds: Sequence[float]) -> Column:
    """How many bounds lie at or below ``p``: first counted in strides of the square root
    of their number, then within the stride. Two constant arrays, so the expression does
    not grow into code that cannot be compiled, however many bounds there are."""
    if not bounds:
        return F.lit(0)
    stride = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + stride] for i in range(0, len(bounds), stride)]
    firsts = literal_vector([g[0] for g in groups])
    inner = F.array(*[literal_vector(g) for g in groups])

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col("p")))

    whole = upto(firsts)
    within = upto(F.get(inner, whole - 1))
    return F.when(whole == 0, 0).otherwise((whole - 1) * stride + within)


def precision_recall_curve(
    scored: DataFrame, keys: Sequence[str], bounds: Sequence[float] | None = None
) -> DataFrame:
    """One row per key and distinct score ``p``: ``tp`` and ``fp`` of the rule
    "score >= p", with the group's totals ``n_pos`` and ``n_neg``.

    Cumulative counts over a bank's whole score list would be one sort in one task, so
    they are put together from a running total over buckets, which is small, and a
    window inside each bucket. Rows of a bucket are shuffled once for both.
    """
    keys = list(keys)
    collapsed = distinct_scores(scored, keys)
    if bounds is None:
        # Stored, so that rows are scored once for the bounds and for the curve.
        collapsed = durable(collapsed, "distinct-scores")
        bounds = score_bounds(collapsed)
    return curve_of(collapsed, keys, bounds)


def curve_of(collapsed: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """The curve of distinct scores that :func:`distinct_scores` collapsed."""
    keys = list(keys)
    bucketed = collapsed.withColumn("bucket", _bucket(bounds))
    above = W.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(
        W.unboundedPreceding, -1
    )
    whole = W.partitionBy(*keys)
    inside = W.partitionBy(*keys, "bucket").orderBy(F.desc("p")).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    totals = (
        bucketed.groupBy(*keys, "bucket")
        .agg(F.sum("pos").alias("b_pos"), F.sum("neg").alias("b_neg"))
        .select(
            *keys,
            "bucket",
            F.coalesce(F.sum("b_pos").over(above), F.lit(0)).alias("tp_above"),
            F.coalesce(F.sum("b_neg").over(above), F.lit(0)).alias("fp_above"),
            F.sum("b_pos").over(whole).alias("n_pos"),
            F.sum("b_neg").over(whole).alias("n_neg"),
        )
    )
    return bucketed.join(totals, [*keys, "bucket"]).select(
        *keys,
        "p",
        "pos",
        "neg",
        (F.col("tp_above") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("fp_above") + F.sum("neg").over(inside)).alias("fp"),
        "n_pos",
        "n_neg",
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def with_threshold_rates(curve: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 of every threshold; 0 where undefined."""
    rates = {
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("n_pos")),
    }
    p, r = F.col("precision"), F.col("recall")
    return curve.withColumns(rates).withColumn("f1", _ratio(2.0 * p * r, p + r))


def average_precision() -> Column:
    """Aggregate over curve rows: sum of recall steps times precision, 0 without
    positives."""
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return _ratio(F.sum(step), F.sum("pos"))


def roc_auc() -> Column:
    """Aggregate over curve rows: trapezoids, so ties count one half; null when a
    class is missing."""
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    pairs = F.sum("pos") * F.sum("neg").cast("double")
    return F.when(pairs > 0, area / pairs)


def best_f1() -> Column:
    """Aggregate over curve rows with rates: struct(thr, precision, recall, f1) of the
    best F1; ties go to higher precision, recall, threshold in turn."""
    rank = F.struct(*(F.round(c, TIE_DIGITS) for c in ("f1", "precision", "recall")), F.col("p"))
    pick = F.struct(F.col("p").alias("thr"), "precision", "recall", "f1")
    return F.max_by(pick, rank)


def weighted_loss_parts(n: Column, pos: Column, pos_loss: Column, neg_loss: Column):
    """(sum of w * loss, sum of w) under balanced class weights of the same rows."""
    w_pos, w_neg = class_weight(n, pos, True), class_weight(n, pos, False)
    return w_pos * pos_loss + w_neg * neg_loss, w_pos * pos + w_neg * (n - pos)


# --- metric tables -------------------------------------------------------------


def weighted_log_loss(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, pos, wloss_sum, w_sum) in one map-side combined aggregation."""
    y = F.col("y")
    loss = log_loss(y, F.col("p"))
    summed = scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(y.cast("bigint")).alias("pos"),
        F.coalesce(F.sum(F.when(y == 1, loss)), F.lit(0.0)).alias("_pos_loss"),
        F.coalesce(F.sum(F.when(y == 0, loss)), F.lit(0.0)).alias("_neg_loss"),
    )
    top, bottom = weighted_loss_parts(
        F.col("n"), F.col("pos"), F.col("_pos_loss"), F.col("_neg_loss")
    )
    return summed.select(*keys, "n", "pos", top.alias("wloss_sum"), bottom.alias("w_sum"))


def class_weights(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, pos, w_pos, w_neg) from rows with a 0/1 label ``y``."""
    sized = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos")
    )
    n, pos = F.col("n"), F.col("pos")
    return sized.select(
        *keys,
        "n",
        "pos",
        class_weight(n, pos, True).alias("w_pos"),
        class_weight(n, pos, False).alias("w_neg"),
    )


def confusion_at(scored: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1) of the rule ``p >= threshold``."""
    hit, y = F.col("p") >= threshold, F.col("y")

    def tally(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0))

    counts = scored.groupBy(*keys).agg(
        tally(hit & (y == 1)).alias("tp"),
        tally(hit & (y == 0)).alias("fp"),
        tally(~hit & (y == 1)).alias("fn"),
    )
    named = counts.withColumn("n_pos", F.col("tp") + F.col("fn"))
    return with_threshold_rates(named).drop("n_pos")


def metric_bundle(
    scored: DataFrame, keys: Sequence[str], bounds: Sequence[float] | None = None
) -> DataFrame:
    """Everything about a scored set in one aggregation over its curve:
    n, pos, ap, auc, thr, p, r, f1, wloss_sum, w_sum."""
    curve = with_threshold_rates(precision_recall_curve(scored, keys, bounds))
    pos, neg = F.col("pos"), F.col("neg")
    summed = curve.groupBy(*keys).agg(
        F.sum(pos + neg).alias("n"),
        F.sum(pos).alias("n_pos"),
        average_precision().alias("ap"),
        roc_auc().alias("auc"),
        best_f1().alias("best"),
        F.sum(pos * log_loss(F.lit(1), F.col("p"))).alias("_pos_loss"),
        F.sum(neg * log_loss(F.lit(0), F.col("p"))).alias("_neg_loss"),
    )
    top, bottom = weighted_loss_parts(
        F.col("n"), F.col("n_pos"), F.col("_pos_loss"), F.col("_neg_loss")
    )
    return summed.select(
        *keys,
        "n",
        F.col("n_pos").alias("pos"),
        "ap",
        "auc",
        F.col("best.thr").alias("thr"),
        F.col("best.precision").alias("p"),
        F.col("best.recall").alias("r"),
        F.col("best.f1").alias("f1"),
        top.alias("wloss_sum"),
        bottom.alias("w_sum"),
    )


def test_report(
    scored: DataFrame, keys: Sequence[str], bounds: Sequence[float] | None = None
) -> DataFrame:
    """Test metrics per key with the threshold chosen on validation.

    ``scored`` has a ``split`` column. The thresholds are one row per key; they are
    stored first, so that their size is known and they meet the test curve by broadcast
    instead of gathering a bank's whole curve in one task.
    """
    keys = list(keys)
    # Both splits share one table of distinct scores and one set of bounds.
    held_out = scored.where(F.col("split").isin("val", "test"))
    collapsed = distinct_scores(held_out, [*keys, "split"])
    if bounds is None:
        collapsed = durable(collapsed, "distinct-scores")
        bounds = score_bounds(collapsed)
    both = with_threshold_rates(curve_of(collapsed, [*keys, "split"], bounds))

    def curve(part: str) -> DataFrame:
        return both.where(F.col("split") == part).drop("split")

    val = durable(curve("val").groupBy(*keys).agg(best_f1().alias("best")), "thresholds")
    test = curve("test").join(val, keys, "left")
    thr = F.coalesce(F.col("best.thr"), F.lit(EMPTY_THRESHOLD))
    hit = F.col("p") >= thr
    pos, neg = F.col("pos"), F.col("neg")
    summed = test.groupBy(*keys).agg(
        F.sum(pos + neg).alias("test_n"),
        F.sum(pos).alias("test_pos"),
        average_precision().alias("test_ap"),
        roc_auc().alias("test_roc_auc"),
        F.coalesce(F.sum(F.when(hit, pos)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, neg)), F.lit(0)).alias("fp"),
        F.sum(pos * log_loss(F.lit(1), F.col("p"))).alias("_pos_loss"),
        F.sum(neg * log_loss(F.lit(0), F.col("p"))).alias("_neg_loss"),
        F.first("best").alias("best"),
    )
    top, bottom = weighted_loss_parts(
        F.col("test_n"), F.col("test_pos"), F.col("_pos_loss"), F.col("_neg_loss")
    )
    rated = with_threshold_rates(summed.withColumn("n_pos", F.col("test_pos")))
    best = {
        "val_threshold": F.coalesce(F.col("best.thr"), F.lit(EMPTY_THRESHOLD)),
        "val_p": F.coalesce(F.col("best.precision"), F.lit(0.0)),
        "val_r": F.coalesce(F.col("best.recall"), F.lit(0.0)),
        "val_f1": F.coalesce(F.col("best.f1"), F.lit(0.0)),
    }
    return rated.select(
        *keys,
        "test_n",
        "test_pos",
        *(c.alias(name) for name, c in best.items()),
        "test_ap",
        "test_roc_auc",
        F.col("precision").alias("test_p"),
        F.col("recall").alias("test_r"),
        F.col("f1").alias("test_f1"),
        F.when(bottom > 0, top / bottom).alias("test_wlogloss"),
    )


def weighted_mean(metrics: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Metric averages over banks weighted by validation size; a bank whose metric is
    undefined (null) has weight 0 in it."""

    def mean(name: str) -> Column:
        weight = F.when(F.col(name).isNotNull(), F.col("n"))
        return (F.sum(F.col(name) * weight) / F.sum(weight)).alias(name)

    return metrics.groupBy(*keys).agg(*(mean(c) for c in names))
