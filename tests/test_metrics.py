"""Metrics against brute force over every threshold and pair."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import evaluate
from ledgerweave.settings import PROBABILITY_FLOOR


def scored(spark, groups):
    rows = [(g, int(y), float(p)) for g, pairs in groups.items() for y, p in pairs]
    return spark.createDataFrame(rows, "model string, y int, p double")


def rates(pairs, thr):
    tp = sum(1 for y, p in pairs if p >= thr and y == 1)
    fp = sum(1 for y, p in pairs if p >= thr and y == 0)
    fn = sum(1 for y, p in pairs if p < thr and y == 1)
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return tp, fp, precision, recall, f1


def brute(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    auc = None
    if pos and neg:
        wins = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
        auc = wins / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    best = None
    for thr in sorted({p for _, p in pairs}, reverse=True):
        _, _, precision, recall, f1 = rates(pairs, thr)
        ap += (recall - last) * precision
        last = recall
        rank = (round(f1, 12), round(precision, 12), round(recall, 12), thr)
        if best is None or rank > best[0]:
            best = (rank, thr, precision, recall, f1)
    n, k = len(pairs), len(pos)
    w = (n / (2 * k), n / (2 * (n - k))) if 0 < k < n else (1.0, 1.0)
    loss = 0.0
    for y, p in pairs:
        q = min(max(p, PROBABILITY_FLOOR), 1 - PROBABILITY_FLOOR)
        loss += -w[0] * math.log(q) if y else -w[1] * math.log(1 - q)
    return {
        "n": n,
        "pos": k,
        "ap": ap,
        "auc": auc,
        "thr": best[1],
        "p": best[2],
        "r": best[3],
        "f1": best[4],
        "wloss_sum": loss,
        "w_sum": w[0] * k + w[1] * (n - k),
    }


def random_pairs(seed, n, levels):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.2), rng.randrange(levels) / levels + 0.001) for _ in range(n)]


GROUPS = {
    "tied": random_pairs(1, 300, 7),
    "fine": random_pairs(2, 400, 10_000),
    "same": [(i % 3 == 0, 0.4) for i in range(30)],
    "no positives": [(0, i / 40) for i in range(20)],
    "all positive": [(1, i / 40) for i in range(20)],
    "perfect": [(int(i >= 15), i / 40) for i in range(20)],
    "inverted": [(int(i < 5), i / 40) for i in range(20)],
    "one row": [(1, 0.7)],
    "certain": [(0, 0.0), (1, 1.0), (1, 0.0)],
}


@pytest.mark.parametrize("bounds", [None, [0.2, 0.4, 0.5], [i / 50 for i in range(1, 50)]])
def test_bundle_equals_brute_force(spark, bounds):
    got = {
        r["model"]: r.asDict()
        for r in evaluate.metric_bundle(scored(spark, GROUPS), ["model"], bounds).collect()
    }
    assert set(got) == set(GROUPS)
    for name, pairs in GROUPS.items():
        for metric, value in brute(pairs).items():
            if value is None:
                assert got[name][metric] is None, (name, metric)
            else:
                assert got[name][metric] == pytest.approx(value, abs=1e-9), (name, metric)


def test_thousands_of_bounds_stay_in_compiled_code(spark):
    pairs = random_pairs(3, 4000, 4000)
    bounds = [i / 3000 + 1e-7 for i in range(3000)]
    before = spark.conf.get("spark.sql.codegen.fallback", "true")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        many = evaluate.metric_bundle(scored(spark, {"g": pairs}), ["model"], bounds).first()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
    one = evaluate.metric_bundle(scored(spark, {"g": pairs}), ["model"], []).first()
    assert tuple(many)[1:] == pytest.approx(tuple(one)[1:], abs=1e-9)


def test_bounds_are_measured_and_keep_buckets_even(spark):
    pairs = random_pairs(3, 4_000, 1_000_000)
    crowded = [(y, 0.5 + p / 1e6) for y, p in pairs]
    df = scored(spark, {"a": crowded, "b": crowded[:500]})
    collapsed = evaluate.distinct_scores(df, ["model"])
    bounds = evaluate.score_bounds(collapsed, per_bucket=500)
    assert len(bounds) >= 5
    sizes = collapsed.groupBy("model", evaluate._bucket(bounds).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) <= 700
    many = evaluate.metric_bundle(df, ["model"], bounds).orderBy("model").collect()
    one = evaluate.metric_bundle(df, ["model"], []).orderBy("model").collect()
    for a, b in zip(many, one):
        assert list(a) == pytest.approx(list(b), abs=1e-9) if None not in a[1:] else a == b


def test_curve_windows_stay_inside_buckets(spark):
    df = scored(spark, {"a": random_pairs(4, 100, 1000)})
    curve = evaluate.precision_recall_curve(df, ["model"], [0.3, 0.6])
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan


def test_flipping_scores_mirrors_auc(spark):
    df = scored(spark, {"a": GROUPS["tied"]})
    flipped = df.withColumn("p", 1.002 - F.col("p"))
    one = evaluate.metric_bundle(df, ["model"], []).first()["auc"]
    assert evaluate.metric_bundle(flipped, ["model"], []).first()["auc"] == pytest.approx(1 - one)


def test_threshold_is_inclusive(spark):
    df = scored(spark, {"a": [(1, 0.5), (0, 0.5), (1, 0.4)]})
    row = evaluate.confusion_at(df, ["model"], F.lit(0.5)).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 1)


def test_test_report_uses_the_validation_threshold(spark):
    rng = random.Random(5)
    val = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(200)]
    test = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(150)]
    rows = [("m", "val", y, p) for y, p in val] + [("m", "test", y, p) for y, p in test]
    rows += [("only test", "test", y, p) for y, p in test]
    df = spark.createDataFrame(rows, "model string, split string, y int, p double")
    for bounds in ([], [0.25, 0.5, 0.75]):
        got = {r["model"]: r for r in evaluate.test_report(df, ["model"], bounds).collect()}
        v, t = brute(val), brute(test)
        row = got["m"]
        assert row["val_threshold"] == v["thr"] and row["val_f1"] == pytest.approx(v["f1"])
        _, _, precision, recall, f1 = rates(test, v["thr"])
        assert (row["test_p"], row["test_r"]) == pytest.approx((precision, recall))
        assert row["test_f1"] == pytest.approx(f1)
        assert row["test_ap"] == pytest.approx(t["ap"])
        assert row["test_roc_auc"] == pytest.approx(t["auc"])
        assert row["test_wlogloss"] == pytest.approx(t["wloss_sum"] / t["w_sum"])
        # Without validation rows the threshold falls back to one half.
        assert got["only test"]["val_threshold"] == 0.5
        assert got["only test"]["test_p"] == pytest.approx(rates(test, 0.5)[2])


def test_undefined_metrics_do_not_weigh(spark):
    df = spark.createDataFrame(
        [("g", 10, 0.5, 0.8), ("g", 30, 0.9, None)], "model string, n int, ap double, auc double"
    )
    row = evaluate.weighted_mean(df, ["ap", "auc"], ["model"]).first()
    assert row["ap"] == pytest.approx(0.8) and row["auc"] == pytest.approx(0.8)
