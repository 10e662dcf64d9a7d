from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from ledgerweave.operators import averaging, compare

UPDATE = "bank_id string, n_train bigint, key string, values array<double>"


def averaged(spark, rows):
    flat = averaging.flatten_updates(spark.createDataFrame(rows, UPDATE), ["bank_id"])
    out: dict[str, dict[int, float]] = {}
    for r in averaging.fedavg(flat).collect():
        out.setdefault(r["key"], {})[r["pos"]] = r["value"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_weights_are_row_counts(spark):
    got = averaged(
        spark,
        [
            ("a", 100, "coef", [1.0, 2.0, 3.0]),
            ("a", 100, "intercept", [1.0]),
            ("b", 300, "coef", [10.0, 20.0, 30.0]),
            ("b", 300, "intercept", [10.0]),
        ],
    )
    assert got["coef"] == pytest.approx([7.75, 15.5, 23.25], abs=1e-12)
    assert got["intercept"] == pytest.approx([7.75], abs=1e-12)


def test_any_keys(spark):
    got = averaged(
        spark,
        [
            ("a", 2, "layer1.weight", [1.0] * 4),
            ("a", 2, "layer2.bias", [1.0, 2.0, 3.0]),
            ("b", 6, "layer1.weight", [9.0] * 4),
            ("b", 6, "layer2.bias", [9.0, 8.0, 7.0]),
        ],
    )
    assert got["layer1.weight"] == pytest.approx([7.0] * 4, abs=1e-12)
    assert got["layer2.bias"] == pytest.approx([7.0, 6.5, 6.0], abs=1e-12)


def test_one_member_is_the_identity_and_empty_members_do_not_count(spark):
    rows = [("a", 5, "coef", [0.1, 0.2])]
    assert averaged(spark, rows)["coef"] == [0.1, 0.2]
    assert averaged(spark, rows + [("b", 0, "coef", [9.0, 9.0])])["coef"] == [0.1, 0.2]
    assert averaged(spark, [("b", 0, "coef", [9.0])]) == {}


def test_members_must_agree(spark):
    with pytest.raises(PySparkException, match="disagree"):
        averaged(spark, [("a", 5, "coef", [1.0, 2.0]), ("b", 5, "coef", [1.0])])
    # Same total weight on both keys, but from different members.
    with pytest.raises(PySparkException, match="disagree"):
        averaged(spark, [("a", 5, "coef", [1.0]), ("b", 5, "bias", [1.0])])
    with pytest.raises(PySparkException, match="n_train"):
        averaged(spark, [("a", None, "coef", [1.0])])


def replay(losses, patience):
    """The rule, one round at a time."""
    best, best_round, out = float("inf"), 0, []
    for r, loss in enumerate(losses, 1):
        if loss < best:
            best, best_round = loss, r
        out.append((r, best, best_round, r - best_round))
        if r - best_round >= patience:
            break
    return out


@pytest.mark.parametrize(
    "losses", [[5, 4, 3, 2, 1], [1, 2, 3, 4, 5], [3, 2, 2, 2, 1], [3, 4, 2, 5, 6, 1, 0]]
)
@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stopping(spark, losses, patience):
    log = spark.createDataFrame(
        [(0.1, r, float(v)) for r, v in enumerate(losses, 1)], "alpha double, round int, loss double"
    )
    got = averaging.early_stopping(log, patience).orderBy("round").collect()
    assert [tuple(r[c] for c in ("round", "best_loss", "best_round", "no_improve")) for r in got] == replay(
        losses, patience
    )


def test_ties_go_to_the_first_alpha_then_round(spark):
    df = spark.createDataFrame(
        [(0.5, 1, 2.0, 0), (0.5, 2, 1.0, 0), (0.1, 1, 1.0, 1), (0.5, 3, 1.0, 0)],
        "alpha double, round int, loss double, alpha_order int",
    )
    best = averaging.select_best(df).first()
    assert (best["alpha"], best["round"]) == (0.5, 2)


REPORT = (
    "bank_id string, test_n bigint, test_pos bigint, test_p double, test_r double, test_ap double, "
    "test_roc_auc double, {loss} double, test_f1 double"
)


def test_comparison(spark):
    fl = spark.createDataFrame(
        [("a", 10, 2, 0.5, 0.5, 0.6, 0.7, 0.4, 0.5), ("b", 9, 1, 0.5, 0.5, 0.6, None, 0.4, 0.5)],
        REPORT.format(loss="test_wlogloss"),
    )
    base = spark.createDataFrame(
        [("a", 10, 3, 0.25, 0.75, 0.5, 0.5, 0.65, 0.4)], REPORT.format(loss="test_logloss")
    )
    got = {r["bank_id"]: r for r in compare.compare_models(fl, base).collect()}
    assert got["a"]["delta_p"] == 0.25 and got["a"]["delta_r"] == -0.25
    # Older baselines name the loss without its weighting.
    assert got["a"]["delta_wlogloss"] == pytest.approx(-0.25)
    assert got["a"]["split_differs"] and got["a"]["has_baseline"]
    assert got["b"]["delta_ap"] is None and not got["b"]["has_baseline"]
    text = {r["bank_id"]: r for r in compare.delta_report(compare.compare_models(fl, base)).collect()}
    assert (text["a"]["delta_p"], text["a"]["delta_r"]) == ("+0.250", "-0.250")
    assert text["a"]["wlogloss_improvement"] == pytest.approx(0.25)
    assert text["b"]["delta_auc"] == "NA"
