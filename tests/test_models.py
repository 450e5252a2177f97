"""Evaluation against plain numpy, training on a small learnable set."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwatch.operators import evaluate, model
from rillwatch.operators.sampling import stratified_split


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 3000)
    s = np.clip(np.round(r.normal(0.45 + 0.25 * y, 0.2), 3), 0, 1)
    return y, s, spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))


def test_auc_with_ties(scored):
    y, s, df = scored
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(want, abs=1e-12)
    assert evaluate.roc_auc(df, "y", "s", block_rows=7).first()["auc"] == pytest.approx(want, abs=1e-12)


def test_auc_without_positives(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.1)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()["auc"] is None


def test_threshold_sweep(scored):
    y, s, df = scored
    out = evaluate.threshold_sweep(df, "y", "s").orderBy("threshold").collect()
    assert [r["threshold"] for r in out] == evaluate.thresholds() and len(out) == 49
    best, best_score = None, -9
    for r in out:
        p = s >= r["threshold"]
        tp, fp, fn, tn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum(), (~p & (y == 0)).sum()
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
        score = 2 * tp / (2 * tp + fp + fn) - 2 * fp / (fp + tn)
        assert r["score"] == pytest.approx(score)
        if score > best_score:
            best, best_score = r["threshold"], score
    assert [r["threshold"] for r in out if r["is_best"]] == [best]
    fprs = [r["fpr"] for r in out]
    assert fprs == sorted(fprs, reverse=True)


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2, "y int, p int")
    c = evaluate.confusion(df, "y", "p").first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"], c["accuracy"], c["precision"]) == (3, 2, 4, 1, 0.7, 0.6)
    rep = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rep["0"]["precision"] == 0.8 and rep["macro avg"]["recall"] == pytest.approx((3 / 4 + 4 / 6) / 2) and rep["accuracy"]["f1"] == 0.7 and rep["1"]["support"] == 4


def test_class_weight_without_positives(spark):
    assert evaluate.class_weight(spark.createDataFrame([(0,), (0,)], "y int"), "y").first()["weight"] == 1.0


FEATURES = ["a", "b", "c"]
SMALL = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def learnable(spark):
    df = spark.range(1500).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    df = df.withColumn("y", ((F.col("a") + 0.2 * F.col("b")) > 0.7).cast("int"))
    return stratified_split(df, "id", "y").persist()


def test_training_ranks_and_scores(spark, learnable, tmp_path):
    fit = model.train_gbt(learnable, FEATURES, "y", validation="is_validation", **SMALL)
    scored = model.add_scores(fit, learnable, FEATURES)
    assert scored.columns == [*learnable.columns, "score", "_features"]
    assert evaluate.roc_auc(scored.filter("is_validation"), "y", "score").first()["auc"] > 0.95
    assert model.top_features(fit, FEATURES, 1) == ["a"]
    model.save_artifacts(fit, FEATURES, 0.7, str(tmp_path / "m"), spark)
    loaded, features, threshold = model.load_artifacts(spark, str(tmp_path / "m"))
    assert features == FEATURES and threshold == 0.7
    a = {r["id"]: r["score"] for r in scored.collect()}
    b = {r["id"]: r["score"] for r in model.add_scores(loaded, learnable, FEATURES).collect()}
    assert a == b


def test_permutation_importance(learnable):
    """Against the same swaps made one by one in Python."""
    fit = model.train_gbt(learnable, FEATURES, "y", **SMALL)
    got = {r["feature"]: r["auc_drop"] for r in model.permutation_importance(fit, learnable, FEATURES, "y", "id", bins=1 << 30).collect()}
    rows = learnable.withColumn("h", F.xxhash64("id")).orderBy("h", "id").toPandas()
    whole = evaluate.roc_auc(model.add_scores(fit, learnable, FEATURES), "y", "score").first()["auc"]
    for f in FEATURES:
        swapped = rows.drop(columns="h").copy()
        swapped[f] = rows[f].shift(1).fillna(rows[f])
        auc = evaluate.roc_auc(model.add_scores(fit, learnable.sparkSession.createDataFrame(swapped), FEATURES), "y", "score").first()["auc"]
        assert got[f] == pytest.approx(whole - auc, abs=1e-6)
    assert got["a"] > 0.2 > got["b"] > -0.01 and abs(got["c"]) < 0.01


def test_calibration(learnable):
    fit = model.calibrate(learnable, FEATURES, "y", "id", **SMALL)
    scored = model.add_scores(fit, learnable, FEATURES)
    assert evaluate.roc_auc(scored, "y", "score").first()["auc"] > 0.95
    assert evaluate.brier(scored, "y", "score").first()["brier"] < 0.1


def test_search(learnable):
    _best, tried = model.random_search(learnable, FEATURES, "y", draws=2, folds=2, space={"maxIter": [1, 3], "maxDepth": [2]})
    assert len(tried) == 2 and all(auc > 0.8 for _s, auc in tried)


def test_halving_search(learnable):
    """The best third of a rung goes on; the last rung's best comes first; AUCs hold for the folds' other rows."""
    tried = model.halving_search(learnable, FEATURES, "y", "id", draws=4, folds=2, rungs=(1, 3), rows=1000,
                                 space={"maxDepth": [1, 3], "stepSize": [0.1, 0.3], "posWeight": model.POSITIVE_WEIGHTS})
    assert [(f["rung"], f["rounds"]) for f in tried] == [(1, 3)] * 2 + [(0, 1)] * 4
    first = [f["setting"] for f in tried if f["rung"] == 0]
    assert all(f["setting"] in first[:2] for f in tried[:2]) and tried[0]["auc"] >= tried[1]["auc"] > 0.8


def test_absent_feature_is_an_error(learnable):
    with pytest.raises(ValueError, match="zzz"):
        model.usable_features(learnable, ["a", "zzz"])


def test_bad_values_become_zero(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), None)], "a double, b double, c double")
    assert tuple(model.usable_features(df, FEATURES).first()) == (0.0, 0.0, 0.0)


def test_lists_around_the_model(spark, learnable):
    fit = model.train_gbt(learnable.withColumnRenamed("a", "tot_fwd_pkts"), ["tot_fwd_pkts"], "y", **SMALL)
    flows = spark.createDataFrame([("w", 0), ("b", 0), ("n", 0)], "src_ip string, tot_fwd_pkts long")
    ip = lambda x: spark.createDataFrame([(x,)], "ip string")
    out = {r["src_ip"]: (r["prediction"], r["confidence"], r["features"]) for r in model.score_flows(fit, flows, ["tot_fwd_pkts"], whitelist=ip("w"), blacklist=ip("b")).collect()}
    assert set(out) == {"b", "n"} and out["b"][:2] == ("DDoS", 1.0) and out["n"][0] == "BENIGN" and out["n"][2] == {"tot_fwd_pkts": 0.0}


def test_queries_fit_with_the_library_defaults(spark):
    from rillwatch.fixtures import Inputs
    from rillwatch.plans import q_models

    _df, fit = q_models.fitted(Inputs(spark, "/root/testdata/sf0.001"))
    trees = fit.stages[-1]
    assert (trees.getMaxDepth(), trees.getStepSize(), trees.getMaxIter()) == (8, 0.03, 100)
    assert trees.getValidationIndicatorCol() == "is_validation"
