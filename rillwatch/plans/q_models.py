"""Queries around training, calibration and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rillwatch.functions.features import add_derived_features
from rillwatch.operators import evaluate, flowmeter, model, sampling
from rillwatch.operators.scoring import label_scores
from rillwatch.plans.q_flows import rounded
from rillwatch.plans.registry import CHECK_VIEWS, query
from rillwatch.session import cut_lineage, run_dir

CHECK_VIEWS.update({
    "judged": "SELECT *, CASE WHEN lower(label) = 'benign' THEN 0 ELSE 1 END AS y, CASE WHEN score >= 0.6 THEN 1 ELSE 0 END AS predicted FROM labeled",
    "halves": "SELECT flow_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(flow_id AS VARCHAR)), flow_id) <= floor(0.1 * count(*) OVER (PARTITION BY y)) AS is_validation FROM judged",
    "conf": """
SELECT count(CASE WHEN y = 1 AND predicted = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND predicted = 1 THEN 1 END) AS fp,
 count(CASE WHEN y = 0 AND predicted = 0 THEN 1 END) AS tn, count(CASE WHEN y = 1 AND predicted = 0 THEN 1 END) AS fn FROM judged""",
})


def judged(t):
    df = sampling.attacks_and_benign(t.view("labeled"))
    return label_scores(df, "score", 0.6).withColumn("predicted", F.when(F.col("prediction") == "DDoS", 1).otherwise(0)).drop("prediction", "confidence")


def training(t):
    """Labelled flows with features. The source address decides part of the label and is no feature."""
    df = add_derived_features(judged(t).drop("score", "predicted"))
    return model.usable_features(df, model.FLOW_FEATURES)


@query("feature_vector", """
SELECT flow_id, CAST(unnest(range(20)) AS INTEGER) AS i, round(COALESCE(unnest(CAST([dst_port, protocol, d, tot_fwd_pkts, tot_bwd_pkts, totlen_fwd_pkts, totlen_bwd_pkts, syn_flag_cnt, ack_flag_cnt, tp, tb, tp / d, tb / d, COALESCE(tb / NULLIF(tp, 0), 0), COALESCE(tot_fwd_pkts / NULLIF(tp, 0), 0), greatest(flow_iat_max - flow_iat_min, 0), ln(1 + tp / d), ln(1 + tb / d), ln(1 + tb), ln(1 + tp)] AS DOUBLE[])), 0), 4) AS value
FROM (SELECT *, CAST(greatest(flow_duration, 0) AS DOUBLE) + 1e-6 AS d, CAST(tot_fwd_pkts + tot_bwd_pkts AS DOUBLE) AS tp, CAST(totlen_fwd_pkts + totlen_bwd_pkts AS DOUBLE) AS tb FROM judged) x""")
def _(t):
    packed = model.assembler(model.FLOW_FEATURES).transform(training(t))
    from pyspark.ml.functions import vector_to_array

    return packed.select("flow_id", F.posexplode(vector_to_array("features")).alias("i", "value")).withColumn("value", F.round("value", 4))


_MIX = """
SELECT flow_id, y FROM judged WHERE protocol = 6 UNION ALL
SELECT flow_id, y FROM (SELECT flow_id, y, row_number() OVER (ORDER BY md5(CAST(flow_id AS VARCHAR)), flow_id) AS i, count(*) OVER () AS n FROM judged WHERE protocol <> 6 AND y = 1) x WHERE i <= greatest(1, floor(n * 0.03))"""


@query("mix_sample", _MIX)
def _(t):
    df = judged(t).select("flow_id", "y", "protocol")
    return sampling.mix_attacks(df.filter("protocol = 6"), df.filter("protocol <> 6"), "flow_id").select("flow_id", "y")


@query("stratified_split", "SELECT * FROM halves")
def _(t):
    return sampling.stratified_split(judged(t).select("flow_id", "y"), "flow_id", "y")


@query("class_weight", "SELECT count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg, round(count(CASE WHEN y = 0 THEN 1 END) / CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE), 6) AS weight FROM halves WHERE NOT is_validation")
def _(t):
    split = sampling.stratified_split(judged(t).select("flow_id", "y"), "flow_id", "y")
    return rounded(evaluate.class_weight(split.filter(~F.col("is_validation")), "y"))


@query("confusion_metrics", """
SELECT tp, fp, tn, fn, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
 round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1, round(fp / CAST(fp + tn AS DOUBLE), 6) AS fpr, round(fn / CAST(fn + tp AS DOUBLE), 6) AS fnr FROM conf""")
def _(t):
    return rounded(evaluate.confusion(judged(t), "y", "predicted"))


@query("classification_report", """
WITH c AS (SELECT '1' AS class, tp AS hit, tp + fp AS said, tp + fn AS support FROM conf UNION ALL SELECT '0', tn, tn + fn, tn + fp FROM conf),
 r AS (SELECT class, hit / CAST(said AS DOUBLE) AS precision, hit / CAST(support AS DOUBLE) AS recall, 2 * hit / CAST(said + support AS DOUBLE) AS f1, support, hit FROM c)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'accuracy', round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), round(sum(hit) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM r""")
def _(t):
    return rounded(evaluate.classification_report(judged(t), "y", "predicted"))


@query("brier_score", "SELECT round(avg((score - y) * (score - y)), 9) AS brier FROM judged")
def _(t):
    return evaluate.brier(judged(t), "y", "score").select(F.round("brier", 9).alias("brier"))


@query("roc_auc", """
SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y = 1 THEN 1 END) * CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE)), 6) AS auc,
 count(CASE WHEN y = 1 THEN 1 END) AS positives, count(CASE WHEN y = 0 THEN 1 END) AS negatives
FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM judged) x""")
def _(t):
    return rounded(evaluate.roc_auc(judged(t), "y", "score"))


@query("threshold_sweep", """
WITH s AS (SELECT CAST(i / 100.0 AS DOUBLE) AS threshold FROM range(50, 99) r(i)),
 c AS (SELECT threshold, count(CASE WHEN y = 1 AND score >= threshold THEN 1 END) AS tp, count(CASE WHEN y = 0 AND score >= threshold THEN 1 END) AS fp,
  count(CASE WHEN y = 0 AND score < threshold THEN 1 END) AS tn, count(CASE WHEN y = 1 AND score < threshold THEN 1 END) AS fn FROM judged, s GROUP BY 1),
 q AS (SELECT *, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1, fp / CAST(fp + tn AS DOUBLE) AS fpr FROM c)
SELECT threshold, tp, fp, tn, fn, round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(f1 - 2 * fpr, 6) AS score, row_number() OVER (ORDER BY f1 - 2 * fpr DESC, threshold) = 1 AS is_best FROM q""")
def _(t):
    return rounded(evaluate.threshold_sweep(judged(t), "y", "score")).drop("accuracy", "precision", "recall", "fnr")


# fitted models ---------------------------------------------------------------------------------------------

def fitted(t, features=None, **extra):
    df = cut_lineage(sampling.stratified_split(training(t), "flow_id", "y"))  # read once per boosting round and more
    return df, model.train_gbt(df, features or model.FLOW_FEATURES, "y", validation="is_validation", **extra)


#: models fitted in this session, by application and data folder
_FITTED: dict[tuple[str, str], str] = {}


def shared_model(t):
    """Folder of the model of this data set: fitted once in a session, saved, and loaded by every query that scores."""
    key = (t.spark.sparkContext.applicationId, t.dir)
    if key not in _FITTED:
        _df, fit = fitted(t)
        path = run_dir(t.spark, "artifacts")
        model.save_artifacts(fit, model.FLOW_FEATURES, 0.5, path, t.spark, "shared")
        _FITTED[key] = path
    return _FITTED[key]


@query("train_gbt")
def _(t):
    df, fit = fitted(t)
    scored = model.add_scores(fit, df, model.FLOW_FEATURES).withColumn("part", F.when(F.col("is_validation"), "validation").otherwise("train"))
    val = evaluate.roc_auc(scored.filter("is_validation"), "y", "score").withColumn("part", F.lit("validation"))
    return val.unionByName(evaluate.roc_auc(scored.filter("NOT is_validation"), "y", "score").withColumn("part", F.lit("train")))


def metered(t):
    """Flows of the flow meter with ``y`` and a split, their 76 features' names, and trees fitted on them once in a session.

    Rows of the split stop the boosting; they take no part in the trees.
    """
    key = (t.spark.sparkContext.applicationId, f"{t.dir}#metered")
    if key not in _FITTED:
        flows = flowmeter.measure_flows(t.view("wire"), label="attack").withColumnRenamed("label", "y")
        names = [c for c in flows.columns if c not in (*flowmeter.IDENTITY, "y")]
        flows = model.usable_features(flows.withColumn("flow_id", F.concat_ws("|", *flowmeter.IDENTITY)), names)
        path = run_dir(t.spark, "metered")
        sampling.stratified_split(flows, "flow_id", "y").write.parquet(f"{path}/flows")
        df = t.spark.read.parquet(f"{path}/flows")
        model.save_artifacts(model.train_gbt(df, names, "y", validation="is_validation"), names, 0.5, path, t.spark, "metered")
        _FITTED[key] = path
    fit, names, _ = model.load_artifacts(t.spark, _FITTED[key])
    return t.spark.read.parquet(f"{_FITTED[key]}/flows"), fit, names


@query("feature_topk")
def _(t):
    """The 30 features of 76 by importance in the trees, and what the held-out AUC loses without each."""
    df, fit, names = metered(t)
    drops = model.permutation_importance(fit, df.filter("is_validation"), names, "y", "flow_id")
    return model.importances(fit, names, t.spark).join(drops, "feature").orderBy(F.desc("importance"), "feature").limit(30)


@query("feature_select_retrain")
def _(t):
    """Held-out AUC with all features and with the best 30 alone."""
    df, fit, names = metered(t)
    best = model.top_features(fit, names)
    again = model.train_gbt(df, best, "y", validation="is_validation")
    held = df.filter("is_validation")
    return reduce(lambda a, b: a.unionByName(b), [
        evaluate.roc_auc(model.add_scores(m, held, fs), "y", "score").withColumns({"n_features": F.lit(len(fs)), "features": F.lit("|".join(fs))})
        for m, fs in ((fit, names), (again, best))])


@query("hyperparam_search")
def _(t):
    """20 settings, 3 folds, three rungs; the settings of each rung with their AUC."""
    tried = model.halving_search(training(t), model.FLOW_FEATURES, "y", "flow_id")
    rows = [(f["rung"], f["rounds"], str(sorted(f["setting"].items())), f["auc"]) for f in tried]
    return t.spark.createDataFrame(rows, "rung int, rounds int, setting string, auc double")


def calibrated(t):
    return model.calibrate(training(t), model.FLOW_FEATURES, "y", "flow_id", folds=3)


@query("calibrate_sigmoid")
def _(t):
    scored = model.add_scores(calibrated(t), training(t), model.FLOW_FEATURES)
    brier = evaluate.brier(scored, "y", "score").select(F.lit("brier").alias("measure"), F.col("brier").alias("value"))
    return brier.unionByName(evaluate.roc_auc(scored, "y", "score").select(F.lit("auc").alias("measure"), F.col("auc").alias("value")))


@query("score_flows")
def _(t):
    fit, features, threshold = model.load_artifacts(t.spark, shared_model(t))
    return model.score_flows(fit, t.view("flows"), features, threshold).withColumn("features", F.to_json("features"))


@query("sink_model_artifacts", f"SELECT '{'|'.join(model.FLOW_FEATURES)}' AS features, CAST({len(model.FLOW_FEATURES)} AS BIGINT) AS num_features, 'check run' AS note, CAST(0.98 AS DOUBLE) AS threshold")
def _(t):
    fit, _features, _threshold = model.load_artifacts(t.spark, shared_model(t))
    path = run_dir(t.spark, "artifacts")
    model.save_artifacts(fit, model.FLOW_FEATURES, 0.98, path, t.spark, "check run")
    return t.spark.read.json(f"{path}/meta").withColumn("features", F.array_join("features", "|"))


@query("src_model_artifacts")
def _(t):
    loaded, features, threshold = model.load_artifacts(t.spark, shared_model(t))
    return model.score_flows(loaded, t.view("flows"), features, threshold).groupBy("prediction").agg(F.count("*").alias("n"))


@query("ml_score_end_to_end")
def _(t):
    from rillwatch.streaming.jobs import model_alerts_from_flows

    fit, features, threshold = model.load_artifacts(t.spark, shared_model(t))
    return flat(model_alerts_from_flows(t.view("flows"), fit, features, threshold, whitelist=trusted(t)))


def trusted(t):
    """Addresses that administrators rejected as attackers, as a list of ``ip``."""
    return t.view("admin_actions").filter("action = 'reject'").select("ip").distinct()


def flat(found):
    return found.withColumns({"attacker_ips": F.array_join("attacker_ips", "|"), "metrics": F.to_json("metrics")})


@query("stream_ml_score_end_to_end")
def _(t):
    """The same model on a stream: alerts of the windows that the watermark closed."""
    from rillwatch.streaming.jobs import stream_model_alerts

    where = run_dir(t.spark, "model-alerts")
    stream_model_alerts(t.stream("flows"), shared_model(t), f"{where}/out", f"{where}/checkpoint", whitelist=trusted(t)).trigger(
        availableNow=True).start().awaitTermination()
    return flat(t.spark.read.parquet(f"{where}/out/alerts").drop("batch", "model"))
