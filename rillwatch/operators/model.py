"""Training, calibration, selection and scoring with MLlib."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.functions.features import add_derived_features
from rillwatch.operators import scoring
from rillwatch.operators.blocks import previous_row
from rillwatch.operators.clean import finite
from rillwatch.operators.evaluate import class_weight
from rillwatch.session import cut_lineage

# Tree depth, learning rate, row and column share, rounds without progress.
GBT = {"maxDepth": 8, "stepSize": 0.03, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"}
SEARCH = {
    "maxIter": [1000, 3000, 5000], "maxDepth": [3, 6, 8, 10], "stepSize": [0.01, 0.03, 0.05, 0.1],
    "subsamplingRate": [0.6, 0.7, 0.8, 0.9], "featureSubsetStrategy": ["0.6", "0.7", "0.8"],
    "minInfoGain": [0.0, 0.1, 0.5, 1.0], "minInstancesPerNode": [1, 3, 5],
}
POSITIVE_WEIGHTS = [1.0, 1.2, 0.8]
FLOW_FEATURES = [
    "dst_port", "protocol", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts",
    "syn_flag_cnt", "ack_flag_cnt", "total_packets", "total_bytes", "packet_rate", "byte_rate", "mean_packet_size",
    "fwd_ratio", "iat_range", "log_packet_rate", "log_byte_rate", "log_total_bytes", "log_total_packets",
]


def usable_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles without gaps, NaN or infinities. A feature the table lacks is an error."""
    lacking = [f for f in features if f not in df.columns]
    if lacking:
        raise ValueError(f"model features missing from the input: {lacking}")
    return df.withColumns({f: F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)) for f in features})


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def weighted(df: DataFrame, y: str, validation: str | None = None) -> DataFrame:
    """Positives weigh as much in total as negatives, counted without the rows that ``validation`` flags."""
    counted = df if validation is None else df.filter(~F.col(validation))
    w = class_weight(counted, y).first()["weight"]
    return df.withColumn("weight", F.when(F.col(y) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))


def train_gbt(df: DataFrame, features: list[str], y: str, validation: str | None = None, **params) -> PipelineModel:
    """Boosted trees with class weights; with a ``validation`` flag column, boosting stops when it stops helping."""
    gbt = GBTClassifier(labelCol=y, weightCol="weight", seed=42, **{**GBT, "maxIter": 100, **params})
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assembler(features), gbt]).fit(weighted(df, y, validation))


def importances(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """One row per feature; the number of features, not of rows, sets its size."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def top_features(model: PipelineModel, features: list[str], k: int = 30) -> list[str]:
    values = model.stages[-1].featureImportances.toArray()
    return [f for _, f in sorted(zip(values, features), key=lambda p: (-p[0], p[1]))[:k]]


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], y: str, id_col: str, bins: int = 4096) -> DataFrame:
    """One row per feature: ``auc_drop``, what ROC AUC loses when rows get the feature from a random other row.

    In the order of their ids' hashes each row takes the values of the row before it (the first row keeps its own), so one
    pass gives every feature its partner. A row is then scored once for each feature, and only counts for each (feature,
    score bin) are shuffled; scores in one of ``bins`` equal bins count as ties. Ids are unique.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(y).alias("_y"), F.array(*[F.col(f).cast("double") for f in features]).alias("_own"))
    pairs = previous_row(rows.withColumn("_at", F.xxhash64("_id")), [], ["_at", "_id"], ["_own"], name="_other")
    pairs = pairs.select("_y", "_own", F.coalesce("_other._own", "_own").alias("_other"))
    tried = pairs.select("*", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("_i"))
    changed = F.transform("_own", lambda v, j: F.when(j == F.col("_i"), F.element_at("_other", j + 1)).otherwise(v))
    scored = PipelineModel(model.stages[1:]).transform(tried.select("_y", "_i", array_to_vector(changed).alias("features")))
    bin_of = F.least(F.floor(attack_probability(model) * bins), F.lit(bins - 1))
    cells = scored.groupBy("_i", bin_of.alias("_bin")).agg(
        F.count(F.when(F.col("_y") == 1, 1)).alias("pos"), F.count(F.when(F.col("_y") == 0, 1)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("_i").orderBy("_bin")) - F.col("neg") / 2.0  # at most ``bins`` rows a feature
    auc = cells.withColumn("_below", below).groupBy("_i").agg(
        F.try_divide(F.sum(F.col("pos") * F.col("_below")), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
    whole = F.max(F.when(F.col("_i") < 0, F.col("auc"))).over(Window.partitionBy(F.lit(0)))  # one row a feature
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_i") + 1)
    return auc.withColumn("auc_drop", whole - F.col("auc")).filter("_i >= 0").select(names.alias("feature"), "auc_drop")


def random_search(df: DataFrame, features: list[str], y: str, draws: int = 20, folds: int = 3,
                  space: dict | None = None, parallelism: int = 2) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """The best of ``draws`` random settings by cross-validated ROC AUC, and all of them with their score."""
    space = SEARCH if space is None else space
    pick = random.Random(42)
    gbt = GBTClassifier(labelCol=y, weightCol="weight", seed=42)
    settings, grids = [], []
    for _ in range(draws):
        one = {name: pick.choice(values) for name, values in space.items()}
        grid = ParamGridBuilder()
        for name, value in one.items():
            grid = grid.addGrid(gbt.getParam(name), [value])
        settings.append(one)
        grids.extend(grid.build())
    evaluator = BinaryClassificationEvaluator(labelCol=y, metricName="areaUnderROC")
    search = CrossValidator(estimator=Pipeline(stages=[assembler(features), gbt]), estimatorParamMaps=grids, evaluator=evaluator,
                            numFolds=folds, seed=42, parallelism=parallelism)
    fitted = search.fit(weighted(df, y))
    return fitted.bestModel, list(zip(settings, [float(m) for m in fitted.avgMetrics]))


def halving_search(df: DataFrame, features: list[str], y: str, id_col: str, draws: int = 20, folds: int = 3,
                   rungs: tuple[int, ...] = (4, 12, 36), rows: int = 20_000, space: dict | None = None, parallelism: int = 8) -> list[dict]:
    """Random settings, cross-validated with few boosting rounds; the best third goes on to the next rung with more.

    All fits share one sample of about ``rows`` rows (the bound of the search, by hashes of the ids), vectors made once. A
    setting's ``posWeight`` multiplies the weight of positives. Returns one dict per rung and setting: ``rung``, ``rounds``,
    ``setting``, ``auc`` (mean over the folds) and ``seconds`` (summed over its fits), the best of the last rung first.
    """
    space = {k: v for k, v in {**SEARCH, "posWeight": POSITIVE_WEIGHTS}.items() if k != "maxIter"} if space is None else space
    pick = random.Random(42)
    settings = [{name: pick.choice(values) for name, values in space.items()} for _ in range(draws)]
    share = min(1.0, rows / max(1, df.count()))
    slot = F.pmod(F.xxhash64(F.lit("rows"), id_col), F.lit(1_000_000))
    taken = weighted(df.filter(slot < int(share * 1_000_000)), y).withColumn("_fold", F.pmod(F.xxhash64(F.lit("folds"), id_col), F.lit(folds)))
    sample = cut_lineage(assembler(features).transform(taken).select("features", y, "weight", "_fold").repartition(2)).persist()  # bounded, and read in every round

    def fit(setting: dict, fold: int, rounds: int) -> tuple[float, float]:
        began = time.monotonic()
        params = {k: v for k, v in setting.items() if k != "posWeight"}
        heavier = F.when(F.col(y) == 1, F.col("weight") * setting.get("posWeight", 1.0)).otherwise(F.col("weight"))
        trees = GBTClassifier(labelCol=y, weightCol="weight", seed=42, maxIter=rounds, **params).fit(sample.filter(F.col("_fold") != fold).withColumn("weight", heavier))
        scored = trees.transform(sample.filter(F.col("_fold") == fold))
        auc = BinaryClassificationEvaluator(labelCol=y, metricName="areaUnderROC", numBins=0).evaluate(scored)
        return auc, time.monotonic() - began

    tried, left = [], settings
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            for rung, rounds in enumerate(rungs):
                runs = [[pool.submit(fit, s, k, rounds) for k in range(folds)] for s in left]
                found = [{"rung": rung, "rounds": rounds, "setting": s, "auc": sum(r.result()[0] for r in rs) / folds, "seconds": sum(r.result()[1] for r in rs)}
                         for s, rs in zip(left, runs)]
                found.sort(key=lambda f: -f["auc"])
                tried = found + tried
                left = [f["setting"] for f in found[:max(1, (len(found) + 2) // 3)]]
    finally:
        sample.unpersist()
    return tried


def calibrate(df: DataFrame, features: list[str], y: str, id_col: str, folds: int = 3, **params) -> PipelineModel:
    """Sigmoid calibration: per fold, trees on the other folds and a logistic fit of their margin on this one.

    A tenth of the other folds' rows, by the hash of the id, only says when boosting stops.
    The result is one pipeline of plain MLlib stages; ``attack_probability`` is the mean over its folds.
    """
    pack = assembler(features)
    base = pack.transform(weighted(df, y)).withColumns({
        "_fold": F.pmod(F.xxhash64(id_col), F.lit(folds)), "_stop": F.pmod(F.xxhash64(F.lit("stop"), id_col), F.lit(10)) == 0})
    base = cut_lineage(base)  # read in every boosting round
    stages = [pack]
    for k in range(folds):
        gbt = GBTClassifier(labelCol=y, weightCol="weight", seed=42 + k, predictionCol=f"pred_{k}", **{**GBT, "maxIter": 100, **params})
        gbt.setValidationIndicatorCol("_stop")
        gbt.set(gbt.rawPredictionCol, f"raw_{k}")
        gbt.set(gbt.probabilityCol, f"gp_{k}")
        trees = gbt.fit(base.filter(F.col("_fold") != k))
        margin = VectorSlicer(inputCol=f"raw_{k}", outputCol=f"margin_{k}", indices=[1])
        held_out = margin.transform(trees.transform(base.filter(F.col("_fold") == k)))
        sigmoid = LogisticRegression(labelCol=y, featuresCol=f"margin_{k}", rawPredictionCol=f"lr_{k}", probabilityCol=f"p_{k}",
                                     predictionCol=f"lp_{k}").fit(held_out)
        stages += [trees, margin, sigmoid]
    return PipelineModel(stages)


def attack_probability(model: PipelineModel) -> Column:
    """Probability of the attack class: mean over the model's calibration folds, or the trees' own."""
    folds = [s.getProbabilityCol() for s in model.stages if isinstance(s, LogisticRegressionModel)] or ["probability"]
    return sum((vector_to_array(c)[1] for c in folds), F.lit(0.0)) / F.lit(float(len(folds)))


def add_scores(model: PipelineModel, df: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """``df`` with the model's attack probability; bad feature values count as 0, other columns stay as they are."""
    clean = usable_features(df.withColumn("_row", F.struct(*df.columns)), features)
    out = model.transform(clean)
    return out.select("_row.*", attack_probability(model).alias(name), F.struct(*features).alias("_features"))


def score_flows(model: PipelineModel, flows: DataFrame, features: list[str], threshold: float = config.SCORE_THRESHOLD,
                whitelist: DataFrame | None = None, blacklist: DataFrame | None = None, logged: int = 5) -> DataFrame:
    """Whitelisted sources leave, the rest is scored and labelled, blacklisted sources are attackers regardless.

    Keeps the first ``logged`` features as a map. Works on batches and streams.
    """
    from rillwatch.operators.ipfilter import drop_whitelisted, override_blacklisted

    if whitelist is not None:
        flows = drop_whitelisted(flows, whitelist)
    scored = scoring.label_scores(add_scores(model, add_derived_features(flows), features), "score", threshold)
    if blacklist is not None:
        scored = override_blacklisted(scored, blacklist)
    shown = F.create_map(*[x for f in features[:logged] for x in (F.lit(f), F.col(f"_features.{f}"))])
    keep = [c for c in ("flow_id", "flow_ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "score") if c in scored.columns]
    return scored.select(*keep, "prediction", "confidence", shown.alias("features"))


def save_artifacts(model: PipelineModel, features: list[str], threshold: float, path: str, spark: SparkSession, note: str = "") -> None:
    """The pipeline, and one row with feature list and threshold."""
    model.write().overwrite().save(f"{path}/model")
    row = [(features, float(threshold), len(features), note)]
    spark.createDataFrame(row, "features array<string>, threshold double, num_features int, note string").write.mode("overwrite").json(f"{path}/meta")


def load_artifacts(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], float]:
    meta = spark.read.schema("features array<string>, threshold double").json(f"{path}/meta").first()
    threshold = meta["threshold"] if meta["threshold"] is not None else config.SCORE_THRESHOLD
    return PipelineModel.load(f"{path}/model"), list(meta["features"]), threshold
