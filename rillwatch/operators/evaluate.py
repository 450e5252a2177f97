"""Quality of scores and labels, each from grouped counts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.operators.blocks import running_totals
from rillwatch.session import cut_lineage


def _ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp),
    })


def confusion(df: DataFrame, y: str, predicted: str) -> DataFrame:
    n = lambda a, b: F.count(F.when((F.col(y) == a) & (F.col(predicted) == b), 1))
    return _with_rates(df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn")))


def classification_report(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages and accuracy."""
    # classes x classes rows, used four times below: the table is read once
    pairs = cut_lineage(df.groupBy(F.col(y).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n")))
    ends = pairs.select("n", F.inline(F.array(
        F.struct(F.col("a").alias("class"), F.lit(1).alias("is_a"), F.when(F.col("a") == F.col("p"), 1).otherwise(0).alias("is_p")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("is_a"), F.when(F.col("a") == F.col("p"), 0).otherwise(1).alias("is_p")))))
    per = ends.groupBy("class").agg(
        F.sum(F.col("n") * F.col("is_a")).alias("support"), F.sum(F.col("n") * F.col("is_p")).alias("predicted"),
        F.sum(F.col("n") * F.col("is_a") * F.col("is_p")).alias("tp"))
    per = per.select("class", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"),
                     _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp")
    measures = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
                       F.sum("support").alias("support"))
    hits = _ratio(F.sum("tp"), F.sum("support"))
    accuracy = per.agg(F.lit("accuracy").alias("class"), *[hits.alias(m) for m in measures], F.sum("support").alias("support"))
    return per.drop("tp").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def class_weight(df: DataFrame, y: str) -> DataFrame:
    """Negatives per positive, 1 without positives."""
    one = df.agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))
    return one.withColumn("weight", F.coalesce(F.try_divide(F.col("neg").cast("double"), F.col("pos")), F.lit(1.0)))


def roc_auc(df: DataFrame, y: str, score: str, block_rows: int = 100_000) -> DataFrame:
    """Exact area under the ROC curve: for each distinct score, positives times negatives below it, ties half.

    Equal scores are counted together first. Running counts over the remaining distinct scores are made in blocks
    of about ``block_rows`` between approximate quantiles, so there is no single sorted partition; the quantiles only
    balance the work.
    """
    per = cut_lineage(df.groupBy(F.col(score).alias("s")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg")))
    blocks = per.count() // block_rows + 1
    cuts = sorted(set(per.approxQuantile("s", [i / blocks for i in range(1, blocks)], 0.5 / blocks))) if blocks > 1 else []
    inf = float("inf")
    if cuts:
        per = Bucketizer(splits=[-inf, *cuts, inf], inputCol="s", outputCol="part").transform(per)
    else:
        per = per.withColumn("part", F.lit(0.0))
    run = running_totals(per, [], "s", {"upto": "neg"}, block=F.col("part").cast("long"))
    below = F.col("upto") - F.col("neg")
    return run.agg(
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def thresholds() -> list[float]:
    """0.50 to 0.98 in steps of 0.01, as exact decimals."""
    return [float(Decimal(i) / 100) for i in range(50, 99)]


def threshold_sweep(df: DataFrame, y: str, score: str) -> DataFrame:
    """Rates at every threshold and the score F1 - 2 * FPR; ``is_best`` marks the first best threshold.

    Rows are counted once by how many thresholds their score reaches (at most 50 groups); counts at a threshold
    are suffix sums over those groups, so nothing is multiplied by the number of thresholds.
    """
    ts = thresholds()
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in ts), F.lit(0))
    groups = df.groupBy(reached.alias("k")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) == 0, 1)).alias("neg"))
    # spread each group over the thresholds it reaches and those it misses: 50 groups x 49 thresholds at most
    spread = groups.select("k", "pos", "neg", F.posexplode(F.array(*map(F.lit, ts))).alias("i", "threshold"))
    hit, miss = F.col("k") > F.col("i"), F.col("k") <= F.col("i")
    counts = spread.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(miss, F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(miss, F.col("pos")).otherwise(0)).alias("fn"))
    scored = _with_rates(counts).withColumn("score", F.col("f1") - 2 * F.col("fpr"))
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "threshold")  # 49 rows
    return scored.withColumn("is_best", F.row_number().over(best) == 1)
