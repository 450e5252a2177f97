"""The detectors from flows to alerts, as batch plans that streams reuse."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.operators import alerts, ipfilter, model, rules, suppress, windows
from rillwatch.session import cut_lineage


def rule_alerts_from_flows(flows: DataFrame, sizes: tuple[int, ...] = (60,), all_windows: bool = False,
                           per_flow: list[dict] | None = None, aggregate: list[dict] | None = None) -> DataFrame:
    """Address filter, per-flow rules, window rules: every alert before the cooldown.

    Flows that met a per-flow rule stay out of all windows. Each window rule is tried on its own window length
    (``all_windows`` tries all rules on all windows).
    """
    hit, rest = rules.split_by_rules(ipfilter.drop_filtered(flows), per_flow)
    pane = math.gcd(*sizes)
    # read once into (pane, source, port) sums; all windows and their top sources start from there
    panes = cut_lineage(windows.flow_panes(rest, pane))
    return _with_window_alerts(alerts.flow_alerts(hit), panes, pane, sizes, all_windows, aggregate)


def _with_window_alerts(found: DataFrame, panes: DataFrame, pane: int, sizes: tuple[int, ...], all_windows: bool,
                        aggregate: list[dict] | None) -> DataFrame:
    """``found`` and the alerts of all window rules over sums of ``pane`` seconds."""
    for seconds in sizes:
        these = windows.widen(panes, seconds // pane)
        fired = rules.window_matches(windows.pane_stats(these), aggregate, None if all_windows else f"{seconds}s")
        top = windows.top_list(windows.pane_top_sources(these))
        found = found.unionByName(alerts.window_alerts(fired, top, seconds))
    return found


def rule_alerts(flows: DataFrame, window_names: list[str] | None = None, **kw) -> DataFrame:
    """Alerts of all enabled windows that pass the cooldown per rule."""
    names = config.ENABLED_WINDOWS if window_names is None else window_names
    every = rule_alerts_from_flows(flows, tuple(sorted({config.WINDOW_SECONDS[n] for n in names})), **kw)
    timed = cut_lineage(every.withColumn("us", windows.micros("alert_ts")))  # folded and then looked up again
    return _passed_only(timed, suppress.cooldown(timed, "rule_id", config.RULE_COOLDOWN_SECONDS))


def _passed_only(timed: DataFrame, passed: DataFrame) -> DataFrame:
    # alerts alike in rule, time and id (two flows in one microsecond) stand for one
    named = timed.withColumn("_key", F.concat_ws("#", "rule_id", "alert_id", F.col("us").cast("string")))
    one = alerts.first_of_each(named, ["attacker_ips"], "_key").drop("_key")
    return one.join(passed, ["rule_id", "us", "alert_id"], "left_semi").drop("us")


def model_alerts_from_flows(flows: DataFrame, fitted: PipelineModel, features: list[str], threshold: float = config.SCORE_THRESHOLD,
                            seconds: int = 30, cooldown: int = config.SEVERITY_COOLDOWN_SECONDS, **lists) -> DataFrame:
    """Score flows, sum up the primary window, give it a severity, and keep what passes the cooldown per severity."""
    scored = model.score_flows(fitted, flows, features, threshold, **lists)
    bad = windows.top_sources(scored.filter(F.col("prediction") != "BENIGN"), seconds)
    found = alerts.model_alerts(windows.scored_window_stats(scored, seconds), windows.top_list(bad), seconds)
    passed = suppress.cooldown(found, "severity", cooldown).select("severity", "alert_id")
    return found.join(passed, ["severity", "alert_id"], "left_semi")


# streams -----------------------------------------------------------------------------------------------------

def stream_rule_alerts(flows: DataFrame, path: str, checkpoint: str, delay: str = "2 minutes", window_names: list[str] | None = None,
                       per_flow: list[dict] | None = None, aggregate: list[dict] | None = None, all_windows: bool = False,
                       ts: str = "flow_ts"):
    """The whole rule detector over a stream of raw flows, as ``rule_alerts`` does it; a writer to be started.

    Address filter, per-flow rules, all enabled windows and the cooldown per rule. The source is read once: one
    aggregation sums unmatched flows per (pane, source, port) and passes on when flows met a per-flow rule, grouped
    into the longest window, so all that a window needs comes in the micro-batch that closes it. The cooldown starts
    each micro-batch from the last alert that passed for each rule, kept beside the alerts under the batch number.
    """
    names = config.ENABLED_WINDOWS if window_names is None else window_names
    sizes = tuple(sorted({config.WINDOW_SECONDS[n] for n in names}))
    pane, longest = math.gcd(*sizes), math.lcm(*sizes)
    tagged = rules.per_flow_match(ipfilter.drop_filtered(flows), per_flow).withWatermark(ts, delay)
    hit = F.col("match").isNotNull()
    keyed = tagged.withColumn("dst_port", F.when(~hit, F.col("dst_port")))
    facts = windows._facts(keyed, F.window(ts, f"{longest} seconds").alias("window"), windows.window_number(ts, pane).alias("win"),
                           F.col("match"), F.when(hit, F.col(ts)).alias("seen"))
    sums = facts.groupBy("window", "win", "match", "seen", "src_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("flows"), *[F.sum(c).alias(c) for c in windows._SUMS])

    def each(df: DataFrame, batch: int) -> None:
        spark, closed = df.sparkSession, df.persist()
        last = spark.read.schema("rule_id string, us long").parquet(f"{path}/passed/batch={batch - 1}") if batch else None
        try:
            found = alerts.flow_alerts(closed.filter("match IS NOT NULL").withColumnRenamed("seen", ts), ts)
            panes = closed.filter("match IS NULL").select("win", "src_ip", "dst_port", "flows", *windows._SUMS)
            every = _with_window_alerts(found, panes, pane, sizes, all_windows, aggregate)
            if closed.isEmpty():  # no window ended: nothing to fold, the cooldowns stay as they are
                kept = spark.createDataFrame([], "rule_id string, us long") if last is None else last
                kept.write.mode("overwrite").parquet(f"{path}/passed/batch={batch}")
                every.limit(0).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch}")
                return
            timed = cut_lineage(every.withColumn("us", windows.micros("alert_ts")))
            turns = timed.select("rule_id", "us", "alert_id")
            if last is not None:
                turns = turns.unionByName(last.withColumn("alert_id", F.lit("")))  # an id that no alert has, before all of them
            passed = cut_lineage(suppress.cooldown(
                turns.withColumn("alert_ts", F.timestamp_micros("us")), "rule_id", config.RULE_COOLDOWN_SECONDS))
            passed.groupBy("rule_id").agg(F.max("us").alias("us")).write.mode("overwrite").parquet(f"{path}/passed/batch={batch}")
            _passed_only(timed, passed).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch}")
        finally:
            closed.unpersist()

    return sums.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)



def _per_closed_windows(panes: DataFrame, seconds: int, find, path: str, checkpoint: str):
    """Run ``find`` on the rows of windows the watermark has closed and append what it finds below ``path``.

    In append mode all rows of a window come in one micro-batch, so everything behind this single aggregation is
    ordinary batch work on complete windows. The batch number is part of the folder, so a replayed batch overwrites.
    """
    def each(df: DataFrame, batch: int) -> None:
        closed = df.withColumn("win", windows.window_number("window.start", seconds)).drop("window").persist()
        try:
            find(closed).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        finally:
            closed.unpersist()

    return (panes.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint))


def stream_rule_detector(flows: DataFrame, path: str, checkpoint: str, seconds: int = 60, ts: str = "flow_ts",
                         aggregate: list[dict] | None = None, all_windows: bool = False):
    """Window rules of one length, without cooldown, over a watermarked stream of flows that met no per-flow rule.

    A writer to be started; ``stream_rule_alerts`` is the whole detector.
    """
    facts = windows._facts(flows, F.window(ts, f"{seconds} seconds").alias("window"))
    panes = facts.groupBy("window", "src_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("flows"), *[F.sum(c).alias(c) for c in windows._SUMS])

    def find(closed: DataFrame) -> DataFrame:
        fired = rules.window_matches(windows.pane_stats(closed), aggregate, None if all_windows else f"{seconds}s")
        return alerts.window_alerts(fired, windows.top_list(windows.pane_top_sources(closed)), seconds)

    return _per_closed_windows(panes, seconds, find, path, checkpoint)


def stream_model_detector(scored: DataFrame, path: str, checkpoint: str, seconds: int = 30, ts: str = "flow_ts"):
    """Severity alerts over a watermarked stream of labelled flows; a writer to be started."""
    return _per_closed_windows(_scored_panes(scored, seconds, ts), seconds, lambda closed: _model_alerts_of(closed, seconds), path, checkpoint)


def _scored_panes(scored: DataFrame, seconds: int, ts: str) -> DataFrame:
    """Flows and suspicious flows per window and source: the one stateful aggregation, a state row for each source of an open window."""
    bad = F.col("prediction") != "BENIGN"
    return scored.groupBy(F.window(ts, f"{seconds} seconds").alias("window"), "src_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.count(F.when(bad, 1)).alias("bad"))


def _model_alerts_of(closed: DataFrame, seconds: int) -> DataFrame:
    worst = closed.filter("bad > 0").select("win", "src_ip", F.col("bad").alias("flows"))
    return alerts.model_alerts(windows.scored_pane_stats(closed), windows.top_list(windows.pane_top_sources(worst)), seconds)


def stream_model_alerts(flows: DataFrame, artifacts: str, path: str, checkpoint: str, delay: str = "2 minutes", seconds: int = 30,
                        cooldown: int = config.SEVERITY_COOLDOWN_SECONDS, threshold: float | None = None, ts: str = "flow_ts", **lists):
    """The whole model detector over a stream of raw flows, as ``model_alerts_from_flows`` does it; a writer to be started.

    A saved model scores every flow (``whitelist`` and ``blacklist`` as in ``score_flows``), one aggregation sums up
    (window, source), and closed windows become alerts that pass the cooldown per severity. The cooldown starts each
    micro-batch from the last alert that passed for each severity, kept below ``passed`` under the batch number, so a
    restart, with this model or another, goes on from there. Alerts lie in ``alerts/batch=<n>`` and name their model in
    column ``model``: a batch that is replayed overwrites its own folder, whichever model wrote it.
    """
    spark = flows.sparkSession
    fitted, features, saved = model.load_artifacts(spark, artifacts)
    scored = model.score_flows(fitted, flows, features, saved if threshold is None else threshold, **lists).withWatermark(ts, delay)

    def each(df: DataFrame, batch: int) -> None:
        closed = df.withColumn("win", windows.window_number("window.start", seconds)).drop("window").persist()
        try:
            before = spark.read.schema("severity string, us long").parquet(f"{path}/passed/batch={batch - 1}") if batch else None
            if closed.isEmpty():  # no window closed: what passed before is carried on, and no alert is written
                (before if batch else spark.createDataFrame([], "severity string, us long")).write.mode("overwrite").parquet(f"{path}/passed/batch={batch}")
                _model_alerts_of(closed, seconds).limit(0).withColumn("model", F.lit(fitted.uid)).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch}")
                return
            found = cut_lineage(_model_alerts_of(closed, seconds).withColumn("us", windows.micros("alert_ts")))
            turns = found.select("severity", "us", "alert_id")
            if batch:
                turns = turns.unionByName(before.withColumn("alert_id", F.lit("")))  # an id that no alert has
            passed = cut_lineage(suppress.cooldown(turns.withColumn("alert_ts", F.timestamp_micros("us")), "severity", cooldown))
            passed.groupBy("severity").agg(F.max("us").alias("us")).write.mode("overwrite").parquet(f"{path}/passed/batch={batch}")
            found.drop("us").join(passed.select("severity", "alert_id"), ["severity", "alert_id"], "left_semi").withColumn(
                "model", F.lit(fitted.uid)).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch}")
        finally:
            closed.unpersist()

    panes = _scored_panes(scored, seconds, ts)
    return panes.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
