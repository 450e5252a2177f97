"""Metric series: rates, changes, matching, quantiles, alerts with a holding time.

A series is (name, labels...); its samples have ``ts`` and ``value``. Work is keyed by (series, window) or by
blocks of a series, so one busy series spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.operators.blocks import previous_row, running_totals
from rillwatch.operators.windows import SECOND, micros, window_number

SERIES = ["name", "instance", "device"]


def named(metrics: DataFrame, *names: str) -> DataFrame:
    return metrics.filter(F.col("name").isin(*names))


def keep_matching(metrics: DataFrame, column: str, pattern: str) -> DataFrame:
    """``label =~ pattern``: the whole value has to match."""
    return metrics.filter(F.col(column).rlike(f"^(?:{pattern})$"))


def drop_matching(metrics: DataFrame, column: str, pattern: str) -> DataFrame:
    """``label !~ pattern``."""
    return metrics.filter(~F.col(column).rlike(f"^(?:{pattern})$"))


def counter_rates(metrics: DataFrame, seconds: int, series: list[str] | None = None) -> DataFrame:
    """``increase``, ``rate``, ``irate`` and ``changes`` per series and tumbling window.

    A counter that falls was reset, so it counts from 0 again. Rates divide by the time between the first and
    last sample of the window; one sample gives NULL.
    """
    series = SERIES if series is None else series
    rows = metrics.select(*series, "value", micros("ts").alias("us"), window_number("ts", seconds).alias("win"))
    step = Window.partitionBy(*series, "win").orderBy("us", "value")
    rows = rows.withColumns({"pv": F.lag("value").over(step), "pu": F.lag("us").over(step)})
    delta = F.when(F.col("value") < F.col("pv"), F.col("value")).otherwise(F.col("value") - F.col("pv"))
    gap = (F.col("us") - F.col("pu")) / SECOND
    return rows.withColumns({"d": delta, "last_rate": F.try_divide(delta, gap)}).groupBy(*series, "win").agg(
        F.sum("d").alias("increase"),
        F.try_divide(F.sum("d"), (F.max("us") - F.min("us")) / SECOND).alias("rate"),
        F.max_by("last_rate", F.struct("us", "value")).alias("irate"),
        F.count(F.when(F.col("value") != F.col("pv"), 1)).alias("changes"),
        F.count(F.lit(1)).alias("samples"),
    )


def changes(metrics: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Samples whose value differs from the one before, across the whole series."""
    series = SERIES if series is None else series
    rows = metrics.withColumn("us", micros("ts"))
    seen = previous_row(rows, series, ["us", "value"], ["value"])
    return seen.filter(F.col("value") != F.col("prev.value")).drop("prev")


def match(left: DataFrame, right: DataFrame, value: Column, on: list[str]) -> DataFrame:
    """Arithmetic between two series matched on labels and time; ``l`` and ``r`` are the two values."""
    a = left.select(*on, F.col("value").alias("l"))
    b = right.select(*on, F.col("value").alias("r"))
    return a.join(b, on).select(*on, value.alias("value"))


def or_zero(points: DataFrame, spine: DataFrame, on: str, value: str) -> DataFrame:
    """Every point of the time spine, 0 where ``points`` has none."""
    return spine.join(points, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def spine(df: DataFrame, win: str) -> DataFrame:
    """All window numbers from the first to the last one present."""
    ends = df.agg(F.min(win).alias("lo"), F.max(win).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias(win))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts per key and upper bound, the last bound being infinity."""
    one = df.groupBy(*keys).agg(
        *[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias(f"b{len(bounds)}"), F.sum(value).alias("total"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate([*bounds, float("inf")])]
    return one.select(*keys, "total", F.inline(F.array(*cells)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it; above the last bound, that bound."""
    by_bound = Window.partitionBy(*keys).orderBy("le")  # one row per configured bound
    rows = buckets.withColumns({
        "lower": F.coalesce(F.lag("le").over(by_bound), F.lit(0.0)),
        "below": F.coalesce(F.lag("cum").over(by_bound), F.lit(0)),
        "n": F.max("cum").over(Window.partitionBy(*keys)),
    })
    rank = F.lit(q) * F.col("n")
    inside = F.when(
        F.col("le") == float("inf"), F.col("lower")
    ).otherwise(F.col("lower") + (F.col("le") - F.col("lower")) * F.try_divide(rank - F.col("below"), F.col("cum") - F.col("below")))
    return rows.filter(F.col("cum") >= rank).groupBy(*keys).agg(F.min_by(inside, "le").alias("value"))


def holding(points: DataFrame, keys: list[str], condition: Column, seconds: float | str, order: str = "us") -> DataFrame:
    """Stretches over which ``condition`` holds at every point, at least ``seconds`` long (a number, or a column
    that is the same for all points of a key).

    A break count (running totals) numbers the stretches; each is then summed up map-side.
    """
    hold = F.col(seconds) if isinstance(seconds, str) else F.lit(seconds)
    rows = points.select(*keys, order, F.coalesce(condition, F.lit(False)).alias("_ok"), hold.alias("_hold"))
    rows = rows.withColumn("_break", F.when(F.col("_ok"), 0).otherwise(1))
    numbered = running_totals(rows, keys, order, {"_run": "_break"})
    spans = numbered.filter("_ok").groupBy(*keys, "_run").agg(
        F.min(order).alias("since"), F.max(order).alias("until"), F.count(F.lit(1)).alias("points"), F.max("_hold").alias("_hold"))
    return spans.filter(F.col("until") - F.col("since") >= F.col("_hold") * SECOND).drop("_run", "_hold")


def running_counter(events: DataFrame, labels: list[str], ts: str, step: str | None = None) -> DataFrame:
    """A counter per label set that grows with every event (or by column ``step``)."""
    rows = events.withColumns({"us": micros(ts), "_step": F.col(step) if step else F.lit(1)})
    return running_totals(rows, labels, "us", {"value": "_step"}).drop("_step")
