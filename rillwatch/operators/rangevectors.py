"""Range and instant vectors over labelled series, evaluated at steps.

A sample has ``name``, ``labels`` (a map), ``series`` (name and labels in one canonical text), ``us`` and ``value``. A
range function looks back over overlapping ranges at every step. Samples and steps are never paired: running totals
of the increase, with resets counted in, are looked up twice for each step, at the last sample up to the step and at
the first one inside its range. All of it works on blocks of a series, so one busy series spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwatch.operators.blocks import nearest, previous_row, running_totals
from rillwatch.operators.windows import SECOND
from rillwatch.session import cut_lineage

#: an instant vector sees a series' last sample for this long
STALE_SECONDS = 300


def series_key(name: Column, labels: Column) -> Column:
    """Name and labels as one text; the order in which labels were given plays no part."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e.key, F.lit("="), F.to_json(F.struct(e.value.alias("v")))))
    return F.concat(F.coalesce(name, F.lit("")), F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def labelled(df: DataFrame, labels: list[str], name: str = "name", us: str = "us", value: str = "value") -> DataFrame:
    """Samples from a table with one column for each label; an empty or NULL label is none."""
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in labels]),
                       lambda e: F.coalesce(e.value, F.lit("")) != "")
    out = df.select(F.col(name).alias("name"), F.map_from_entries(entries).alias("labels"), F.col(us).alias("us"), F.col(value).alias("value"))
    return out.withColumn("series", series_key(F.col("name"), F.col("labels")))


def select(samples: DataFrame, name: str, *matchers: tuple[str, str, str]) -> DataFrame:
    """``name{matchers}``: (label, ``=``, ``!=``, ``=~`` or ``!~``, text). Patterns match whole values; a label that is not there is empty."""
    out = samples.filter(F.col("name") == name)
    for label, how, text in matchers:
        value = F.coalesce(F.col("labels")[label], F.lit(""))
        fits = value == text if how in ("=", "!=") else value.rlike(f"^(?:{text})$")
        out = out.filter(fits if how in ("=", "=~") else ~fits)
    return out


def steps_after(samples: DataFrame, keys: list[str], step_us: int, back_us: Column | int, width: int) -> DataFrame:
    """``keys`` and ``at``: the steps at which a range of ``back_us`` can hold a sample, and some after them without any.

    They come from the blocks that have samples, so neither a gap nor a long life of a series makes a long list.
    """
    back = back_us if isinstance(back_us, Column) else F.lit(back_us)
    blocks = samples.groupBy(*keys, F.floor(F.col("us") / width).cast("long").alias("_b")).agg(F.max(back).alias("_back"))
    more = blocks.select(*keys, F.explode(F.sequence(F.col("_b"), F.col("_b") + F.ceil(F.col("_back") / width).cast("long") + 1)).alias("_b")).distinct()
    return more.select(*keys, F.explode(F.sequence(F.col("_b") * (width // step_us), (F.col("_b") + 1) * (width // step_us) - 1)).alias("_s")).select(
        *keys, (F.col("_s") * step_us).alias("at"))


def range_values(samples: DataFrame, keys: list[str], seconds: Column | float, step: float = 15, block_seconds: float = 300) -> DataFrame:
    """``keys``, ``at``, ``increase`` and ``rate`` over [at - seconds, at] at every step; NULL where a range has fewer than two samples.

    ``seconds`` is a number or a column that is the same for all samples of a key. A counter that falls was reset and
    counts from 0. As in the usual definition the increase is carried on to the ends of the range: by half the mean gap
    between samples where an end is more than 1.1 gaps away, and never to before the counter was 0. One sample per key
    and time counts: the largest.
    """
    step_us, width = int(step * SECOND), int(block_seconds * SECOND)
    if width % step_us:
        raise ValueError("blocks must hold whole steps")
    range_us = ((seconds if isinstance(seconds, Column) else F.lit(seconds)) * SECOND).cast("long")
    # written where it is read several times: each block operator reads its input for the blocks' sums and for the rows
    rows = cut_lineage(samples.groupBy(*keys, "us").agg(F.max("value").alias("value"), F.max(range_us).alias("_range")))
    prev = F.col("prev.value")
    seen = previous_row(rows, keys, ["us"], ["value"], width).select(
        *keys, "us", "value", "_range", F.lit(1).alias("_one"),
        F.when(prev.isNull(), 0.0).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev).alias("_step"))
    totals = cut_lineage(running_totals(cut_lineage(seen), keys, "us", {"total": "_step", "nth": "_one"}, width))
    asked = steps_after(rows, keys, step_us, F.col("_range"), width).join(rows.groupBy(*keys).agg(F.max("_range").alias("_range")), keys)
    cols = ["us", "value", "total", "nth"]
    found = cut_lineage(nearest(totals, cut_lineage(asked), keys, "us", "at", cols, width, "last"))
    found = nearest(totals, found.withColumn("_from", F.col("at") - F.col("_range")), keys, "us", "_from", cols, width, "first", following=True)
    n = F.col("last.nth") - F.col("first.nth") + 1
    grown, span = F.col("last.total") - F.col("first.total"), (F.col("last.us") - F.col("first.us")) / SECOND
    gap = span / (n - 1)
    to_start, to_end = (F.col("first.us") - F.col("_from")) / SECOND, (F.col("at") - F.col("last.us")) / SECOND
    start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
    start = F.when((grown > 0) & (F.col("first.value") >= 0), F.least(start, span * F.try_divide(F.col("first.value"), grown))).otherwise(start)
    end = F.when(to_end >= gap * 1.1, gap / 2).otherwise(to_end)
    increase = F.when(n >= 2, grown * (span + start + end) / span)
    return found.select(*keys, "at", increase.alias("increase"), (increase / (F.col("_range") / SECOND)).alias("rate"))


def instant_values(samples: DataFrame, keys: list[str], step: float = 15, stale_seconds: float = STALE_SECONDS, block_seconds: float = 300) -> DataFrame:
    """``keys``, ``at`` and ``value``: a series' last sample up to each step, NULL if it is older than ``stale_seconds``."""
    step_us, width, stale = int(step * SECOND), int(block_seconds * SECOND), int(stale_seconds * SECOND)
    rows = cut_lineage(samples.groupBy(*keys, "us").agg(F.max("value").alias("value")))
    found = nearest(rows, steps_after(rows, keys, step_us, stale, width), keys, "us", "at", ["us", "value"], width, "last")
    return found.select(*keys, "at", F.when(F.col("at") - F.col("last.us") <= stale, F.col("last.value")).alias("value"))


def combine(left: DataFrame, right: DataFrame, value: Column, ignoring: tuple[str, ...] = ()) -> DataFrame:
    """``left op ignoring(...) right`` at equal steps: rows of ``labels``, ``at`` and ``value``, an expression over ``l`` and ``r``.

    Both sides have ``labels``, ``at`` and ``value``. Series match if their labels without ``ignoring`` are the same;
    names play no part. Each side must have one series for a set of labels and a step, else rows multiply.
    """
    def side(df, name):
        kept = F.map_filter("labels", lambda k, _: ~k.isin(*ignoring)) if ignoring else F.col("labels")
        return df.filter(F.col("value").isNotNull()).select(series_key(F.lit(""), kept).alias("_k"), kept.alias(f"_{name}"), "at", F.col("value").alias(name))

    both = side(left, "l").join(side(right, "r").drop("_r"), ["_k", "at"])
    return both.select(F.col("_l").alias("labels"), "at", value.alias("value"))


def firing(points: DataFrame, keys: list[str], block_seconds: float = 300) -> DataFrame:
    """Alerts of ``points`` (``keys``, ``at``, ``ok``, ``hold`` seconds): since, fired, until and number of firing steps.

    A step without a value, or one that was not evaluated, ends an alert. It fires at the first step that is ``hold``
    after the one at which it began.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    rows = points.select(*keys, F.col("at").alias("us"), ok.alias("_ok"), F.when(ok, 0).otherwise(1).alias("_break"),
                         (F.col("hold") * SECOND).cast("long").alias("_hold"))
    rows = cut_lineage(rows)
    numbered = running_totals(rows, keys, "us", {"_run": "_break"}, int(block_seconds * SECOND)).filter("_ok")
    begun = numbered.groupBy(*keys, "_run").agg(F.min("us").alias("since"), F.max("us").alias("until"), F.max("_hold").alias("_hold"))
    late = numbered.join(begun.select(*keys, "_run", "since"), [*keys, "_run"]).filter(F.col("us") - F.col("since") >= F.col("_hold"))
    return late.groupBy(*keys, "_run").agg(F.min("since").alias("since"), F.min("us").alias("fired"), F.max("us").alias("until"),
                                           F.count(F.lit(1)).alias("steps")).drop("_run")
