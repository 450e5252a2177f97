"""Profiles of a table, each from one aggregation pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwatch import config
from rillwatch.operators.quantiles import exact_quantiles
from rillwatch.schema import numeric_columns
from rillwatch.session import cut_lineage


def _per_column(df: DataFrame, conditions: dict, name: str) -> DataFrame:
    """Counts of rows meeting a condition per column, as rows, only those above 0."""
    if not conditions:
        return df.sparkSession.createDataFrame([], f"column_name string, {name} long")
    one = df.agg(*[F.count(F.when(cond, 1)).alias(c) for c, cond in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias(name)) for c in conditions])
    return one.select(F.inline(pairs)).filter(F.col(name) > 0)


def missing(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return _per_column(df, {
        c: F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`") if c in floats else F.col(f"`{c}`").isNull() for c in df.columns
    }, "missing")


def infinite(df: DataFrame) -> DataFrame:
    return _per_column(df, {c: F.abs(F.col(f"`{c}`").cast("double")) == float("inf") for c in numeric_columns(df)}, "infinite")


def negative(df: DataFrame) -> DataFrame:
    return _per_column(df, {c: F.col(f"`{c}`") < 0 for c in numeric_columns(df)}, "negative")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row. Copies collapse map-side, so a group of copies costs nothing extra."""
    return df.groupBy(*[f"`{c}`" for c in df.columns]).agg((F.count(F.lit(1)) - 1).alias("_extra")).agg(
        F.coalesce(F.sum("_extra"), F.lit(0)).cast("long").alias("duplicate_rows")
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def label_column(df: DataFrame, names: list[str] | None = None) -> str | None:
    return next((c for c in (names or config.LABEL_NAMES) if c in df.columns), None)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per label. The total comes from the label counts, not from a second scan."""
    counts = cut_lineage(df.groupBy(F.col(label).alias("label_value")).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.select("label_value", "n", F.round(F.col("n") * 100.0 / F.lit(total), 3).alias("percent"))


def numeric_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per numeric column, one row each."""
    cols = numeric_columns(df) if cols is None else cols
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    one = df.agg(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count(f"`{c}`").alias("n"), F.avg(f"`{c}`").alias("mean"),
            F.stddev(f"`{c}`").alias("std"), F.min(F.col(f"`{c}`").cast("double")).alias("min"),
            *[F.lit(q).cast("double").alias(n) for n, q in zip(("p25", "p50", "p75"), quartiles[c])],
            F.max(F.col(f"`{c}`").cast("double")).alias("max"),
        ).alias(f"c{i}")
        for i, c in enumerate(cols)
    ])
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])))


def balance_report(sets: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """Per data set: rows, benign, attacks, percentages and attacks per benign row."""
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("dataset"), F.col(label).alias("y")) for n, df in sets.items()])
    counted = tagged.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("y") == 0, 1)).alias("benign"),
        F.count(F.when(F.col("y") == 1, 1)).alias("attack"),
    )
    return counted.withColumns({
        "benign_pct": F.round(F.col("benign") * 100.0 / F.col("total"), 2),
        "attack_pct": F.round(F.col("attack") * 100.0 / F.col("total"), 2),
        "attack_per_benign": F.round(F.try_divide(F.col("attack").cast("double"), F.col("benign")), 2),
    })
