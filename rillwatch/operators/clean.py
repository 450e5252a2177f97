"""Cleaning of flow tables and labelled sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwatch import config
from rillwatch.operators.quantiles import exact_quantiles
from rillwatch.schema import is_number, numeric_columns


def finite(c: Column) -> Column:
    """The value, NULL where it is NaN or infinite."""
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def _is_float(dtype) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def clean_for_topic(df: DataFrame) -> DataFrame:
    """Infinities and gaps become 0, numbers become doubles; text gaps become '0'."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if _is_float(f.dataType):
            c = F.coalesce(finite(c), F.lit(0.0)).cast("double")
        elif is_number(f.dataType):
            c = F.coalesce(c.cast("double"), F.lit(0.0))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit("0"))
        cols.append(c.alias(f.name))
    return df.select(cols)


def impute_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Infinities and gaps of numeric columns become the column's exact median."""
    cols = numeric_columns(df) if cols is None else cols
    medians = exact_quantiles(df, cols, [0.5])
    types = {f.name: f.dataType for f in df.schema.fields}
    fill = {}
    for c in cols:
        value = finite(F.col(f"`{c}`")) if _is_float(types[c]) else F.col(f"`{c}`").cast("double")
        mid = medians[c][0]
        fill[c] = value if mid is None else F.coalesce(value, F.lit(mid))
    return df.withColumns(fill)


def clean_labeled(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Median fill, then exact duplicates dropped."""
    return impute_median(df, cols).dropDuplicates()


def binary_label(label: Column) -> Column:
    """0 for benign in any case, 1 for everything else, missing labels included."""
    return F.when(F.lower(label) == "benign", 0).otherwise(1)


def tidy_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "", name.strip().replace(" ", "_")).lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[tidy_name(c) for c in df.columns])


def rename_columns(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(config.TRAINING_RENAMES if names is None else names)


def drop_unimportant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.drop(*(config.UNIMPORTANT_COLUMNS if cols is None else cols))


def clip_nonnegative(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = config.NEVER_NEGATIVE if cols is None else cols
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: F.when(F.col(c) < 0, F.lit(0).cast(types[c])).otherwise(F.col(c)) for c in cols if c in types
    })


def common_columns(a: DataFrame, b: DataFrame, label: str = "label") -> list[str]:
    """Columns of both, in the order of the first, without the label."""
    return [c for c in a.columns if c in b.columns and c != label]


def common_numeric(a: DataFrame, b: DataFrame, label: str = "label") -> list[str]:
    return [c for c in numeric_columns(a) if c in numeric_columns(b) and c != label]


def first_existing(df: DataFrame, names: list[str]) -> Column:
    """The first of ``names`` that ``df`` has, with gaps as 0; 0 if it has none."""
    name = next((n for n in names if n in df.columns), None)
    return F.lit(0) if name is None else F.coalesce(F.col(f"`{name}`"), F.lit(0))


def to_number(c: Column) -> Column:
    """Text as a number; what is no number becomes 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def prepare_labeled(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both labelled sets from raw to trainable: tidy names, clean, binary label, clean again, rename the second
    to the first's names, keep shared columns, drop weak ones and clip."""
    def first_pass(df):
        df = clean_labeled(normalize_columns(df))
        return clean_labeled(df.withColumn("label", binary_label(F.col("label"))))

    left, right = first_pass(a), rename_columns(first_pass(b))
    shared = [*common_columns(left, right), "label"]
    return tuple(clip_nonnegative(drop_unimportant(df.select(shared))) for df in (left, right))
