"""Repeatable samples and splits of an exact size, without sorting the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.operators.clean import binary_label
from rillwatch.session import cut_lineage

#: rows that a stretch of the hashes holds on average
STRETCH = 100_000

#: up to so many groups are broadcast to the rows
FEW_GROUPS = 10_000


def id_hash(id_col: str) -> Column:
    """The id's md5; equal ids, and in practice no others, have equal ones."""
    return F.md5(F.col(id_col).cast("string").cast("binary"))


def _broadcast_if_few(groups: DataFrame) -> DataFrame:
    """One row a group, measured: a few keys with all the rows keep many partitions empty, and then Spark broadcasts by itself no more."""
    groups = cut_lineage(groups)
    return F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups


def _edges(df: DataFrame, id_col: str, group: Column, wanted: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """g, edge: for each group the largest (hash, id) among its ``wanted(n)`` rows of smallest hashes; no row if it wants none.

    Hashes are spread evenly, so stretches of equal length hold about the same number of rows. Rows are counted per
    stretch, and only those of the one stretch in which a group's count is reached are looked at one by one. Nothing
    goes through the driver, whatever the number of groups is. Also whether there are more rows than a stretch holds.
    """
    rows = df.select(group.alias("g"), F.struct(id_hash(id_col).alias("h"), F.col(id_col).alias("id")).alias("at")).filter("g IS NOT NULL")
    count = rows.count()
    stretches = max(1, min(count // STRETCH + 1, 1 << 28))
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("at.h", 1, 13), 16, 10).cast("double") * (stretches / 2.0 ** 52)).cast("long"))
    per = cut_lineage(rows.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = per.groupBy("g").agg(F.sum("n").alias("size")).withColumn("want", wanted(F.col("size")))
    open_ = per.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sizes, "g").filter(
        "want > 0 AND below < want AND below + n >= want").select("g", "part", (F.col("want") - F.col("below")).alias("left"))
    # equal ids are counted together first
    near = rows.join(_broadcast_if_few(open_) if count > STRETCH else open_, ["g", "part"]).groupBy("g", "at").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("left"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("at"))
    return near.withColumn("upto", upto).filter("upto >= left").groupBy("g").agg(F.min("at").alias("edge")), count > STRETCH


def _among_smallest(df: DataFrame, id_col: str, wanted: Callable[[Column], Column]) -> Column:
    """A condition that holds for the ``wanted(n)`` rows of smallest id hash out of the ``n`` of ``df``; one row reaches the driver."""
    found = _edges(df, id_col, F.lit(0), wanted)[0].select("edge.h", "edge.id").first()
    if found is None:
        return F.lit(False)
    return F.struct(id_hash(id_col), F.col(id_col)) <= F.struct(F.lit(found.h), F.lit(found.id).cast(df.schema[id_col].dataType))


def exact_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """``n`` rows chosen by id hash: repeatable and independent of order and partitions."""
    return df.filter(_among_smallest(df, id_col, lambda size: F.least(size, F.lit(n))))


def stratified_split(df: DataFrame, id_col: str, label: str, share: float = 0.1) -> DataFrame:
    """Adds ``is_validation``: per label, the ``share`` of rows with the smallest id hashes; rows without a label are in none.

    A few labels hold all rows, so more rows than a stretch holds are not dealt out by label: one edge per label goes to where
    they are. Only fewer rows, or labels by the ten thousand, are left to a plain join.
    """
    edges, many = _edges(df, id_col, F.col(label), lambda size: F.floor(size * F.lit(float(share))))
    edges = edges.withColumnsRenamed({"g": "_g", "edge": "_edge"})
    if many:
        edges = _broadcast_if_few(edges)
    own = F.struct(id_hash(id_col).alias("h"), F.col(id_col).alias("id")) <= F.col("_edge")
    return df.join(edges, F.col(label) == F.col("_g"), "left").withColumn("is_validation", F.coalesce(own, F.lit(False))).drop("_g", "_edge")


def mix_attacks(train: DataFrame, other: DataFrame, id_col: str, label: str = "y", share: float = 0.03) -> DataFrame:
    """``train`` plus a share of the other set's attacks, at least one."""
    attacks = other.filter(F.col(label) == 1)
    picked = _among_smallest(attacks, id_col, lambda size: F.least(size, F.greatest(F.lit(1), F.floor(size * F.lit(float(share))))))
    return train.unionByName(attacks.filter(picked), allowMissingColumns=True)


def attacks_and_benign(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("y", binary_label(F.col(label)))
