"""Where results go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwatch.sources.topics import MICROS


def run_once(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> DataFrame:
    """Process all that is there, then stop; the written table."""
    query = (stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).format(fmt).load(path)


def write_branches(df: DataFrame, branches: dict[str, DataFrame], base: str, batch: int) -> None:
    """Every branch of one input to its own folder, the batch number in the path so a replayed batch overwrites."""
    df.persist()
    try:
        for name, part in branches.items():
            part.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
    finally:
        df.unpersist()


def fan_out(flows: DataFrame, split, base: str, checkpoint: str):
    """Start a stream that sends each flow either to ``alerts`` or to ``for_model``.

    ``split(df)`` gives the two branches. The micro-batch is read once and written twice.
    """
    def each(df: DataFrame, batch: int) -> None:
        df = df.persist()
        hit, rest = split(df)
        write_branches(df, {"alerts": hit, "for_model": rest}, base, batch)

    return flows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_csv_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", MICROS).csv(path)


def upsert(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those with the same key; the others stay. Write the result to a new folder."""
    return old.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def expire(states: DataFrame, as_of_us: int) -> DataFrame:
    """Records whose time has not run out."""
    return states.filter(F.col("expires_us").isNull() | (F.col("expires_us") > as_of_us))


def stream_table(changes: DataFrame, key: str, order: str, gone: Column, path: str, checkpoint: str, mode: str = "update"):
    """A table kept up to date by a stream of changes; a writer to be started.

    Each micro-batch writes ``rows/version=<batch>``: the version before, with the last change (by ``order``) of each
    ``key`` in place of its row, and without rows for which ``gone`` holds; then it writes the version's number below
    ``done``. A batch that is replayed writes its version anew from the same one before it. The table has a row for
    each key that lives, so it is small beside the stream.
    """
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        last = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_row")).select("_row.*").persist()
        try:
            old = spark.read.schema(df.schema).parquet(f"{path}/rows/version={batch - 1}") if batch else last.limit(0)
            upsert(old, last, key).filter(~gone).write.mode("overwrite").parquet(f"{path}/rows/version={batch}")
            spark.range(batch, batch + 1).write.mode("overwrite").parquet(f"{path}/done/version={batch}")
        finally:
            last.unpersist()

    return changes.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)


def latest_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest version that ``stream_table`` has finished; its first micro-batch must have ended."""
    version = spark.read.parquet(f"{path}/done").agg(F.max("id")).first()[0]
    return spark.read.schema(schema).parquet(f"{path}/rows/version={version}")
