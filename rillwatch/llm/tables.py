"""Reading, staging and Arrow helpers that the text operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwatch.session import run_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: later steps survive lost executors without redoing it.

    What the written plan shuffled is not needed any more; the engine deletes it once the driver has let go of it.
    """
    spark, schema = df.sparkSession, df.schema
    path = run_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns of any name do no harm; a NULL text is empty."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the rows kept away from learning: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def per_batch(df: DataFrame, step: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 2000) -> DataFrame:
    """Applies ``step`` to slices of at most ``rows`` rows of each Arrow batch; it returns columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = step(batch.slice(at, rows))
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def once(key, make: Callable[[], object]):
    """What ``make`` returns, made once in each Python process and kept for its later tasks.

    The package's functions travel with their tasks, so their own module variables would start anew in each task.
    """
    kept = sys.modules.setdefault("_rillwatch_once", types.ModuleType("_rillwatch_once")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
