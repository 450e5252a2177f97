"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(app: str = "rillwatch", **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; ``conf`` and what spark-submit or the cluster set win over these."""
    builder, given = SparkSession.builder.appName(app), dict(SparkConf().getAll())
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # methods above 8000 bytes of bytecode are never compiled by the JVM; give those stages up for plain operators
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    for key, value in {**{k: v for k, v in defaults.items() if k not in given}, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    In local mode, where one machine does everything, a temporary folder takes its place if it is unset; on a cluster
    that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rillwatch-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for a written table or a stream checkpoint."""
    return f"{shared_dir(spark)}/rillwatch/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise ``df`` reliably (replicated storage), so a lost executor costs no long recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
