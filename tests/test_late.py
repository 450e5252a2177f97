"""Late rows on a real stream, and the life of flow files that a stream reads and deletes."""

import os

from pyspark.sql import functions as F

from rillwatch.schema import FLOW
from rillwatch.session import run_dir
from rillwatch.sources import files, sinks
from rillwatch.streaming import late

BASE = 1_704_067_200_000_000


def land(spark, path, rows):
    spark.createDataFrame(rows, "id long, s double").select("id", F.timestamp_micros((F.lit(BASE) + F.col("s") * 1e6).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(path)


def test_kept_dropped_and_side_output_add_up_over_a_restart(spark):
    where = run_dir(spark, "late-test")
    schema = "id long, ts timestamp"
    land(spark, f"{where}/in", [(1, 0.0), (2, 100.0)])
    land(spark, f"{where}/in", [(3, 10.0), (4, 120.0)])  # the mark of the first file holds from the third on
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    kept, dropped = late.run_without_late(stream(), "ts", "30 seconds", "id", "late_a", f"{where}/out", f"{where}/check")
    assert (sorted(r.id for r in kept.collect()), dropped) == ([1, 2, 3, 4], 0)
    land(spark, f"{where}/in", [(5, 20.0), (6, 130.0), (7, 95.0)])
    land(spark, f"{where}/in", [(8, 60.0)])
    kept, dropped = late.run_without_late(stream(), "ts", "30 seconds", "id", "late_a", f"{where}/out", f"{where}/check")
    arrived = spark.read.schema(schema).parquet(f"{where}/in")
    gone = sorted(r.id for r in late.side_output(arrived, kept, "id").collect())
    assert gone == [5, 8] and dropped == 2
    assert kept.count() + dropped == arrived.count()


def test_flow_files_land_thrice_and_are_deleted(spark):
    """Each file is read once although the stream stops between the landings; files of earlier runs are gone."""
    where = run_dir(spark, "landing-test")

    def landing(i):
        row = {f.name: None for f in FLOW.fields}
        df = spark.createDataFrame([tuple(row.values())], FLOW).withColumn("src_ip", F.lit(f"10.0.0.{i}")).withColumn("src_port", F.lit(i))
        df.coalesce(1).write.option("header", True).mode("append").csv(f"{where}/in")

    def present():
        return [f for f in os.listdir(f"{where}/in") if f.endswith(".csv")]

    for i in range(3):
        landing(i)
        stream = files.stream_flow_files(spark, f"{where}/in", clean="delete", pattern="*.csv")
        out = sinks.run_once(stream, f"{where}/out", f"{where}/check")
    assert sorted(r.src_ip for r in out.collect()) == ["10.0.0.0", "10.0.0.1", "10.0.0.2"]
    assert len(present()) < 3
