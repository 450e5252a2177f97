"""Rows that come too late: dropped by the watermark of a stateful operator, counted, and kept as a side output."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener


class DroppedRows(StreamingQueryListener):
    """How many rows the stateful operators of the streaming queries called ``name`` dropped as late, by run and batch."""

    def __init__(self, name: str):
        self.name, self.ended, self._seen = name, threading.Event(), {}

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name:
            self._seen[(str(p.runId), p.batchId)] = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event):
        self.ended.set()

    @property
    def total(self) -> int:
        return sum(self._seen.values())


def without_late(rows: DataFrame, ts: str, delay: str, id_col: str) -> DataFrame:
    """Rows of a stream that the watermark lets through, each id once.

    A row is late if its time is not after the watermark that the engine works with when its batch begins: the newest time of
    the batches before the previous one, minus ``delay``, in whole milliseconds. Rows without a time are late.
    """
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def run_without_late(rows: DataFrame, ts: str, delay: str, id_col: str, name: str, out: str, checkpoint: str) -> tuple[DataFrame, int]:
    """Runs ``without_late`` over all that is there; the kept rows, and how many were dropped in this run."""
    spark, dropped = rows.sparkSession, DroppedRows(name)
    spark.streams.addListener(dropped)
    try:
        query = (without_late(rows, ts, delay, id_col).writeStream.queryName(name).outputMode("append")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
        query.awaitTermination()
        dropped.ended.wait(60)  # events arrive in order, after the fact
    finally:
        spark.streams.removeListener(dropped)
    return spark.read.schema(rows.schema).parquet(out), dropped.total


def side_output(arrived: DataFrame, kept: DataFrame, id_col: str) -> DataFrame:
    """What arrived and was not kept."""
    return arrived.join(kept.select(id_col), id_col, "left_anti")
