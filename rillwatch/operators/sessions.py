"""Bursts and flow assembly: splitting a key's rows at pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.operators.blocks import BLOCK, _over_blocks, block_of, row_blocks
from rillwatch.operators.windows import SECOND, micros


def mark_sessions(df: DataFrame, keys: list[str], us: str, tie: str, gap_us: int, block_us: int | None = None) -> DataFrame:
    """Adds ``session`` (the start of the row's session, in microseconds) and ``prev_us`` (the row before, any session).

    A pause longer than the gap starts a new session. Rows are compared inside (key, block); along a key only one
    summary per block is carried: its first and last row and where its last session began. Blocks have equally many
    rows, or a width of ``block_us``.
    """
    ids = [*keys, BLOCK]
    inside = Window.partitionBy(*ids).orderBy(us, tie)
    cut = row_blocks(df, keys, [us, tie]) if block_us is None else df.withColumn(BLOCK, block_of(us, block_us))
    local = cut.withColumn("_pu", F.lag(us).over(inside))
    starts = F.when(F.col(us) - F.col("_pu") > gap_us, F.col(us))
    along = _over_blocks(keys)
    edges = local.groupBy(*ids).agg(F.min(us).alias("_first"), F.max(us).alias("_last"), F.max(starts).alias("_start"))
    edges = edges.withColumn("_before", F.lag("_last").over(along))
    opens = F.when(F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap_us), F.col("_first"))
    edges = edges.withColumn("_opens", opens)
    carried = F.last(F.coalesce("_start", "_opens"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    heads = edges.select(*ids, "_before", F.coalesce(F.col("_opens"), carried).alias("_head"))
    upto = Window.partitionBy(*ids).orderBy(us)  # rows of the same instant together, whatever their order
    return local.join(heads, ids).withColumns({
        "session": F.coalesce(F.max(starts).over(upto), F.col("_head")), "prev_us": F.coalesce("_pu", "_before"),
    }).drop("_pu", "_before", "_head", BLOCK)


def bursts(flows: DataFrame, gap_seconds: int = 60, key: str = "src_ip", ts: str = "flow_ts", tie: str = "flow_id") -> DataFrame:
    """Bursts per source: first and last seen and flows."""
    rows = flows.select(key, tie, micros(ts).alias("us"))
    parts = mark_sessions(rows, [key], "us", tie, gap_seconds * SECOND)
    return parts.groupBy(key, F.col("session").alias("first_us")).agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("flows"))


def drop_late(rows: DataFrame, arrival: str, ts: str, seconds: int) -> DataFrame:
    """Rows not older than the newest event time seen before them (in arrival order, a unique number) minus ``seconds``."""
    facts = row_blocks(rows.withColumn("_us", micros(ts)), [], [arrival])
    tops = facts.groupBy(BLOCK).agg(F.max("_us").alias("_top"))
    carried = tops.select(BLOCK, F.max("_top").over(_over_blocks([]).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy(BLOCK).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.greatest(F.max("_us").over(inside), F.col("_before"))
    out = facts.join(carried, BLOCK).withColumn("_newest", newest)
    return out.filter(F.col("_newest").isNull() | (F.col("_us") >= F.col("_newest") - seconds * SECOND)).drop("_us", "_newest", "_before", BLOCK)


def packets_to_flows(packets: DataFrame, idle_seconds: int = 60, active_seconds: float = 5.0) -> DataFrame:
    """Packets to flow records per 5-tuple in both directions; a pause longer than ``idle_seconds`` starts a new flow.

    Forward is the direction of the flow's first packet. Gaps above ``active_seconds`` count as idle time.
    """
    us = micros("pkt_ts")
    here, there = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    rows = packets.select(
        F.least(here, there).alias("end_a"), F.greatest(here, there).alias("end_b"), "protocol", us.alias("us"), "pkt_id",
        "src_ip", "dst_ip", "src_port", "dst_port", (here <= there).alias("a_to_b"), F.col("length").cast("long").alias("length"), F.col("syn").cast("long").alias("syn"))
    keys = ["end_a", "end_b", "protocol"]
    parts = mark_sessions(rows, keys, "us", "pkt_id", idle_seconds * SECOND)
    pause = F.col("us") - F.col("prev_us")
    gap = F.when(pause <= idle_seconds * SECOND, pause)
    idle = F.when(gap > int(active_seconds * SECOND), gap)
    first = F.struct("us", "pkt_id")
    way = lambda flag, c: F.sum(F.when(F.col("a_to_b") == flag, c).otherwise(0))
    flows = parts.withColumns({"gap": gap, "idle": idle}).groupBy(*keys, "session").agg(
        F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port", "a_to_b"), first).alias("f"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        way(True, F.lit(1)).alias("n_ab"), way(False, F.lit(1)).alias("n_ba"), way(True, F.col("length")).alias("len_ab"), way(False, F.col("length")).alias("len_ba"),
        F.avg("length").alias("pkt_len_mean"), F.coalesce(F.stddev("length"), F.lit(0.0)).alias("pkt_len_std"),
        F.min("length").alias("pkt_len_min"), F.max("length").alias("pkt_len_max"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("flow_iat_mean"), F.coalesce(F.stddev("gap"), F.lit(0.0)).alias("flow_iat_std"),
        F.coalesce(F.min("gap"), F.lit(0)).alias("flow_iat_min"), F.coalesce(F.max("gap"), F.lit(0)).alias("flow_iat_max"),
        F.sum("syn").alias("syn_flag_cnt"),
        F.coalesce(F.avg("idle"), F.lit(0.0)).alias("idle_mean"), F.coalesce(F.max("idle"), F.lit(0)).alias("idle_max"))
    fwd = F.col("f.a_to_b")
    return flows.select(
        "f.src_ip", "f.dst_ip", "f.src_port", "f.dst_port", "protocol", "first_us", (F.col("last_us") - F.col("first_us")).alias("flow_duration"),
        F.when(fwd, F.col("n_ab")).otherwise(F.col("n_ba")).alias("tot_fwd_pkts"), F.when(fwd, F.col("n_ba")).otherwise(F.col("n_ab")).alias("tot_bwd_pkts"),
        F.when(fwd, F.col("len_ab")).otherwise(F.col("len_ba")).alias("totlen_fwd_pkts"), F.when(fwd, F.col("len_ba")).otherwise(F.col("len_ab")).alias("totlen_bwd_pkts"),
        "pkt_len_mean", "pkt_len_std", "pkt_len_min", "pkt_len_max", "flow_iat_mean", "flow_iat_std", "flow_iat_min", "flow_iat_max",
        "syn_flag_cnt", "idle_mean", "idle_max")
