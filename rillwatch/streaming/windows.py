"""Window statistics over a stream of flows, in append mode behind a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwatch.operators.windows import _SUMS, STAT_NAMES, _facts


def _window(ts: str, seconds: int, slide: int | None) -> Column:
    return F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds")


def stream_window_stats(flows: DataFrame, seconds: int, slide: int | None = None, ts: str = "flow_ts") -> DataFrame:
    """The 13 metrics per window of a watermarked stream; a window appears once the watermark has passed it.

    Two branches meet in one last aggregation: (window, source, port) -> (window, source) for sums and maxima
    per source, and (window, port) for distinct ports. State is one row per group and is dropped with the window.
    """
    facts = _facts(flows, _window(ts, seconds, slide).alias("window"))
    by_port = facts.groupBy("window", "src_ip", "dst_port").agg(F.count(F.lit(1)).alias("flows"), *[F.sum(c).alias(c) for c in _SUMS])
    by_ip = by_port.groupBy("window", "src_ip").agg(
        F.count("dst_port").alias("ports"), F.sum("flows").alias("flows"), *[F.sum(c).alias(c) for c in _SUMS])
    ports = facts.filter(F.col("dst_port").isNotNull()).groupBy("window", "dst_port").agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    sources = by_ip.select("window", "flows", *_SUMS, "ports", F.lit(1).cast("long").alias("source"), zero.alias("port"))
    seen = ports.select("window", zero.alias("flows"), *[zero.alias(c) for c in _SUMS], zero.alias("ports"), zero.alias("source"),
                        F.lit(1).cast("long").alias("port"))
    out = sources.unionByName(seen).groupBy("window").agg(
        F.sum("flows").alias("total_flows"), F.sum("syn").alias("syn_flag_count"), F.sum("ack").alias("ack_flag_count"),
        F.sum("tcp").alias("tcp_packet_count"), F.sum("udp").alias("udp_packet_count"), F.sum("icmp").alias("icmp_packet_count"),
        F.sum("source").alias("unique_src_ips"), F.sum("port").alias("unique_dst_ports"),
        F.max("flows").alias("flows_per_ip"), F.max("packets").alias("packets_per_ip"), F.max("ports").alias("unique_dst_ports_per_ip"))
    flags = F.col("syn_flag_count") + F.col("ack_flag_count")
    return out.withColumns({
        "syn_ack_ratio": F.coalesce(F.try_divide(F.col("syn_flag_count").cast("double"), flags), F.lit(0.0)),
        "total_packets": F.col("tcp_packet_count") + F.col("udp_packet_count") + F.col("icmp_packet_count"),
    }).select("window", *STAT_NAMES)


def stream_sessions(flows: DataFrame, gap_seconds: int = 60, key: str = "src_ip", ts: str = "flow_ts") -> DataFrame:
    """Bursts per source: first and last seen and flows, split at pauses longer than the gap."""
    return flows.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("session")).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("flows"))


def stream_unique_alerts(alerts: DataFrame, delay: str = "10 minutes", ts: str = "alert_ts") -> DataFrame:
    """Alerts without repeats of an id; ids are forgotten once the watermark has passed them."""
    return alerts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["alert_id"])
