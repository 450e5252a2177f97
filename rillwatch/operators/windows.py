"""Flow statistics per time window and the sources behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.operators.blocks import running_totals, trailing_sums
from rillwatch.session import cut_lineage

SECOND = 1_000_000


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def window_number(ts: str, seconds: int) -> Column:
    """Number of the tumbling window ``[n * seconds, (n + 1) * seconds)`` since the epoch."""
    return F.floor(micros(ts) / F.lit(seconds * SECOND)).cast("long")


def _facts(flows: DataFrame, *keys: Column) -> DataFrame:
    packets = F.coalesce(F.col("tot_fwd_pkts"), F.lit(0)) + F.coalesce(F.col("tot_bwd_pkts"), F.lit(0))
    of = lambda p, c: F.when(F.col("protocol") == p, c).otherwise(F.lit(0))
    return flows.select(
        *keys,
        F.coalesce("src_ip", F.lit("unknown")).alias("src_ip"),
        F.nullif(F.col("dst_port"), F.lit(0)).alias("dst_port"),
        packets.alias("packets"),
        of(6, packets).alias("tcp"), of(17, packets).alias("udp"), of(1, packets).alias("icmp"),
        of(6, F.coalesce("syn_flag_cnt", F.lit(0))).alias("syn"),
        of(6, F.coalesce("ack_flag_cnt", F.lit(0))).alias("ack"),
    )


_SUMS = ["packets", "tcp", "udp", "icmp", "syn", "ack"]


def _by_port(facts: DataFrame) -> DataFrame:
    """One row per (window, source, port): a hot source shrinks map-side before any shuffle."""
    return facts.groupBy("win", "src_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("flows"), *[F.sum(c).alias(c) for c in _SUMS]
    )


def _stats(by_port: DataFrame) -> DataFrame:
    """Two grouping sets over the same rows, per source and per port, then one row per window.

    The flows are read and shuffled once; a window's distinct ports are its (window, port) groups.
    """
    per_source, per_port = [F.col("win"), F.col("src_ip")], [F.col("win"), F.col("dst_port")]
    has_port = F.col("dst_port").isNotNull()
    sets = by_port.withColumn("has_port", has_port.cast("int")).groupingSets(
        [per_source, per_port], "win", "src_ip", "dst_port"
    ).agg(F.grouping("src_ip").alias("is_port"), F.sum("has_port").alias("ports"), F.sum("flows").alias("flows"),
          *[F.sum(c).alias(c) for c in _SUMS])
    source, port = F.col("is_port") == 0, F.col("is_port") == 1
    of_source = lambda c: F.when(source, F.col(c))
    by_win = sets.groupBy("win").agg(
        F.sum(of_source("flows")).alias("total_flows"),
        F.sum(of_source("syn")).alias("syn_flag_count"),
        F.sum(of_source("ack")).alias("ack_flag_count"),
        F.sum(of_source("tcp")).alias("tcp_packet_count"),
        F.sum(of_source("udp")).alias("udp_packet_count"),
        F.sum(of_source("icmp")).alias("icmp_packet_count"),
        F.count(F.when(source, 1)).alias("unique_src_ips"),
        F.count(F.when(port & has_port, 1)).alias("unique_dst_ports"),
        F.max(of_source("flows")).alias("flows_per_ip"),
        F.max(of_source("packets")).alias("packets_per_ip"),
        F.max(of_source("ports")).alias("unique_dst_ports_per_ip"),
    )
    flags = F.col("syn_flag_count") + F.col("ack_flag_count")
    return by_win.withColumns({
        "syn_ack_ratio": F.coalesce(F.try_divide(F.col("syn_flag_count").cast("double"), flags), F.lit(0.0)),
        "total_packets": F.col("tcp_packet_count") + F.col("udp_packet_count") + F.col("icmp_packet_count"),
    }).select("win", *STAT_NAMES)


STAT_NAMES = [
    "total_flows", "syn_flag_count", "ack_flag_count", "tcp_packet_count", "udp_packet_count", "icmp_packet_count",
    "total_packets", "unique_src_ips", "unique_dst_ports", "flows_per_ip", "packets_per_ip",
    "unique_dst_ports_per_ip", "syn_ack_ratio",
]


def flow_panes(flows: DataFrame, seconds: int, ts: str = "flow_ts") -> DataFrame:
    """Flows summed per (pane of ``seconds``, source, port), the one form all window queries can start from."""
    return _by_port(_facts(flows, window_number(ts, seconds).alias("win")))


def widen(panes: DataFrame, times: int) -> DataFrame:
    """Panes merged ``times`` to one."""
    if times == 1:
        return panes
    wider = panes.withColumn("win", F.floor(F.col("win") / F.lit(times)).cast("long"))
    return wider.groupBy("win", "src_ip", "dst_port").agg(*[F.sum(c).alias(c) for c in ["flows", *_SUMS]])


def window_stats(flows: DataFrame, seconds: int, ts: str = "flow_ts") -> DataFrame:
    """The 13 metrics per tumbling window, keyed by window number ``win``."""
    return pane_stats(flow_panes(flows, seconds, ts))


def pane_stats(panes: DataFrame) -> DataFrame:
    """The 13 metrics per pane."""
    return _stats(panes)


def sliding_stats(flows: DataFrame, seconds: int, slide: int, ts: str = "flow_ts") -> DataFrame:
    """The 13 metrics per window of ``seconds`` starting every ``slide`` seconds; ``win`` is start / slide.

    Flows are summed per slide-long pane first; only pane rows are copied into the windows that hold them.
    """
    if seconds % slide:
        raise ValueError("window length must be a multiple of the slide")
    panes = flow_panes(flows, slide, ts)
    spread = panes.withColumn("win", F.explode(F.sequence(F.col("win") - (seconds // slide - 1), F.col("win"))))
    return _stats(spread.groupBy("win", "src_ip", "dst_port").agg(*[F.sum(c).alias(c) for c in ["flows", *_SUMS]]))


def top_sources(flows: DataFrame, seconds: int, top_n: int = 5, ts: str = "flow_ts") -> DataFrame:
    """The ``top_n`` sources per window by flow count, ties by address."""
    return _top(flows.groupBy(
        window_number(ts, seconds).alias("win"), F.coalesce("src_ip", F.lit("unknown")).alias("src_ip")
    ).agg(F.count(F.lit(1)).alias("flow_count")), top_n)


def pane_top_sources(panes: DataFrame, top_n: int = 5) -> DataFrame:
    return _top(panes.groupBy("win", "src_ip").agg(F.sum("flows").alias("flow_count")), top_n)


def _top(counts: DataFrame, top_n: int) -> DataFrame:
    # the rank filter is pushed below the shuffle (WindowGroupLimit), so each task sends at most top_n rows a window
    ranked = Window.partitionBy("win").orderBy(F.desc("flow_count"), "src_ip")
    return counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_n)


def top_list(ranked: DataFrame, key: str = "win", value: str = "src_ip") -> DataFrame:
    """Ranked rows (at most top_n a key) folded to one array per key in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", value)))
    return ranked.groupBy(key).agg(F.transform(listed, lambda s: s[value]).alias("attacker_ips"))


def scored_window_stats(scored: DataFrame, seconds: int, ts: str = "flow_ts") -> DataFrame:
    """Flows, suspicious flows, their ratio and distinct attackers per window of labelled flows."""
    bad = F.col("prediction") != "BENIGN"
    by_ip = scored.groupBy(window_number(ts, seconds).alias("win"), "src_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.count(F.when(bad, 1)).alias("bad")
    )
    return scored_pane_stats(by_ip)


def scored_pane_stats(by_ip: DataFrame) -> DataFrame:
    """The same from rows per (window, source) with ``flows`` and ``bad``."""
    return by_ip.groupBy("win").agg(
        F.sum("flows").alias("total_flows"),
        F.sum("bad").alias("suspicious_flows"),
        F.count(F.when(F.col("bad") > 0, 1)).alias("unique_attackers"),
    ).withColumn("suspicious_ratio", F.col("suspicious_flows") / F.greatest("total_flows", F.lit(1)))


def number_rows(flows: DataFrame, order_ts: str = "flow_ts", tie: str = "flow_id", block_seconds: int = 1) -> DataFrame:
    """Adds ``rn``, the overall arrival number, without ever sorting everything in one task."""
    width = block_seconds * SECOND
    blocks = flows.withColumn("_us", micros(order_ts)).withColumn("_b", F.floor(F.col("_us") / F.lit(width)).cast("long"))
    sizes = blocks.groupBy("_b").agg(F.count(F.lit(1)).alias("one"))
    # two levels: seconds within an hour, then hours, so the prefix sums stay parallel as well
    starts = running_totals(sizes, [], "_b", {"upto": "one"}, width=3600).select("_b", (F.col("upto") - F.col("one")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy("_us", tie)
    return blocks.join(starts, "_b").withColumn("rn", F.row_number().over(inside) + F.col("_before")).drop("_b", "_us", "_before")


def every_nth(flows: DataFrame, n: int, **kw) -> DataFrame:
    """The flows at which windows are evaluated: every ``n``-th in arrival order."""
    return number_rows(flows, **kw).filter(F.col("rn") % n == 0)


def trailing_counts(flows: DataFrame, sizes=(30, 60, 300), ts: str = "flow_ts") -> DataFrame:
    """Per flow, flows of its source over the last ``sizes`` seconds, both ends included."""
    facts = flows.withColumn("_us", micros(ts)).withColumn("_one", F.lit(1))
    return trailing_sums(facts, None, ["src_ip"], "_us", "flow_id", {"flows": "_one"},
                         {str(s): s * SECOND for s in sizes})


def checkpoint_totals(flows: DataFrame, n: int, seconds: int, ts: str = "flow_ts") -> DataFrame:
    """At every ``n``-th flow, totals over ``[t - seconds, t]``."""
    packets = F.coalesce(F.col("tot_fwd_pkts"), F.lit(0)) + F.coalesce(F.col("tot_bwd_pkts"), F.lit(0))
    facts = flows.withColumn("_us", micros(ts)).withColumns({"_one": F.lit(1), "_pk": packets})
    marks = cut_lineage(every_nth(flows, n).select(micros(ts).alias("_us"), F.col("rn")))  # 1 / n of the rows
    return trailing_sums(facts, marks, [], "_us", "rn", {"flows": "_one", "packets": "_pk"},
                         {f"{seconds}s": seconds * SECOND})
