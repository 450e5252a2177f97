"""Flow meter: packet records to the wide table of flow features that classifiers are trained on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwatch.operators.blocks import BLOCK, _over_blocks, row_blocks
from rillwatch.operators.windows import SECOND, micros
from rillwatch.session import cut_lineage

FLAGS = ["fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece"]
ENDS = ["end_a", "end_b", "protocol"]
#: packets of payload in one direction that make a bulk transfer
BULK = 4
IDENTITY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "first_us"]


def _spread(c: Column, name: str, total: bool = False) -> list[Column]:
    """Mean, deviation, maximum and minimum of ``c``, NULL where there is none."""
    return [F.avg(c).alias(f"{name}_mean"), F.stddev(c).alias(f"{name}_std"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min"),
            *([F.sum(c).alias(f"{name}_tot")] if total else [])]


def _carry(rows: DataFrame, keys: list[str], order: list[str], found: dict[str, Column], upto: int) -> DataFrame:
    """Adds, per name, the last value of its column that is not NULL, up to the row itself (``upto`` 0) or the one before (-1).

    Rows have blocks; of each block only its last values are carried along the key.
    """
    ids = [*keys, BLOCK]
    at = F.struct(*order)
    ends = rows.groupBy(*ids).agg(*[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_l_{n}") for n, c in found.items()])
    before = _over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*ids, *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in found])
    inside = Window.partitionBy(*ids).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    seen = rows.withColumns({n: F.last(c, ignorenulls=True).over(inside) for n, c in found.items()}).join(carried, ids)
    return seen.withColumns({n: F.coalesce(n, f"_c_{n}") for n in found}).drop(*[f"_c_{n}" for n in found])


def mark_packets(packets: DataFrame, idle_seconds: float, active_seconds: float, run_seconds: float, label: str | None) -> DataFrame:
    """Packets with the starts (microsecond, packet) of their flow, active stretch and bulk run, and the pauses before them."""
    us = micros("pkt_ts")
    here, there = (F.struct(F.col(f"{e}_ip").alias("ip"), F.col(f"{e}_port").alias("port")) for e in ("src", "dst"))
    rows = packets.select(
        F.least(here, there).alias("end_a"), F.greatest(here, there).alias("end_b"), "protocol", us.alias("us"), "pkt_id", (here <= there).alias("a_to_b"),
        *[F.col(c).cast("long").alias(c) for c in ("length", "header", "win", *FLAGS)], *([F.col(label).alias("_label")] if label else []))
    order, data = ["us", "pkt_id"], F.col("length") > 0
    rows = _carry(row_blocks(rows, ENDS, order), ENDS, order, {
        "any_us": F.col("us"), "ab_us": F.when(F.col("a_to_b"), F.col("us")), "ba_us": F.when(~F.col("a_to_b"), F.col("us")),
        "data_before": F.when(data, F.struct("us", "a_to_b"))}, -1)
    pause = F.col("us") - F.col("any_us")
    starts = pause.isNull() | (pause > int(idle_seconds * SECOND))
    parts = starts | (pause > int(run_seconds * SECOND))
    stops = starts | (pause > int(active_seconds * SECOND))
    turns = data & (F.col("data_before").isNull() | (F.col("data_before.a_to_b") != F.col("a_to_b"))
                    | (F.col("us") - F.col("data_before.us") > int(run_seconds * SECOND)))
    at = F.struct("us", "pkt_id")
    rows = _carry(rows, ENDS, order, {"flow": F.when(starts, at), "stretch": F.when(stops, at), "bulk": F.when(turns, at)}, 0)
    same = F.when(F.col("a_to_b"), F.col("ab_us")).otherwise(F.col("ba_us"))
    return rows.select(
        *ENDS, "flow", "stretch", F.when(data, F.col("bulk")).alias("bulk"), *order, "a_to_b", "length", "header", "win", *FLAGS,
        F.when(~starts, pause).alias("gap"), F.when(~starts & stops, pause).alias("idle"), F.when(parts, 1).otherwise(0).alias("opens"),
        F.when(same >= F.col("flow.us"), F.col("us") - same).alias("way_gap"), *(["_label"] if label else []))


def measure_flows(packets: DataFrame, idle_seconds: float = 60, active_seconds: float = 5, run_seconds: float = 1, label: str | None = None) -> DataFrame:
    """One row per flow: who, when, and 76 features (times in microseconds, rates per second).

    ``packets`` has ``pkt_id`` (unique), ``pkt_ts``, addresses, ports, ``protocol``, ``length`` (payload bytes), ``header``
    (bytes), ``win`` and the flags as 0 or 1. A flow is a 5-tuple in both directions up to a pause above ``idle_seconds``;
    forward is the direction of its first packet. A pause above ``active_seconds`` is idle time and parts active stretches;
    one above ``run_seconds`` begins a new subflow. A bulk is a run of at least four packets with payload in one direction,
    none of the other direction in between and no pause above ``run_seconds``. Figures without any value (one packet, no
    packet backward) are 0. The largest ``label`` of a flow's packets is kept as column ``label``.

    No flow has to fit a task: packets lie in blocks of equally many rows, and all groupings combine before the shuffle.
    """
    rows = cut_lineage(mark_packets(packets, idle_seconds, active_seconds, run_seconds, label))
    key, at = [*ENDS, "flow"], F.struct("us", "pkt_id")
    both = []
    for way, is_way in (("ab", F.col("a_to_b")), ("ba", ~F.col("a_to_b"))):
        of = lambda c, on=is_way: F.when(on, c)
        size, gap, header = of(F.col("length")), of(F.col("way_gap")), of(F.col("header"))
        both += [
            F.count(size).alias(f"{way}_pkts"), F.sum(size).alias(f"{way}_bytes"), *_spread(size, f"{way}_len"), *_spread(gap, f"{way}_iat", True),
            F.sum(of(F.col("psh"))).alias(f"{way}_psh"), F.sum(of(F.col("urg"))).alias(f"{way}_urg"), F.sum(header).alias(f"{way}_header"),
            F.min(header).alias(f"{way}_header_min"), F.min_by(of(F.col("win")), F.when(is_way, at)).alias(f"{way}_win"), F.count(F.when(is_way & (F.col("length") > 0), 1)).alias(f"{way}_data")]
    flows = rows.groupBy(*key).agg(
        F.min_by("a_to_b", at).alias("fwd"), F.max("us").alias("last_us"), F.sum("opens").alias("subflows"), *both, *_spread(F.col("length"), "pkt_len"), F.variance("length").alias("pkt_len_var"),
        *_spread(F.col("gap"), "flow_iat"), *_spread(F.col("idle"), "idle"), *[F.sum(f).alias(f"{f}_flag_cnt") for f in FLAGS],
        *([F.max("_label").alias("label")] if label else []))
    stretches = rows.groupBy(*key, "stretch").agg((F.max("us") - F.col("stretch.us")).alias("lasted"))
    active = stretches.groupBy(*key).agg(*_spread(F.col("lasted"), "active"))
    runs = rows.filter("bulk IS NOT NULL").groupBy(*key, "bulk", "a_to_b").agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"), (F.max("us") - F.col("bulk.us")).alias("lasted")).filter(F.col("n") >= BULK)
    bulks = runs.groupBy(*key).agg(*[
        F.sum(F.when(F.col("a_to_b") == on, c)).alias(f"{way}_{n}") for way, on in (("ab", True), ("ba", False))
        for n, c in (("bulks", F.lit(1)), ("bulk_pkts", F.col("n")), ("bulk_bytes", F.col("bytes")), ("bulk_us", F.col("lasted")))])
    return _features(flows.join(active, key).join(bulks, key, "left"), label)


def _features(flows: DataFrame, label: str | None) -> DataFrame:
    """Columns by direction of the flow's first packet, and the ratios between them."""
    fwd = lambda n: F.when(F.col("fwd"), F.col(f"ab_{n}")).otherwise(F.col(f"ba_{n}"))
    bwd = lambda n: F.when(F.col("fwd"), F.col(f"ba_{n}")).otherwise(F.col(f"ab_{n}"))
    lasted = F.col("last_us") - F.col("flow.us")
    per_second = lambda n: F.try_divide(n, lasted / SECOND)
    packets, octets = fwd("pkts") + bwd("pkts"), reduce(lambda a, b: a + b, [F.coalesce(w("bytes"), F.lit(0)) for w in (fwd, bwd)])
    out: dict[str, Column] = {
        "flow_duration": lasted, "tot_fwd_pkts": fwd("pkts"), "tot_bwd_pkts": bwd("pkts"), "totlen_fwd_pkts": fwd("bytes"), "totlen_bwd_pkts": bwd("bytes")}
    figures = ("mean", "std", "max", "min")
    for name, way in (("fwd", fwd), ("bwd", bwd)):
        out |= {f"{name}_pkt_len_{f}": way(f"len_{f}") for f in figures}
        out |= {f"{name}_iat_{f}": way(f"iat_{f}") for f in (*figures, "tot")}
        out |= {f"{name}_psh_flags": way("psh"), f"{name}_urg_flags": way("urg"), f"{name}_header_len": way("header"), f"{name}_pkts_s": per_second(way("pkts")),
                f"{name}_seg_size_avg": F.try_divide(way("bytes"), way("pkts")), f"init_{name}_win_byts": way("win"),
                f"{name}_byts_b_avg": F.try_divide(way("bulk_bytes"), way("bulks")), f"{name}_pkts_b_avg": F.try_divide(way("bulk_pkts"), way("bulks")),
                f"{name}_blk_rate_avg": F.try_divide(way("bulk_bytes"), way("bulk_us") / SECOND),
                f"subflow_{name}_pkts": way("pkts") / F.col("subflows"), f"subflow_{name}_byts": way("bytes") / F.col("subflows")}
    out |= {"fwd_act_data_pkts": fwd("data"), "fwd_seg_size_min": fwd("header_min"), "flow_byts_s": per_second(octets), "flow_pkts_s": per_second(packets),
            "down_up_ratio": F.try_divide(bwd("pkts"), fwd("pkts")), "pkt_size_avg": F.try_divide(octets, packets), "pkt_len_var": F.col("pkt_len_var")}
    out |= {f"{n}_{f}": F.col(f"{n}_{f}") for n in ("pkt_len", "flow_iat", "active", "idle") for f in figures}
    out |= {f"{f}_flag_cnt": F.col(f"{f}_flag_cnt") for f in FLAGS}
    here, there = (F.when(F.col("fwd"), F.col(a)).otherwise(F.col(b)) for a, b in (("end_a", "end_b"), ("end_b", "end_a")))
    who = flows.withColumns({"_here": here, "_there": there})
    return who.select(
        F.col("_here.ip").alias("src_ip"), F.col("_there.ip").alias("dst_ip"), F.col("_here.port").alias("src_port"), F.col("_there.port").alias("dst_port"),
        "protocol", F.col("flow.us").alias("first_us"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in out.items()], *(["label"] if label else []))
