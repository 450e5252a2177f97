"""Windows, ordered operators and quantiles against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwatch.operators import blocks, sessions, timeseries, windows
from rillwatch.operators.quantiles import exact_quantiles


def rows(df):
    return sorted(tuple(r) for r in df.collect())


HAND = [
    (0, "a", 80, 6, 10, 5, 3, 1), (1, "a", 81, 6, 1, 1, 1, 0), (2, "b", 0, 17, 7, None, 9, 9), (3, "b", None, 1, 2, 2, 0, 0),
    (4, None, 80, 47, 100, 0, 5, 5), (59.999999, "a", 80, 17, 1, 0, 0, 0), (60, "c", 0, 6, 1, 0, 0, 0),
]


def test_window_stats_by_hand(flows):
    out = {r["win"]: r.asDict() for r in windows.window_stats(flows(HAND), 60).collect()}
    first, second = (out[w] for w in sorted(out))
    assert first == {**first, "total_flows": 6, "syn_flag_count": 4, "ack_flag_count": 1, "tcp_packet_count": 17, "udp_packet_count": 8, "icmp_packet_count": 4,
                     "total_packets": 29, "unique_src_ips": 3, "unique_dst_ports": 2, "flows_per_ip": 3, "packets_per_ip": 100, "unique_dst_ports_per_ip": 2, "syn_ack_ratio": 0.8}
    # no flow has a port, no flag is set
    assert second["unique_dst_ports"] == second["unique_dst_ports_per_ip"] == 0 and second["syn_ack_ratio"] == 0.0


def test_window_stats_ignore_order_and_partitions(flows):
    shuffled = HAND[:]
    random.Random(3).shuffle(shuffled)
    pick = lambda rs: rows(windows.window_stats(flows(rs).repartition(5), 60))
    assert pick(HAND) == pick(shuffled)


def test_sliding_covers_each_flow_in_every_window(flows):
    out = windows.sliding_stats(flows(HAND), 60, 10)
    assert out.agg(F.sum("total_flows")).first()[0] == 6 * len(HAND)
    with pytest.raises(ValueError):
        windows.sliding_stats(flows(HAND), 60, 7)


def test_wider_windows_from_panes(flows):
    f = flows(HAND)
    assert rows(windows.pane_stats(windows.widen(windows.flow_panes(f, 30), 2))) == rows(windows.window_stats(f, 60))


def test_top_sources_ties_by_address(flows):
    f = flows([(i, ip, 1, 6, 1, 1, 0, 0) for i, ip in enumerate(["b", "a", "c", "c", None])])
    assert [r["src_ip"] for r in windows.top_sources(f, 60, 3).orderBy("rank").collect()] == ["c", "a", "b"]


def test_trailing_window_includes_both_ends(flows):
    f = flows([(t, "a", 1, 6, 1, 1, 0, 0) for t in (0, 30, 30, 60.000001)] + [(30, "b", 1, 6, 1, 1, 0, 0)])
    out = {r["flow_id"]: (r["flows_30"], r["flows_60"]) for r in windows.trailing_counts(f, (30, 60)).collect()}
    assert out == {0: (1, 1), 1: (3, 3), 2: (3, 3), 3: (1, 3), 4: (1, 1)}


def test_numbering_and_checkpoints(flows):
    r = random.Random(1)
    times = sorted(r.uniform(0, 20000) for _ in range(500))
    f = flows([(t, "a", 1, 6, 2, 1, 0, 0) for t in times])
    assert [x["flow_id"] for x in windows.number_rows(f).orderBy("rn").collect()] == list(range(500))
    got = {x["rn"]: (x["flows_60s"], x["packets_60s"]) for x in windows.checkpoint_totals(f, 50, 60).collect()}
    us = [int(1_704_067_200_000_000 + t * 1e6) for t in times]
    want = {}
    for n in range(50, 501, 50):
        c = sum(us[n - 1] - 60_000_000 <= u <= us[n - 1] for u in us)
        want[n] = (c, 3.0 * c)
    assert got == want


@pytest.fixture(scope="module")
def skewed(spark):
    r = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"k": np.where(r.random(n) < 0.6, "hot", r.choice(list("abcdef"), n)), "t": r.integers(-500, 50_000, n), "v": r.integers(0, 9, n), "id": range(n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_totals(skewed):
    pdf, df = skewed
    got = blocks.running_totals(df, ["k"], "t", {"run": "v"}, 1000).toPandas().set_index("id")["run"].sort_index()
    per_t = pdf.groupby(["k", "t"])["v"].sum().groupby(level=0).cumsum()
    want = pdf.set_index("id").apply(lambda row: per_t[(row["k"], row["t"])], axis=1)
    assert (got == want).all()


def test_previous_row(skewed):
    pdf, df = skewed
    got = blocks.previous_row(df, ["k"], ["t", "id"], ["v"], 1000).select("id", "prev.v").toPandas().set_index("id")["v"].sort_index()
    want = pdf.sort_values(["t", "id"]).groupby("k")["v"].shift().sort_index()
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_sessions_split_only_at_longer_pauses(flows):
    f = flows([(t, "a", 1, 6, 1, 1, 0, 0) for t in (0, 60, 120.000001, 700, 1400)])
    assert [r["flows"] for r in sessions.bursts(f).orderBy("first_us").collect()] == [2, 1, 1, 1]


def test_sessions_across_many_blocks(spark):
    r = np.random.default_rng(8)
    t = np.cumsum(np.where(r.random(3000) < 0.03, r.integers(61_000_000, 900_000_000, 3000), r.integers(0, 60_000_001, 3000)))
    pdf = pd.DataFrame({"k": "hot", "us": t, "id": range(3000)})
    want = pdf["us"].diff().gt(60_000_000).cumsum()
    want = pdf["us"].groupby(want).transform("min")
    out = sessions.mark_sessions(spark.createDataFrame(pdf), ["k"], "us", "id", 60_000_000, 300_000_000).toPandas().sort_values("id")
    assert out["session"].tolist() == want.tolist()
    assert out["prev_us"].tolist()[1:] == pdf["us"].tolist()[:-1]


def test_row_blocks_follow_the_rows(spark, monkeypatch):
    """More rows give more blocks and tasks, not larger ones, inside one hot key too; what is computed on them stays the same."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 500)
    df = spark.range(0, 20_000, 1, 4).select(F.lit("hot").alias("k"), (F.col("id") * 1000 + F.when(F.col("id") % 100 == 0, 500).otherwise(0)).alias("us"), "id")
    cut = blocks.row_blocks(df, ["k"], ["us", "id"])
    per_block = [r["count"] for r in cut.groupBy(blocks.BLOCK).count().collect()]
    per_task = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_block) == 20_000 and len(per_block) > 30 and max(per_block) < 2_000
    assert max(per_task) < 5_000
    out = blocks.previous_row(df, ["k"], ["us", "id"], ["id"]).select("id", F.col("prev.id").alias("p")).collect()
    assert {r["id"]: r["p"] for r in out} == {i: i - 1 if i else None for i in range(20_000)}
    marked = sessions.mark_sessions(df, ["k"], "us", "id", 1400).select("id", "session").collect()
    assert {r["id"]: r["session"] for r in marked} == {i: i // 100 * 100_000 + 500 for i in range(20_000)}


def test_packets_both_directions(spark):
    t0 = 1_704_067_200_000_000
    pk = [(1, 0, "10.0.0.1", "10.0.0.2", 9, 80, 100, 1), (2, 10, "10.0.0.2", "10.0.0.1", 80, 9, 300, 0), (3, 30, "10.0.0.1", "10.0.0.2", 9, 80, 100, 0), (4, 100_000_000, "10.0.0.2", "10.0.0.1", 80, 9, 50, 1)]
    df = spark.createDataFrame([(i, t0 + us, *x) for i, us, *x in pk], "pkt_id long, us long, src_ip string, dst_ip string, src_port int, dst_port int, length int, syn int")
    df = df.withColumn("pkt_ts", F.timestamp_micros("us")).withColumn("protocol", F.lit(6))
    a, b = sessions.packets_to_flows(df).orderBy("first_us").collect()
    assert (a["src_ip"], a["tot_fwd_pkts"], a["tot_bwd_pkts"], a["totlen_fwd_pkts"], a["totlen_bwd_pkts"], a["flow_iat_max"], a["syn_flag_cnt"]) == ("10.0.0.1", 2, 1, 200, 300, 20, 1)
    assert (b["src_ip"], b["tot_fwd_pkts"], b["flow_iat_max"], b["flow_duration"]) == ("10.0.0.2", 1, 0, 0)


@pytest.mark.parametrize("kind", ["smooth", "ties", "tails", "dirty", "few"])
def test_exact_quantiles(spark, kind):
    r = np.random.default_rng(9)
    data = {"smooth": r.normal(size=9000), "ties": r.integers(0, 3, 9000).astype(float), "tails": np.exp(r.normal(size=9000) * 12),
            "dirty": np.where(r.random(9000) < 0.1, np.inf, r.normal(size=9000)), "few": r.normal(size=3)}[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": data, "y": 2 * data}))
    probs = [0, 0.25, 0.5, 0.99, 1]
    got = exact_quantiles(df, ["x", "y"], probs)
    assert got["x"] == pytest.approx(list(np.quantile(data[np.isfinite(data)], probs)), rel=1e-12)
    assert got["y"] == pytest.approx(list(np.quantile(2 * data[np.isfinite(data)], probs)), rel=1e-12)


@pytest.mark.parametrize("accuracy, rows, values", [(20, 1000, 2), (20, 1000, 4), (20, 999, 2), (None, 200_002, 2)])
def test_ranks_at_the_border_of_frequent_values_settle(spark, monkeypatch, accuracy, rows, values):
    """Proposals are the two values beside the rank, which narrows nothing: the loop has to end all the same."""
    from rillwatch.operators import quantiles

    rounds, proposed = [], F.percentile_approx

    def counted(*a):
        rounds.append(a)
        assert len(rounds) < 20, "no end"
        return proposed(*a)

    monkeypatch.setattr(quantiles.F, "percentile_approx", counted)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy or quantiles.ACCURACY)
    data = sorted(i % values for i in range(rows))
    border = [rows * k // values + d for k in range(1, values) for d in (-1, 0)]
    got = quantiles.order_statistics(spark.range(rows).selectExpr(f"double(id % {values}) as v"), {"v": border})["v"]
    assert [got[r] for r in border] == [data[r] for r in border]
    assert [got["below", r] for r in border] == [data.index(data[r]) for r in border]


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), ["x"], [0.5]) == {"x": [None]}


def series(spark, points):
    df = spark.createDataFrame([("m", "h", "d", 1_704_067_200_000_000 + int(t * 1e6), float(v)) for t, v in points], "name string, instance string, device string, us long, value double")
    return df.withColumn("ts", F.timestamp_micros("us"))


def test_rates_correct_resets(spark):
    r = timeseries.counter_rates(series(spark, [(0, 10), (10, 30), (20, 5), (40, 5), (300, 1)]), 300).orderBy("win").collect()
    assert (r[0]["increase"], r[0]["rate"], r[0]["irate"], r[0]["changes"]) == (25.0, 0.625, 0.0, 2)
    assert r[1]["rate"] is None and r[1]["increase"] is None and r[1]["samples"] == 1


def test_holding_needs_the_whole_time(spark):
    s = series(spark, [(0, 1), (10, 9), (20, 9), (39, 9), (50, 1), (60, 9), (89, 9), (700, 9)])
    out = timeseries.holding(s, ["name"], F.col("value") > 5, 30).collect()
    assert [(r["points"], r["until"] - r["since"]) for r in out] == [(3, 640_000_000)]


def test_histogram_quantile_above_last_bound(spark):
    df = spark.createDataFrame([("a", x) for x in (0.5, 1.5, 1.5, 9.0)], "h string, v double")
    b = timeseries.histogram(df, ["h"], "v", [1.0, 2.0])
    q = lambda p: timeseries.histogram_quantile(b, ["h"], p).first()["value"]
    assert q(0.25) == 1.0 and q(0.5) == 1.5 and q(0.99) == 2.0


def test_trailing_sums_keep_small_values_beside_huge_ones(spark):
    """Six values of 0.1 within 5 s after one of 1e17 on the same key, and every window against a plain loop."""
    import random

    from rillwatch.operators import blocks

    rng, rows = random.Random(1), [(0, "a", 0, 1e17, 2**60)] + [(i, "a", 3_000 + i, 0.1, 1) for i in range(1, 7)]
    rows += [(100 + i, rng.choice("bc"), rng.randrange(40_000), float(rng.randrange(9)), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v double, w long")
    out = blocks.trailing_sums(df, None, ["k"], "t", "id", {"v": "v", "w": "w"}, {"s": 1_000, "m": 2_500, "l": 7_000})
    assert dict(out.dtypes)["w_s"] == "bigint" and dict(out.dtypes)["v_s"] == "double"
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, k, t, _, _ in rows:
        for s, us in (("s", 1_000), ("m", 2_500), ("l", 7_000)):
            inside = [r for r in rows if r[1] == k and t - us <= r[2] <= t]
            assert got[i][f"w_{s}"] == sum(r[4] for r in inside)
            assert abs(got[i][f"v_{s}"] - sum(r[3] for r in inside)) <= 1e-9 * max(1.0, sum(r[3] for r in inside))
    assert round(got[6]["v_s"], 9) == 0.6


def test_sketches_are_merged_in_two_levels(spark):
    """No exchange brings the sketches of all tasks into one partition, and each task reads a bounded share of them."""
    from rillwatch.operators import quantiles

    values = spark.range(0, 60_000, 1, 200).selectExpr("cast(id % 2 as int) as k", "cast(id as double) as v")
    plan = quantiles.sketches(values)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 2 and "_group" in plan
    got = {r.k: r.n for r in quantiles.sketches(values).collect()}
    assert got == {0: 30_000, 1: 30_000}


def test_quantiles_of_many_columns_at_once(spark):
    r = np.random.default_rng(10)
    data = pd.DataFrame({f"c{i}": r.normal(size=30_000) * 10.0 ** i for i in range(12)} | {"same": 1.5, "two": r.integers(0, 2, 30_000).astype(float)})
    data.loc[::7, "c3"] = np.nan
    got = exact_quantiles(spark.createDataFrame(data).repartition(30), list(data.columns), [0.01, 0.25, 0.5, 0.75, 0.999])
    for c in data.columns:
        assert got[c] == pytest.approx(list(np.nanquantile(data[c], [0.01, 0.25, 0.5, 0.75, 0.999])), rel=1e-12)


def test_flood_in_one_instant_spreads_over_row_blocks(spark):
    """Blocks of equally many rows: one key and one microsecond holding nearly all rows still end up in several blocks."""
    rng = np.random.default_rng(5)
    n = 4000
    us = np.where(rng.random(n) < 0.9, 7_000_000, rng.integers(0, 400_000_000, n))
    pdf = pd.DataFrame({"k": "a", "us": us, "id": np.arange(n), "v": rng.integers(0, 9, n)})
    df = spark.createDataFrame(pdf)
    cut = blocks.row_blocks(df, ["k"], ["us", "id"])
    sizes = [r["count"] for r in cut.filter("us = 7000000").groupBy(blocks.BLOCK).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < n / 2
    ends = cut.groupBy(blocks.BLOCK).agg(F.min(F.struct("us", "id")).alias("a"), F.max(F.struct("us", "id")).alias("b")).orderBy(blocks.BLOCK).collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    seen = sorted(zip(us, range(n)))
    before = {i: (None if p is None else pdf.v[p]) for (_, i), p in zip(seen, [None, *[i for _, i in seen]])}
    got = {r.id: r.pv for r in blocks.previous_row(df, ["k"], ["us", "id"], ["v"]).select("id", F.col("prev.v").alias("pv")).collect()}
    assert got == before
    parts = sessions.mark_sessions(df, ["k"], "us", "id", 1_000_000).select("id", "session", "prev_us").collect()
    start, last, want = None, None, {}
    for u, i in seen:
        start = u if last is None or u - last > 1_000_000 else start
        want[i], last = (start, last), u
    assert {r.id: (r.session, r.prev_us) for r in parts} == want


def test_row_blocks_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, us long, id long")
    assert sessions.mark_sessions(empty, ["k"], "us", "id", 5).count() == 0
    assert blocks.running_totals(empty, ["k"], "us", {"run": "id"}).count() == 0
