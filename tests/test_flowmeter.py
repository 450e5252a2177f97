"""The flow meter on packets whose features are known by hand, and where a flow lies in many blocks."""

import pytest

from rillwatch.fixtures import Inputs
from rillwatch.operators import flowmeter

BASE = 1_704_067_200_000_000
SCHEMA = ("pkt_id long, us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, header int, win int, "
          "fin int, syn int, rst int, psh int, ack int, urg int, cwr int, ece int, bad int")


def wire(spark, rows):
    """(second, forward, payload, window) per packet."""
    out = []
    for i, (at, ahead, size, win) in enumerate(rows):
        ends = ("10.0.0.9", "10.0.0.1", 5000, 80) if ahead else ("10.0.0.1", "10.0.0.9", 80, 5000)
        out.append((i, BASE + int(at * 1e6), *ends, 6, size, 20 + i % 2, win, 0, int(i == 0), 0, int(size > 0), 1, 0, 0, 0, int(i == 3)))
    return spark.createDataFrame(out, SCHEMA).selectExpr("*", "timestamp_micros(us) AS pkt_ts").drop("us")


def test_one_flow_by_hand(spark):
    df = wire(spark, [(0, True, 0, 100), (0.5, False, 0, 200), (0.6, True, 10, 101), (0.7, True, 20, 102), (0.8, False, 0, 201), (0.9, True, 30, 103), (1.0, True, 40, 104),
                      (3.0, False, 500, 202), (10.0, True, 5, 105), (90.0, True, 7, 106)])
    a, b = flowmeter.measure_flows(df, label="bad").orderBy("first_us").collect()
    assert (a.src_ip, a.src_port, a.dst_port, a.flow_duration, a.tot_fwd_pkts, a.tot_bwd_pkts, a.totlen_fwd_pkts, a.totlen_bwd_pkts) == (
        "10.0.0.9", 5000, 80, 10_000_000, 6, 3, 105, 500)
    assert (a.init_fwd_win_byts, a.init_bwd_win_byts, a.fwd_act_data_pkts, a.syn_flag_cnt, a.label) == (100, 200, 5, 1, 1)
    assert (a.fwd_iat_max, a.fwd_iat_min, a.fwd_iat_tot, a.bwd_iat_max, a.bwd_iat_tot) == (9_000_000, 100_000, 10_000_000, 2_200_000, 2_500_000)
    # pauses above a second: before 3 s and before 10 s; above five: the latter
    assert (a.subflow_fwd_pkts, a.subflow_bwd_byts, a.idle_max, a.idle_mean, a.idle_std) == (2.0, 500 / 3, 7_000_000, 7_000_000.0, 0.0)
    assert (a.active_max, a.active_min, a.active_mean) == (3_000_000, 0, 1_500_000.0)
    # four packets forward with payload; the empty answer in between does not part them
    assert (a.fwd_pkts_b_avg, a.fwd_byts_b_avg, a.bwd_byts_b_avg) == (4.0, 100.0, 0.0) and a.fwd_blk_rate_avg == pytest.approx(250.0)
    assert (b.flow_duration, b.tot_fwd_pkts, b.tot_bwd_pkts, b.flow_byts_s, b.flow_iat_max, b.pkt_len_std, b.init_bwd_win_byts, b.label) == (0, 1, 0, 0.0, 0, 0.0, 0, 0)
    assert len(a) - len(flowmeter.IDENTITY) - 1 == 76


def test_empty(spark):
    assert flowmeter.measure_flows(wire(spark, [(0, True, 1, 1)]).filter("false")).count() == 0


def test_one_hot_flow_over_many_blocks(spark):
    """One flow holds all packets: the figures are those of a plain loop."""
    rows = [(i * 0.3 + (2 if i % 50 == 49 else 0) + 7 * (i // 400), i % 9 < 6, i % 7 * 10, i) for i in range(2000)]
    (f,) = flowmeter.measure_flows(wire(spark, rows)).collect()
    rows = [(int(at * 1e6), ahead, size) for at, ahead, size, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], i))
    runs, last, parts, stretches = [], None, 1, [[rows[order[0]][0]] * 2]
    for before, i in zip([None, *order], order):
        at, ahead, size = rows[i]
        pause = 0 if before is None else at - rows[before][0]
        parts += pause > 1_000_000
        if pause > 5_000_000:
            stretches.append([at, at])
        stretches[-1][1] = at
        if size:
            if last is None or last[1] != ahead or at - last[0] > 1_000_000:
                runs.append((ahead, []))
            runs[-1][1].append(size)
            last = (at, ahead)
    bulks = [sizes for ahead, sizes in runs if ahead and len(sizes) >= 4]
    assert bulks and len(stretches) > 2 and parts > 5
    assert f.fwd_byts_b_avg == pytest.approx(sum(map(sum, bulks)) / len(bulks)) and f.fwd_pkts_b_avg == pytest.approx(sum(map(len, bulks)) / len(bulks))
    assert f.active_mean == pytest.approx(sum(b - a for a, b in stretches) / len(stretches)) and f.subflow_fwd_pkts == pytest.approx(sum(r[1] for r in rows) / parts)


def test_every_feature_takes_values_in_the_tables(spark):
    flows = flowmeter.measure_flows(Inputs(spark, "/root/testdata/sf0.01").view("wire"), label="attack")
    features = [c for c in flows.columns if c not in (*flowmeter.IDENTITY, "label")]
    varies = flows.selectExpr(*[f"min({c}) < max({c}) AS {c}" for c in [*features, "label"]]).first().asDict()
    assert [c for c, v in varies.items() if not v] == []
