"""Queries that run a stream over the given tables to its end, and the detectors end to end."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from rillwatch.operators import flowmeter, rules, scoring, sessions, windows
from rillwatch.operators.windows import micros
from rillwatch.plans.q_alerts import WINDOW_THRESHOLD
from rillwatch.plans.q_flows import rounded, unmatched
from rillwatch.plans.registry import CHECK_VIEWS, query
from rillwatch.session import run_dir
from rillwatch.sources.sinks import latest_version, run_once, stream_table
from rillwatch.streaming import jobs, late, stateful
from rillwatch.streaming import windows as sw

DELAY = "2 minutes"


def finish(t, stream, name):
    where = run_dir(t.spark, name)
    return run_once(stream, f"{where}/table", f"{where}/checkpoint")


def flow_stream(t):
    """Flows after the address filter and without those a per-flow rule took; the watermark follows the flows that stay."""
    from rillwatch.operators import ipfilter

    return rules.split_by_rules(ipfilter.drop_filtered(t.stream("flows")))[1].withWatermark("flow_ts", DELAY)


# a window is out once the watermark (newest event minus two minutes, whole milliseconds) has reached its end
_MARK = "(SELECT (max(epoch_us(flow_ts)) // 1000) * 1000 - 120000000 FROM rest)"


def _stats_sql(expand, alias):
    """The 13 metrics over ``rest`` with every flow in the windows ``expand`` lists."""
    base = CHECK_VIEWS["stats60"].replace("epoch_us(flow_ts) // 60000000 AS win", "win").replace("FROM rest", f"FROM ({expand}) rr")
    return f"SELECT * FROM ({base}) {alias}"


@query("stream_tumbling_stats", f"SELECT * FROM stats60 WHERE (win + 1) * 60000000 <= {_MARK}")
def _(t):
    out = finish(t, sw.stream_window_stats(flow_stream(t), 60), "tumbling")
    return rounded(out.withColumn("win", windows.window_number("window.start", 60)).drop("window"))


_SLIDES = "SELECT r.*, epoch_us(flow_ts) // 10000000 - s.o AS win FROM rest r, range(6) s(o)"


@query("sliding_stats", _stats_sql(_SLIDES, "x"))
def _(t):
    return rounded(windows.sliding_stats(unmatched(t), 60, 10))


@query("stream_sliding_stats", _stats_sql(_SLIDES, "x") + f" WHERE win * 10000000 + 60000000 <= {_MARK}")
def _(t):
    out = finish(t, sw.stream_window_stats(flow_stream(t), 60, 10), "sliding")
    return rounded(out.withColumn("win", windows.window_number("window.start", 10)).drop("window"))


_BURSTS = """
SELECT src_ip, CAST(session AS BIGINT) AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS flows FROM (SELECT *, sum(CASE WHEN pu IS NULL OR us - pu > 60000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY src_ip ORDER BY us) AS session FROM (SELECT src_ip, epoch_us(flow_ts) AS us, lag(epoch_us(flow_ts)) OVER (PARTITION BY src_ip ORDER BY flow_ts, flow_id) AS pu FROM rest) a) b GROUP BY 1, 2"""


@query("session_attacks", f"SELECT src_ip, first_us, last_us, flows FROM ({_BURSTS}) x")
def _(t):
    return sessions.bursts(unmatched(t))


@query("stream_session_attacks", f"SELECT src_ip, first_us, last_us, flows FROM ({_BURSTS}) x WHERE last_us + 60000000 <= {_MARK}")
def _(t):
    out = finish(t, sw.stream_sessions(flow_stream(t)), "sessions").drop("session")
    return out.select("src_ip", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), "flows")


# flows arrive up to a thousand places later than they began
_ARRIVAL = "(flow_id + (flow_id * 7919) % 1000) * 16777216 + flow_id"


@query("stream_late_data", f"""
SELECT flow_id FROM (SELECT flow_id, epoch_us(flow_ts) AS us, max(epoch_us(flow_ts)) OVER (ORDER BY {_ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM flows) x
WHERE newest IS NULL OR us >= newest - 30000000""")
def _(t):
    arriving = t.view("flows").withColumn("arrival", F.expr(_ARRIVAL))
    return sessions.drop_late(arriving, "arrival", "flow_ts", 30).select("flow_id")


# the table in eight files; every fiftieth flow arrives half a table late
_FILES = 8


@query("stream_late_rows", f"""
WITH pieces AS (SELECT flow_id, epoch_us(flow_ts) AS us, (flow_id + CASE WHEN flow_id % 50 = 7 THEN n // 2 ELSE 0 END) * {_FILES} // (n + n // 2) AS part FROM flows, (SELECT max(flow_id) + 1 AS n FROM flows) m),
 tops AS (SELECT part, (max(max(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000) * 1000 - 30000000 AS mark FROM pieces GROUP BY part),
 told AS (SELECT flow_id, COALESCE(us <= mark, FALSE) AS late FROM pieces JOIN tops USING (part))
SELECT flow_id, late, (SELECT count(*) FROM told WHERE late) AS dropped FROM told""")
def _(t):
    flows, where = t.view("flows").select("flow_id", "flow_ts"), run_dir(t.spark, "late")
    n = flows.agg(F.max("flow_id") + 1).first()[0]
    pos = F.col("flow_id") + F.when(F.col("flow_id") % 50 == 7, n // 2).otherwise(0)
    for i in range(_FILES):  # a stream takes files in the order in which they were written
        flows.filter(F.floor(pos * _FILES / (n + n // 2)) == i).coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = t.spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    kept, dropped = late.run_without_late(stream, "flow_ts", "30 seconds", "flow_id", where.rsplit("/", 1)[1], f"{where}/kept", f"{where}/checkpoint")
    gone = late.side_output(t.spark.read.schema(flows.schema).parquet(f"{where}/in"), kept, "flow_id")
    both = kept.select("flow_id", F.lit(False).alias("late")).unionByName(gone.select("flow_id", F.lit(True).alias("late")))
    return both.withColumn("dropped", F.lit(dropped).cast("long"))


@query("stream_rule_cooldown", """
WITH RECURSIVE c AS (SELECT rule_id, min(epoch_us(alert_ts)) AS us FROM alerts GROUP BY 1
 UNION ALL SELECT c.rule_id, (SELECT min(epoch_us(a.alert_ts)) FROM alerts a WHERE a.rule_id = c.rule_id AND epoch_us(a.alert_ts) >= c.us + 60000000) FROM c WHERE c.us IS NOT NULL)
SELECT c.rule_id AS key, c.us, min(a.alert_id) AS alert_id FROM c JOIN alerts a ON a.rule_id = c.rule_id AND epoch_us(a.alert_ts) = c.us GROUP BY 1, 2""")
def _(t):
    with rocksdb_state(t):
        return finish(t, stateful.stream_cooldown(t.stream("alerts"), "rule_id", 60), "cooldown")


@contextmanager
def rocksdb_state(t):
    """The state store that stateful processors need, for the streams started inside only."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        t.spark.conf.set(name, before)


@query("stream_ip_state_machine", """
SELECT ip, status, alert_count, flow_count, expires_us, whitelisted FROM ip_states,
 (SELECT (max(us) // 1000) * 1000 - 120000000 AS mark FROM (SELECT epoch_us(alert_ts) AS us FROM alerts UNION ALL SELECT epoch_us(action_ts) FROM admin_actions) e) m
WHERE status IS NOT NULL AND (expires_us IS NULL OR ((expires_us + 999) // 1000) * 1000 > mark)""")
def _(t):
    """The table of addresses that the stream leaves: records whose end the watermark has passed are gone."""
    where = run_dir(t.spark, "addresses")
    with rocksdb_state(t):
        changes = stateful.stream_address_states(stateful.address_events(t.stream("alerts"), t.stream("admin_actions")), delay=DELAY)
        stream_table(changes, "ip", "seq", F.col("status").isNull(), f"{where}/table", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest_version(t.spark, f"{where}/table", changes.schema).drop("seq", "duration_us")


@query("stream_alert_dedup", "SELECT DISTINCT alert_id FROM alerts")
def _(t):
    return finish(t, sw.stream_unique_alerts(t.stream("alerts")), "unique").select("alert_id")


# end to end ------------------------------------------------------------------------------------------------

CHECK_VIEWS["stats30"] = CHECK_VIEWS["stats60"].replace("60000000", "30000000")
CHECK_VIEWS["candidates"] = """
SELECT 'PF-001' AS rule_id, epoch_us(flow_ts) AS us, 'rule_PF-001_' || CAST(epoch_us(flow_ts) // 1000000 AS VARCHAR) AS alert_id FROM kept WHERE protocol = 17 AND tot_fwd_pkts > 1000 AND flow_duration < 1000000
UNION ALL SELECT rule_id, (win + 1) * 60000000, 'rule_' || rule_id || '_' || CAST((win + 1) * 60 AS VARCHAR) FROM (
 SELECT win, 'AGG-002' AS rule_id FROM stats60 WHERE udp_packet_count > 10000
 UNION ALL SELECT win, 'AGG-005' FROM stats60 WHERE flows_per_ip > 200 AND packets_per_ip > 50000
 UNION ALL SELECT win, 'AGG-006' FROM stats60 WHERE unique_dst_ports_per_ip > 50 AND flows_per_ip > 50
 UNION ALL SELECT win, 'AGG-007' FROM stats60 WHERE unique_dst_ports > 100 AND udp_packet_count > 1000 AND udp_packet_count < 10000
 UNION ALL SELECT win, 'AGG-008' FROM stats60 WHERE unique_src_ips > 50 AND flows_per_ip < 50 AND total_packets > 20000
 UNION ALL SELECT win, 'AGG-009' FROM stats60 WHERE unique_src_ips > 30 AND total_packets > 50000 AND total_flows > 500) x
UNION ALL SELECT 'AGG-001', (win + 1) * 30000000, 'rule_AGG-001_' || CAST((win + 1) * 30 AS VARCHAR) FROM stats30 WHERE syn_flag_count > 500 AND syn_ack_ratio > 0.8"""


@query("flow_rules_end_to_end", """
SELECT rule_id, us, alert_id, count(*) AS n FROM candidates WHERE rule_id <> 'AGG-001' GROUP BY 1, 2, 3""")
def _(t):
    found = jobs.rule_alerts_from_flows(t.view("flows"))
    return found.groupBy("rule_id", micros("alert_ts").alias("us"), "alert_id").agg(F.count("*").alias("n"))


@query("flow_rules_with_cooldown", """
WITH RECURSIVE c AS (SELECT rule_id, min(us) AS us FROM candidates GROUP BY 1
 UNION ALL SELECT c.rule_id, (SELECT min(a.us) FROM candidates a WHERE a.rule_id = c.rule_id AND a.us >= c.us + 60000000) FROM c WHERE c.us IS NOT NULL)
SELECT rule_id, us FROM c WHERE us IS NOT NULL""")
def _(t):
    return jobs.rule_alerts(t.view("flows")).select("rule_id", micros("alert_ts").alias("us"))


@query("stream_rule_detector", f"""
SELECT rule_id, us, alert_id FROM candidates WHERE rule_id LIKE 'AGG%' AND rule_id <> 'AGG-001' AND us <= {_MARK}""")
def _(t):
    where = run_dir(t.spark, "detector")
    jobs.stream_rule_detector(flow_stream(t), f"{where}/alerts", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{where}/alerts").select("rule_id", micros("alert_ts").alias("us"), "alert_id")


_CLOSED = f"""SELECT c.* FROM candidates c, (SELECT ({_MARK.replace("rest", "kept")} // 60000000) * 60000000 AS upto) m
 WHERE CASE WHEN rule_id LIKE 'PF%' THEN us < upto ELSE us <= upto END"""


@query("stream_rule_alerts", f"""
WITH RECURSIVE closed AS ({_CLOSED}), c AS (SELECT rule_id, min(us) AS us FROM closed GROUP BY 1
 UNION ALL SELECT c.rule_id, (SELECT min(a.us) FROM closed a WHERE a.rule_id = c.rule_id AND a.us >= c.us + 60000000) FROM c WHERE c.us IS NOT NULL)
SELECT rule_id, us FROM c WHERE us IS NOT NULL""")
def _(t):
    where = run_dir(t.spark, "rule-alerts")
    jobs.stream_rule_alerts(t.stream("flows"), f"{where}/out", f"{where}/checkpoint", DELAY).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{where}/out/alerts").select("rule_id", micros("alert_ts").alias("us"))


@query("stream_model_detector", f"""
SELECT 'ddos_' || CAST((win + 1) * 30 AS VARCHAR) AS alert_id, severity, suspicious_flows AS flow_count FROM ml_level WHERE severity IS NOT NULL AND (win + 1) * 30000000 <= {_MARK.replace("rest", "flows")}""")
def _(t):
    where = run_dir(t.spark, "model-detector")
    scored = scoring.label_scores(t.stream("labeled").withWatermark("flow_ts", DELAY), threshold=WINDOW_THRESHOLD)
    jobs.stream_model_detector(scored, f"{where}/alerts", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{where}/alerts").select("alert_id", "severity", "flow_count")


@query("packets_to_flows", """
WITH p AS (SELECT *, epoch_us(pkt_ts) AS us, lag(epoch_us(pkt_ts)) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY pkt_ts, pkt_id) AS pu FROM packets),
 s AS (SELECT *, sum(CASE WHEN pu IS NULL OR us - pu > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY us, pkt_id) AS session,
  CASE WHEN us - pu <= 60000000 THEN us - pu END AS gap FROM p)
SELECT src_ip, dst_ip, src_port, dst_port, protocol, min(us) AS first_us, max(us) - min(us) AS flow_duration, count(*) AS tot_fwd_pkts, 0::BIGINT AS tot_bwd_pkts, CAST(sum(length) AS BIGINT) AS totlen_fwd_pkts,
 0::BIGINT AS totlen_bwd_pkts, round(avg(length), 4) AS pkt_len_mean, round(COALESCE(stddev(length), 0), 4) AS pkt_len_std, CAST(min(length) AS BIGINT) AS pkt_len_min, CAST(max(length) AS BIGINT) AS pkt_len_max,
 round(COALESCE(avg(gap), 0), 4) AS flow_iat_mean, round(COALESCE(stddev(gap), 0), 4) AS flow_iat_std, COALESCE(min(gap), 0) AS flow_iat_min, COALESCE(max(gap), 0) AS flow_iat_max, CAST(sum(syn) AS BIGINT) AS syn_flag_cnt,
 round(COALESCE(avg(CASE WHEN gap > 5000000 THEN gap END), 0), 4) AS idle_mean, COALESCE(max(CASE WHEN gap > 5000000 THEN gap END), 0) AS idle_max
FROM s GROUP BY src_ip, dst_ip, src_port, dst_port, protocol, session""")
def _(t):
    return rounded(sessions.packets_to_flows(t.view("packets")), 4)


# the wide flow table -----------------------------------------------------------------------------------------

_ENDS = "a, b, protocol"
_ORDER = f"(PARTITION BY {_ENDS} ORDER BY us, pkt_id)"
_FLOW = f"PARTITION BY {_ENDS}, flow"


def _figures(c, name, digits):
    return ", ".join(f"round(COALESCE({f}({c}), 0), {digits}) AS {name}_{n}" for f, n in (("avg", "mean"), ("stddev", "std"))) + \
        f", CAST(COALESCE(max({c}), 0) AS BIGINT) AS {name}_max, CAST(COALESCE(min({c}), 0) AS BIGINT) AS {name}_min"


def _total(c, name):
    return f"CAST(COALESCE(sum({c}), 0) AS BIGINT) AS {name}"


def _per_way(way, is_way):
    of = lambda c: f"CASE WHEN {is_way} THEN {c} END"
    return ", ".join([
        f"count({of(1)}) AS tot_{way}_pkts", _total(of("length"), f"totlen_{way}_pkts"), _figures(of("length"), f"{way}_pkt_len", 3), _figures(of("way_gap"), f"{way}_iat", 1), _total(of("way_gap"), f"{way}_iat_tot"),
        _total(of("psh"), f"{way}_psh_flags"), _total(of("urg"), f"{way}_urg_flags"), _total(of("header"), f"{way}_header_len"),
        f"round(COALESCE(count({of(1)}) / NULLIF((max(us) - min(us)) / 1e6, 0), 0), 3) AS {way}_pkts_s", f"round(COALESCE(avg({of('length')}), 0), 3) AS {way}_seg_size_avg",
        f"CAST(COALESCE(max(CASE WHEN {is_way} AND way_gap IS NULL THEN win END), 0) AS BIGINT) AS init_{way}_win_byts",
        f"round(count({of(1)}) / sum(opens), 3) AS subflow_{way}_pkts", f"round(COALESCE(sum({of('length')}), 0) / sum(opens), 3) AS subflow_{way}_byts"])


def _bulk_way(way, is_way):
    of = lambda c: f"sum(CASE WHEN {is_way} THEN {c} END)"
    return (f"round(COALESCE({of('bytes')} / {of(1)}, 0), 3) AS {way}_byts_b_avg, round(COALESCE({of('n')} / {of(1)}, 0), 3) AS {way}_pkts_b_avg, "
            f"round(COALESCE({of('bytes')} / NULLIF({of('lasted')} / 1e6, 0), 0), 3) AS {way}_blk_rate_avg")


CHECK_VIEWS["wire_marks"] = f"""
SELECT *, COALESCE(fwd = lead_way, TRUE) AS is_fwd FROM (
 SELECT *, first_value(fwd) OVER ({_FLOW} ORDER BY us, pkt_id) AS lead_way, us - lag(us) OVER ({_FLOW}, fwd ORDER BY us, pkt_id) AS way_gap,
  CASE WHEN pause <= 60000000 THEN pause END AS gap, CASE WHEN pause > 5000000 AND pause <= 60000000 THEN pause END AS idle, CASE WHEN pause IS NULL OR pause > 1000000 THEN 1 ELSE 0 END AS opens,
  sum(CASE WHEN pause IS NULL OR pause > 5000000 THEN 1 ELSE 0 END) OVER {_ORDER} AS stretch
 FROM (SELECT *, sum(CASE WHEN pause IS NULL OR pause > 60000000 THEN 1 ELSE 0 END) OVER {_ORDER} AS flow FROM (
  SELECT *, us - lag(us) OVER {_ORDER} AS pause FROM (
   SELECT *, epoch_us(pkt_ts) AS us, src_port <> 80 AS fwd, CASE WHEN src_port <> 80 THEN src_ip ELSE dst_ip END AS a, CASE WHEN src_port <> 80 THEN dst_ip ELSE src_ip END AS b FROM wire) p) q) r) s"""
CHECK_VIEWS["wire_main"] = f"""
SELECT {_ENDS}, flow, bool_and(lead_way) AS ahead, CAST(min(us) AS BIGINT) AS first_us, max(us) - min(us) AS flow_duration, {_per_way("fwd", "is_fwd")}, {_per_way("bwd", "NOT is_fwd")},
 count(CASE WHEN is_fwd AND length > 0 THEN 1 END) AS fwd_act_data_pkts, CAST(min(CASE WHEN is_fwd THEN header END) AS BIGINT) AS fwd_seg_size_min,
 round(COALESCE(sum(length) / NULLIF((max(us) - min(us)) / 1e6, 0), 0), 3) AS flow_byts_s, round(COALESCE(count(*) / NULLIF((max(us) - min(us)) / 1e6, 0), 0), 3) AS flow_pkts_s,
 round(count(CASE WHEN NOT is_fwd THEN 1 END) / count(CASE WHEN is_fwd THEN 1 END), 3) AS down_up_ratio, round(avg(length), 3) AS pkt_size_avg, round(COALESCE(var_samp(length), 0), 1) AS pkt_len_var,
 {_figures("length", "pkt_len", 3)}, {_figures("gap", "flow_iat", 1)}, {_figures("idle", "idle", 1)}, {", ".join(_total(f, f + "_flag_cnt") for f in ("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece"))},
 CAST(max(attack) AS INT) AS label FROM wire_marks GROUP BY {_ENDS}, flow"""
CHECK_VIEWS["wire_active"] = f"""
SELECT {_ENDS}, flow, {_figures("lasted", "active", 1)} FROM (SELECT {_ENDS}, flow, max(us) - min(us) AS lasted FROM wire_marks GROUP BY {_ENDS}, flow, stretch) x GROUP BY {_ENDS}, flow"""
CHECK_VIEWS["wire_bulk"] = f"""
SELECT {_ENDS}, flow, {_bulk_way("fwd", "is_fwd")}, {_bulk_way("bwd", "NOT is_fwd")} FROM (
 SELECT {_ENDS}, flow, is_fwd, run, count(*) AS n, sum(length) AS bytes, max(us) - min(us) AS lasted FROM (
  SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER {_ORDER} AS run FROM (
   SELECT *, COALESCE(lag(is_fwd) OVER w <> is_fwd OR us - lag(us) OVER w > 1000000, TRUE) AS turn FROM wire_marks WHERE length > 0 WINDOW w AS ({_FLOW} ORDER BY us, pkt_id)) x) y
 GROUP BY {_ENDS}, flow, is_fwd, run HAVING count(*) >= 4) z GROUP BY {_ENDS}, flow"""
_BULKS = [f"{w}_{n}" for w in ("fwd", "bwd") for n in ("byts_b_avg", "pkts_b_avg", "blk_rate_avg")]


def digits(name):
    """Decimals that a sum over doubles keeps in whatever order it was added."""
    return 1 if name.endswith(("iat_mean", "iat_std", "_var")) or name.startswith(("active", "idle")) else 3


@query("flow_meter", f"""
SELECT CASE WHEN ahead THEN a ELSE b END AS src_ip, CASE WHEN ahead THEN b ELSE a END AS dst_ip, CASE WHEN ahead THEN port ELSE 80 END AS src_port, CASE WHEN ahead THEN 80 ELSE port END AS dst_port,
 * EXCLUDE (a, b, flow, ahead, port) FROM (SELECT m.*, CAST(1024 + CAST(split_part(a, '.', 4) AS INT) AS INT) AS port, x.* EXCLUDE ({_ENDS}, flow), {", ".join(f"COALESCE({c}, 0) AS {c}" for c in _BULKS)}
 FROM wire_main m JOIN wire_active x USING ({_ENDS}, flow) LEFT JOIN wire_bulk k USING ({_ENDS}, flow)) f""")
def _(t):
    flows = flowmeter.measure_flows(t.view("wire"), label="attack")
    return flows.select(*[F.round(c, digits(c)).alias(c) if k == "double" else F.col(c) for c, k in flows.dtypes])
