"""Queries over alerts: counts, state per address, suppression, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.functions import weblog
from rillwatch.operators import alerts, ipstate, rules, scoring, suppress, windows
from rillwatch.operators.windows import SECOND, micros, window_number
from rillwatch.plans.q_flows import joined, kept, rounded, unmatched
from rillwatch.plans.registry import CHECK_VIEWS, query

# threshold for the window queries: the shipped 0.98 would leave too few suspicious flows in the fixture scores
WINDOW_THRESHOLD = 0.6

CHECK_VIEWS.update({
    "scored": f"SELECT *, CASE WHEN score >= {WINDOW_THRESHOLD} THEN 'DDoS' ELSE 'BENIGN' END AS prediction FROM labeled",
    "ml30": """
SELECT epoch_us(flow_ts) // 30000000 AS win, count(*) AS total_flows, count(CASE WHEN prediction <> 'BENIGN' THEN 1 END) AS suspicious_flows,
 count(DISTINCT CASE WHEN prediction <> 'BENIGN' THEN src_ip END) AS unique_attackers FROM scored GROUP BY 1""",
    "ml_level": """
SELECT *, suspicious_flows / CAST(greatest(total_flows, 1) AS DOUBLE) AS suspicious_ratio, CASE WHEN total_flows < 50 THEN NULL
 WHEN suspicious_flows >= 100 AND suspicious_flows / total_flows >= 0.8 THEN 'critical' WHEN suspicious_flows >= 50 AND suspicious_flows / total_flows >= 0.6 THEN 'high'
 WHEN suspicious_flows >= 20 AND suspicious_flows / total_flows >= 0.4 THEN 'medium' WHEN suspicious_flows >= 10 AND suspicious_flows / total_flows >= 0.2 THEN 'low' END AS severity
FROM ml30""",
    "by_ip": "SELECT *, unnest(attacker_ips) AS ip FROM alerts",
    # one event after the other per address: 0 alert, 1 action
    "ip_states": """
WITH RECURSIVE e AS (
 SELECT ip, us, kind, sev, typ, conf, fc, action, row_number() OVER (PARTITION BY ip ORDER BY us, kind, tie) AS i FROM (
  SELECT ip, epoch_us(alert_ts) AS us, 0 AS kind, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS sev,
    rule_name AS typ, suspicious_ratio AS conf, flow_count AS fc, '' AS action, alert_id AS tie FROM by_ip
  UNION ALL SELECT DISTINCT ip, epoch_us(action_ts), 1, 0, '', 0.0, 0, action, action FROM admin_actions) u),
 s AS (
 SELECT ip, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, 0 AS rank, CAST(NULL AS VARCHAR) AS attack_type, CAST(NULL AS DOUBLE) AS confidence,
   CAST(0 AS BIGINT) AS flow_count, CAST(0 AS BIGINT) AS alert_count, CAST(NULL AS BIGINT) AS first_us, CAST(NULL AS BIGINT) AS last_us,
   CAST(NULL AS BIGINT) AS expires_us, false AS whitelisted FROM (SELECT DISTINCT ip FROM e) d
 UNION ALL
 SELECT ip, i, CASE WHEN kind = 0 AND NOT whitelisted AND st IS NULL THEN 'pending' WHEN kind = 1 AND st IS NOT NULL THEN CASE action WHEN 'approve' THEN 'blocked' WHEN 'reject' THEN 'whitelisted' ELSE 'unblocked' END ELSE st END,
  CASE WHEN kind = 1 OR whitelisted THEN rank WHEN st IS NULL THEN sev ELSE greatest(rank, sev) END,
  CASE WHEN kind = 0 AND NOT whitelisted AND st IS NULL THEN typ ELSE attack_type END,
  CASE WHEN kind = 0 AND NOT whitelisted AND st IS NULL THEN conf ELSE confidence END,
  CAST(CASE WHEN kind = 1 OR whitelisted THEN flow_count WHEN st IS NULL THEN fc ELSE flow_count + fc END AS BIGINT),
  CAST(CASE WHEN kind = 1 OR whitelisted THEN alert_count WHEN st IS NULL THEN 1 ELSE alert_count + 1 END AS BIGINT),
  CASE WHEN kind = 0 AND NOT whitelisted AND st IS NULL THEN us ELSE first_us END,
  CASE WHEN kind = 0 AND NOT whitelisted THEN us ELSE last_us END,
  CASE WHEN kind = 1 AND st IS NOT NULL AND action = 'approve' THEN us + 3600000000 WHEN kind = 0 AND NOT whitelisted AND st IS NULL THEN NULL
   WHEN kind = 0 AND NOT whitelisted AND st = 'blocked' THEN us + 3600000000 ELSE expires_us END,
  whitelisted OR (kind = 1 AND st IS NOT NULL AND action = 'reject')
 FROM (SELECT e.ip, e.i, e.us, e.kind, e.sev, e.typ, e.conf, e.fc, e.action, s.* EXCLUDE (ip, i),
   CASE WHEN s.expires_us IS NOT NULL AND e.us >= s.expires_us THEN NULL ELSE s.status END AS st FROM s JOIN e ON e.ip = s.ip AND e.i = s.i + 1) n)
SELECT ip, status, CASE rank WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity, attack_type, confidence, flow_count, alert_count,
 first_us, last_us, expires_us, whitelisted FROM (SELECT s.*, row_number() OVER (PARTITION BY ip ORDER BY i DESC) AS newest FROM s) z WHERE newest = 1 AND status IS NOT NULL""",
    "live_states": """
SELECT *, CASE WHEN status = 'blocked' THEN greatest(CAST(floor((expires_us - at_us) / 1000000.0) AS BIGINT), 0) ELSE 0 END AS ttl_seconds
FROM ip_states, (SELECT max(1704067200000000 + t_us) AS at_us FROM ev) c WHERE expires_us IS NULL OR expires_us > at_us""",
})


def scored(t):
    return scoring.label_scores(t.view("labeled"), threshold=WINDOW_THRESHOLD)


def states(t):
    return ipstate.address_states(t.view("alerts"), t.view("admin_actions"))


def live_states(t):
    """States as of the last event of the table."""
    end = t.view("ev").agg((F.max("t_us") + 1704067200000000).alias("at_us")).first()["at_us"]
    return ipstate.live(states(t), F.lit(end))


def seconds_of(df, *cols):
    """Timestamps as microseconds, comparable across engines."""
    return df.withColumns({c: micros(c) for c in cols})


# model side ------------------------------------------------------------------------------------------------

@query("label_threshold", """
SELECT flow_id, CASE WHEN score >= 0.98 THEN 'DDoS' ELSE 'BENIGN' END AS prediction, round(CASE WHEN score >= 0.98 THEN score ELSE 1 - score END, 6) AS confidence FROM labeled""")
def _(t):
    return rounded(scoring.label_scores(t.view("labeled")).select("flow_id", "prediction", "confidence"))


@query("ml_window_stats", "SELECT win, total_flows, suspicious_flows, unique_attackers, round(suspicious_flows / CAST(greatest(total_flows, 1) AS DOUBLE), 6) AS suspicious_ratio FROM ml30")
def _(t):
    return rounded(windows.scored_window_stats(scored(t), 30))


@query("severity_ladder", "SELECT win, total_flows, suspicious_flows, severity FROM ml_level")
def _(t):
    stats = windows.scored_window_stats(scored(t), 30)
    return stats.select("win", "total_flows", "suspicious_flows", scoring.severity(
        F.col("suspicious_flows"), F.col("suspicious_ratio"), F.col("total_flows")).alias("severity"))


@query("recommendation_lookup", """
SELECT win, CASE severity WHEN 'critical' THEN 'Immediate blocking required. High confidence attack.' WHEN 'high' THEN 'Investigate and block if confirmed.'
 WHEN 'medium' THEN 'Monitor closely. Potential attack.' WHEN 'low' THEN 'Low priority warning.' ELSE 'Unknown severity level' END AS recommendation FROM ml_level""")
def _(t):
    stats = windows.scored_window_stats(scored(t), 30)
    level = scoring.severity(F.col("suspicious_flows"), F.col("suspicious_ratio"), F.col("total_flows"))
    return stats.select("win", scoring.recommendation(level).alias("recommendation"))


_TOP_BAD = """
SELECT win, src_ip, flow_count, rank FROM (SELECT win, src_ip, flow_count, CAST(row_number() OVER (PARTITION BY win ORDER BY flow_count DESC, src_ip) AS INTEGER) AS rank
 FROM (SELECT epoch_us(flow_ts) // 30000000 AS win, src_ip, count(*) AS flow_count FROM scored WHERE prediction <> 'BENIGN' GROUP BY 1, 2) a) b"""


@query("top_suspicious_ips", _TOP_BAD + " WHERE rank <= 10")
def _(t):
    return windows.top_sources(scored(t).filter("prediction <> 'BENIGN'"), 30, 10)


def model_alert_rows(t):
    bad = scored(t).filter("prediction <> 'BENIGN'")
    return alerts.model_alerts(windows.scored_window_stats(scored(t), 30), windows.top_list(windows.top_sources(bad, 30, 5)), 30)


@query("model_alerts", f"""
SELECT l.win, 'ddos_' || CAST((l.win + 1) * 30 AS VARCHAR) AS alert_id, severity, 'DDoS_Mixed' AS attack_type, suspicious_flows AS flow_count, '30s' AS time_window,
 string_agg(src_ip, '|' ORDER BY rank) AS attacker_ips FROM ml_level l JOIN ({_TOP_BAD}) r USING (win) WHERE severity IS NOT NULL AND rank <= 5 GROUP BY ALL""")
def _(t):
    return joined(model_alert_rows(t).select("win", "alert_id", "severity", "attack_type", "flow_count", "time_window", "attacker_ips"), "attacker_ips")


@query("rule_vs_ml_compare", """
SELECT win, severity, COALESCE(a.n, 0) AS rule_alerts, COALESCE(b.n, 0) AS model_alerts FROM
 (SELECT epoch_us(alert_ts) // 300000000 AS win, severity, count(*) AS n FROM alerts GROUP BY 1, 2) a FULL JOIN
 (SELECT (win + 1) * 30 // 300 AS win, severity, count(*) AS n FROM ml_level WHERE severity IS NOT NULL GROUP BY 1, 2) b USING (win, severity)""")
def _(t):
    per = lambda df, name: df.groupBy(window_number("alert_ts", 300).alias("win"), "severity").agg(F.count("*").alias(name))
    both = per(t.view("alerts"), "rule_alerts").join(per(model_alert_rows(t), "model_alerts"), ["win", "severity"], "full")
    return both.fillna(0, ["rule_alerts", "model_alerts"])


# counting alerts -------------------------------------------------------------------------------------------

@query("severity_breakdown", "SELECT severity, count(*) AS n FROM alerts GROUP BY 1")
def _(t):
    return alerts.severity_counts(t.view("alerts"))


@query("attacker_summary", """
SELECT ip, CAST(sum(n) AS BIGINT) AS alert_count, min(f) AS first_seen, max(l) AS last_seen, string_agg(severity || ':' || CAST(n AS VARCHAR), '|' ORDER BY severity) AS severities
FROM (SELECT ip, severity, count(*) AS n, min(epoch_us(alert_ts)) AS f, max(epoch_us(alert_ts)) AS l FROM by_ip GROUP BY 1, 2) x GROUP BY 1""")
def _(t):
    out = seconds_of(alerts.attacker_summary(t.view("alerts")), "first_seen", "last_seen")
    return out.withColumn("severities", F.array_join(F.transform("severities", lambda s: F.concat(s["severity"], F.lit(":"), s["n"].cast("string"))), "|"))


_FOLDED = """
SELECT ip, arg_min(rule_name, (alert_ts, alert_id)) AS attack_type, arg_min(suspicious_ratio, (alert_ts, alert_id)) AS confidence, CAST(sum(flow_count) AS BIGINT) AS flow_count,
 count(*) AS alert_count, min(epoch_us(alert_ts)) AS first_seen, max(epoch_us(alert_ts)) AS last_seen,
 CASE max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity
FROM by_ip GROUP BY 1"""


@query("ip_state_fold", _FOLDED)
def _(t):
    return seconds_of(alerts.fold_ip_state(t.view("alerts")), "first_seen", "last_seen")


@query("alert_ip_frequency", "SELECT ip, count(*) AS n FROM by_ip GROUP BY 1 ORDER BY n DESC, ip LIMIT 20")
def _(t):
    return alerts.per_attacker(t.view("alerts")).groupBy("ip").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ip").limit(20)


@query("summary_top10", """
SELECT ip, alert_count, n_more FROM (SELECT ip, count(*) AS alert_count FROM by_ip GROUP BY 1) a, (SELECT greatest(count(DISTINCT ip) - 10, 0) AS n_more FROM by_ip) b
ORDER BY alert_count DESC, ip LIMIT 10""")
def _(t):
    return alerts.top_attackers_with_rest(t.view("alerts"))


@query("alert_dedup", """
SELECT alert_id, rule_id, severity, us FROM (SELECT alert_id, rule_id, severity, epoch_us(alert_ts) AS us,
 row_number() OVER (PARTITION BY alert_id ORDER BY alert_ts, severity, flow_count) AS i FROM alerts) x WHERE i = 1""")
def _(t):
    kept_rows = alerts.first_of_each(t.view("alerts"), ["alert_ts", "severity", "flow_count"])
    return kept_rows.select("alert_id", "rule_id", "severity", micros("alert_ts").alias("us"))


@query("alert_ip_state_join", f"""
SELECT a.alert_id, a.ip, epoch_us(a.alert_ts) AS us, f.severity AS known_severity FROM by_ip a LEFT JOIN ({_FOLDED}) f USING (ip)
WHERE a.ip NOT IN (SELECT ip FROM admin_actions WHERE action = 'reject')""")
def _(t):
    rejected = t.view("admin_actions").filter("action = 'reject'")
    known = alerts.fold_ip_state(t.view("alerts")).withColumn("status", F.lit("pending"))
    out = ipstate.with_block_list(alerts.per_attacker(t.view("alerts")), known, rejected)
    return out.select("alert_id", "ip", micros("alert_ts").alias("us"), "known_severity")


@query("attack_interval_join", """
WITH i AS (SELECT src_ip, min(flow_ts) AS f, max(flow_ts) AS l FROM kept WHERE protocol = 17 AND tot_fwd_pkts > 1000 AND flow_duration < 1000000 GROUP BY 1)
SELECT k.flow_id, k.src_ip, i.src_ip IS NOT NULL AS in_attack FROM kept k LEFT JOIN i ON i.src_ip = k.src_ip AND k.flow_ts BETWEEN i.f AND i.l""")
def _(t):
    hit, _rest = rules.split_by_rules(kept(t))
    spans = alerts.flow_alerts(hit).select(F.explode("attacker_ips").alias("src_ip"), "alert_ts").groupBy("src_ip").agg(
        F.min("alert_ts").alias("f"), F.max("alert_ts").alias("l"))
    inside = F.coalesce(F.col("flow_ts").between(F.col("f"), F.col("l")), F.lit(False))
    return kept(t).join(spans, "src_ip", "left").select("flow_id", "src_ip", inside.alias("in_attack"))


# state per address -----------------------------------------------------------------------------------------

@query("ip_state_machine", "SELECT ip, status, severity, attack_type, confidence, flow_count, alert_count, first_us, last_us, expires_us, whitelisted FROM ip_states")
def _(t):
    return states(t).filter(F.col("status").isNotNull()).drop("duration_us")


@query("ip_status_counts", "SELECT status, count(*) AS n FROM live_states GROUP BY 1")
def _(t):
    return ipstate.status_counts(live_states(t))


@query("pending_ips", "SELECT ip, severity, alert_count, flow_count FROM live_states WHERE status = 'pending'")
def _(t):
    return ipstate.pending(live_states(t)).select("ip", "severity", "alert_count", "flow_count")


@query("blocked_ips", "SELECT ip, severity, last_us, ttl_seconds FROM live_states WHERE status = 'blocked'")
def _(t):
    return ipstate.blocked(live_states(t)).select("ip", "severity", "last_us", "ttl_seconds")


@query("ip_sets_union", "SELECT ip, status AS block_status FROM live_states WHERE status IN ('pending', 'blocked', 'whitelisted')")
def _(t):
    return ipstate.status_sets(live_states(t))


@query("ts_ip_metadata_snapshot", """
SELECT ip, severity, attack_type, status AS block_status, CAST(confidence AS VARCHAR) AS confidence, CAST(flow_count AS VARCHAR) AS flow_count, CAST(alert_count AS VARCHAR) AS alert_count,
 CAST(first_us AS VARCHAR) AS first_us, CAST(last_us AS VARCHAR) AS last_us, '3600' AS block_duration, CAST(ttl_seconds AS VARCHAR) AS ttl_seconds, 1.0::DOUBLE AS value
FROM live_states WHERE status IN ('pending', 'blocked', 'whitelisted')""")
def _(t):
    return ipstate.metadata_snapshot(live_states(t))


# suppression -----------------------------------------------------------------------------------------------

def _cooldown_sql(key, us):
    return f"""
WITH RECURSIVE c AS (SELECT {key}, min(epoch_us(alert_ts)) AS us FROM alerts GROUP BY 1
 UNION ALL SELECT c.{key}, (SELECT min(epoch_us(a.alert_ts)) FROM alerts a WHERE a.{key} = c.{key} AND epoch_us(a.alert_ts) >= c.us + {us}) FROM c WHERE c.us IS NOT NULL)
SELECT c.{key}, c.us, min(a.alert_id) AS alert_id FROM c JOIN alerts a ON a.{key} = c.{key} AND epoch_us(a.alert_ts) = c.us GROUP BY 1, 2"""


@query("rule_cooldown", _cooldown_sql("rule_id", 60 * SECOND))
def _(t):
    return suppress.cooldown(t.view("alerts"), "rule_id", config.RULE_COOLDOWN_SECONDS)


@query("severity_cooldown", _cooldown_sql("severity", 300 * SECOND))
def _(t):
    return suppress.cooldown(t.view("alerts"), "severity", config.SEVERITY_COOLDOWN_SECONDS)


@query("notify_gate")
def _(t):
    return suppress.notify_gate(t.view("alerts"))


@query("notify_summary")
def _(t):
    return suppress.notify_summaries(t.view("alerts"))


@query("rate_limit_replay")
def _(t):
    log = t.view("http_log").withColumn("zone", weblog.rate_zone(F.col("uri")))
    return suppress.replay_rate_limit(log)


# rendering -------------------------------------------------------------------------------------------------

CHECK_VIEWS["rule_text"] = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}', '{}', [{}])".format(
        r["id"], r["name"], r["severity"], r["description"], r["action"],
        ", ".join(f"'{c['metric']} {c['operator']} {c['value']}'" for c in r["conditions"]))
    for r in config.AGGREGATION_RULES) + ") v(rule_id, rule_name, severity, description, action, conds)"

_FIRED = """
SELECT win, 'AGG-001' AS rule_id FROM stats60 WHERE syn_flag_count > 500 AND syn_ack_ratio > 0.8
UNION ALL SELECT win, 'AGG-002' FROM stats60 WHERE udp_packet_count > 10000
UNION ALL SELECT win, 'AGG-005' FROM stats60 WHERE flows_per_ip > 200 AND packets_per_ip > 50000
UNION ALL SELECT win, 'AGG-006' FROM stats60 WHERE unique_dst_ports_per_ip > 50 AND flows_per_ip > 50
UNION ALL SELECT win, 'AGG-007' FROM stats60 WHERE unique_dst_ports > 100 AND udp_packet_count > 1000 AND udp_packet_count < 10000
UNION ALL SELECT win, 'AGG-008' FROM stats60 WHERE unique_src_ips > 50 AND flows_per_ip < 50 AND total_packets > 20000
UNION ALL SELECT win, 'AGG-009' FROM stats60 WHERE unique_src_ips > 30 AND total_packets > 50000 AND total_flows > 500"""
_REPORT = """CASE rule_id
 WHEN 'AGG-001' THEN '  • SYN Packets: <b>' || format('{:,}', syn_flag_count) || '</b>\n  • ACK Packets: <b>' || format('{:,}', ack_flag_count) || '</b>\n  • SYN/ACK Ratio: <b>' || printf('%.2f%%', syn_ack_ratio * 100) || '</b>\n  • TCP Packets: <b>' || format('{:,}', tcp_packet_count) || '</b>\n'
 WHEN 'AGG-006' THEN '  • Unique Dst Ports: <b>' || unique_dst_ports || '</b>\n  • Ports/IP: <b>' || printf('%.1f', CAST(unique_dst_ports_per_ip AS DOUBLE)) || '</b>\n  • Unique Src IPs: <b>' || unique_src_ips || '</b>\n'
 WHEN 'AGG-002' THEN '  • UDP Packets: <b>' || format('{:,}', udp_packet_count) || '</b>\n  • Unique Dst Ports: <b>' || unique_dst_ports || '</b>\n  • Packets/IP: <b>' || printf('%.1f', CAST(packets_per_ip AS DOUBLE)) || '</b>\n'
 WHEN 'AGG-007' THEN '  • UDP Packets: <b>' || format('{:,}', udp_packet_count) || '</b>\n  • Unique Dst Ports: <b>' || unique_dst_ports || '</b>\n  • Packets/IP: <b>' || printf('%.1f', CAST(packets_per_ip AS DOUBLE)) || '</b>\n'
 ELSE '  • Unique Src IPs: <b>' || unique_src_ips || '</b>\n' || CASE WHEN unique_dst_ports <> 0 THEN '  • Unique Dst Ports: <b>' || unique_dst_ports || '</b>\n' ELSE '' END END"""


def window_alert_rows(t):
    flows = unmatched(t)
    stats = windows.window_stats(flows, 60)
    return alerts.window_alerts(rules.window_matches(stats), windows.top_list(windows.top_sources(flows, 60)), 60)


@query("alert_type_metrics", f"""
SELECT 'rule_' || rule_id || '_' || CAST((win + 1) * 60 AS VARCHAR) AS alert_id,
 CASE rule_id WHEN 'AGG-001' THEN 'SYN' WHEN 'AGG-002' THEN 'UDP' WHEN 'AGG-007' THEN 'UDP' WHEN 'AGG-006' THEN 'SCAN' ELSE 'OTHER' END AS family,
 replace({_REPORT}, '\\n', chr(10)) AS report FROM ({_FIRED}) f JOIN stats60 USING (win)""".replace("\n  •", "\\n  •").replace("</b>\n", "</b>\\n"))
def _(t):
    family = alerts.attack_family(F.col("rule_name"))
    return window_alert_rows(t).select("alert_id", family.alias("family"), alerts.family_report(family).alias("report"))


@query("alert_format", f"""
WITH tops AS (SELECT win, list(src_ip ORDER BY rank) AS ips FROM (SELECT win, src_ip, row_number() OVER (PARTITION BY win ORDER BY c DESC, src_ip) AS rank
  FROM (SELECT epoch_us(flow_ts) // 60000000 AS win, src_ip, count(*) AS c FROM rest GROUP BY 1, 2) a) b WHERE rank <= 5 GROUP BY 1)
SELECT 'rule_' || rule_id || '_' || CAST((win + 1) * 60 AS VARCHAR) AS alert_id, replace(
 CASE r.severity WHEN 'medium' THEN '🟡' WHEN 'high' THEN '🔴' ELSE '🚨' END || ' <b>DDoS ALERT - ' || upper(r.severity) || '</b>\\n\\n<b>Time:</b> '
 || strftime(make_timestamp((win + 1) * 60000000), '%Y-%m-%d %H:%M:%S') || '\\n<b>Type:</b> ' || r.rule_name || '\\n<b>Rule:</b> ' || rule_id || '\\n<b>Description:</b> ' || r.description
 || '\\n<b>Confidence:</b> 100.0%\\n\\n<b>📊 Attack Statistics:</b>\\n  • Total Flows: <b>' || format('{{:,}}', total_flows) || '</b>\\n' || {_REPORT}
 || '\\n<b>🎯 Attackers (' || len(ips) || '):</b>\\n' || array_to_string(['  • <code>' || x || '</code>\\n' for x in ips], '')
 || '\\n<b>⚡ Action:</b> ' || r.action || '\\n\\n<b>✓ Matched Conditions:</b>\\n' || array_to_string(['  • ' || x || '\\n' for x in conds], '')
 || '\\n<i>ID: rule_' || rule_id || '_' || CAST((win + 1) * 60 AS VARCHAR) || '</i>', '\\n', chr(10)) AS message
FROM ({_FIRED}) f JOIN stats60 USING (win) JOIN rule_text r USING (rule_id) JOIN tops USING (win)""".replace("\n  •", "\\n  •").replace("</b>\n", "</b>\\n"))
def _(t):
    return alerts.format_alert(window_alert_rows(t)).select("alert_id", "message")
