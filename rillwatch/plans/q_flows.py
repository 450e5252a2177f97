"""Queries over flows: filters, features, rules, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.functions.features import DERIVED, add_derived_features
from rillwatch.operators import clean, ipfilter, rules, windows
from rillwatch.plans.registry import query


def kept(t):
    return ipfilter.drop_filtered(t.view("flows"))


def unmatched(t):
    return rules.split_by_rules(kept(t))[1]


def rounded(df, places=6):
    """Doubles rounded the way the check SQL rounds them."""
    return df.select([F.round(c, places).alias(c) if d == "double" else F.col(c) for c, d in df.dtypes])


def joined(df, *cols):
    """Arrays as text, comparable across engines."""
    return df.withColumns({c: F.concat_ws("|", c) for c in cols})


# filters ---------------------------------------------------------------------------------------------------

@query("ip_filter", "SELECT flow_id, src_ip, dst_port FROM kept")
def _(t):
    return kept(t).select("flow_id", "src_ip", "dst_port")


@query("ip_filter_join", "SELECT src_ip, count(*) AS n FROM kept GROUP BY 1")
def _(t):
    lists = ipfilter.filter_lists(t.spark).select("entry")
    return ipfilter.drop_listed(t.view("flows"), lists).groupBy("src_ip").agg(F.count("*").alias("n"))


@query("capture_exclude_ips",
       "SELECT flow_id, src_ip, dst_ip FROM flows WHERE src_ip NOT IN ('192.168.241.1','172.217.194.81','8.8.8.8') "
       "AND dst_ip NOT IN ('192.168.241.1','172.217.194.81','8.8.8.8')")
def _(t):
    hosts = [*config.CAPTURE_EXCLUDED_IPS, "8.8.8.8"]
    return ipfilter.exclude_hosts(t.view("flows"), hosts).select("flow_id", "src_ip", "dst_ip")


# listed sources: customers in debt are whitelisted, those with a high balance blacklisted
_LISTED = "SELECT '203.0.0.' || CAST(c_custkey % 250 AS VARCHAR) AS ip FROM customer WHERE c_acctbal {}"
_WHITE, _BLACK = "< -900", "> 9900"


def _listed(t, balance):
    return t.table("customer").filter(f"c_acctbal {balance}").select(
        F.concat(F.lit("203.0.0."), (F.col("c_custkey") % 250).cast("string")).alias("ip"))


@query("whitelist_anti", f"SELECT flow_id, src_ip FROM flows WHERE src_ip NOT IN ({_LISTED.format(_WHITE)})")
def _(t):
    return ipfilter.drop_whitelisted(t.view("flows"), _listed(t, _WHITE)).select("flow_id", "src_ip")


@query("blacklist_override", f"""
SELECT flow_id, CASE WHEN b THEN 'DDoS' WHEN score >= 0.98 THEN 'DDoS' ELSE 'BENIGN' END AS prediction,
 round(CASE WHEN b THEN 1.0 WHEN score >= 0.98 THEN score ELSE 1 - score END, 6) AS confidence
FROM (SELECT flow_id, score, src_ip IN ({_LISTED.format(_BLACK)}) AS b FROM labeled) x""")
def _(t):
    from rillwatch.operators.scoring import label_scores

    scored = label_scores(t.view("labeled"))
    return rounded(ipfilter.override_blacklisted(scored, _listed(t, _BLACK)).select("flow_id", "prediction", "confidence"))


# columns ---------------------------------------------------------------------------------------------------

@query("col_alias_resolve", """
SELECT flow_id, CAST(totlen_fwd_pkts AS DOUBLE) AS fwd_bytes, CAST(totlen_bwd_pkts AS DOUBLE) AS bwd_bytes,
 CAST(tot_fwd_pkts AS DOUBLE) AS fwd_packets, CAST(0 AS DOUBLE) AS absent FROM flows""")
def _(t):
    renamed = t.view("flows").withColumnsRenamed({"totlen_fwd_pkts": "total_length_of_fwd_packets",
                                                  "totlen_bwd_pkts": "Subflow Bwd Bytes"})
    return renamed.select(
        "flow_id",
        clean.first_existing(renamed, config.FWD_BYTES_NAMES).cast("double").alias("fwd_bytes"),
        clean.first_existing(renamed, config.BWD_BYTES_NAMES).cast("double").alias("bwd_bytes"),
        clean.first_existing(renamed, config.FWD_PACKET_NAMES).cast("double").alias("fwd_packets"),
        clean.first_existing(renamed, ["nowhere"]).cast("double").alias("absent"),
    )


@query("normalize_columns", "SELECT flow_id, flow_duration, flow_iat_max, flow_iat_min AS flow_iat_mins FROM flows")
def _(t):
    raw = t.view("flows").select(
        F.col("flow_id").alias(" Flow ID"), F.col("flow_duration").alias("Flow Duration "),
        F.col("flow_iat_max").alias("Flow IAT Max"), F.col("flow_iat_min").alias("Flow IAT Min/s"))
    return clean.normalize_columns(raw)


@query("rename_columns_map", "SELECT flow_id, totlen_fwd_pkts AS fwd_packets_length_total, totlen_bwd_pkts AS bwd_packets_length_total FROM flows")
def _(t):
    raw = t.view("flows").select("flow_id", F.col("totlen_fwd_pkts").alias("total_length_of_fwd_packets"),
                                 F.col("totlen_bwd_pkts").alias("total_length_of_bwd_packets"))
    return clean.rename_columns(raw)


@query("drop_columns", "SELECT flow_id, src_port FROM flows")
def _(t):
    raw = t.view("flows").select("flow_id", "src_port", F.col("syn_flag_cnt").alias("init_fwd_win_bytes"),
                                 F.col("ack_flag_cnt").alias("init_bwd_win_bytes"))
    return clean.drop_unimportant(raw)


@query("select_common_numeric", "SELECT flow_id, src_port, dst_port, protocol, flow_duration, tot_bwd_pkts, totlen_fwd_pkts, totlen_bwd_pkts, flow_iat_min FROM flows_raw")
def _(t):
    a, b = t.view("flows_raw").drop("tot_fwd_pkts", "flow_iat_max"), t.view("labeled")
    return a.select(clean.common_numeric(a, b))


@query("coerce_numeric", """
SELECT flow_id, COALESCE(TRY_CAST(v AS DOUBLE), 0) AS v
FROM (SELECT flow_id, CASE WHEN flow_id % 11 = 0 THEN 'n/a' WHEN flow_id % 13 = 0 THEN NULL ELSE CAST(tot_fwd_pkts AS VARCHAR) || '.5' END AS v FROM flows) x""")
def _(t):
    text = F.when(F.col("flow_id") % 11 == 0, "n/a").when(F.col("flow_id") % 13 == 0, F.lit(None)).otherwise(
        F.concat(F.col("tot_fwd_pkts").cast("string"), F.lit(".5")))
    return t.view("flows").select("flow_id", clean.to_number(text).alias("v"))


_DIRTY = ["flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_iat_max", "flow_iat_min"]


@query("clean_inf_fill0", """
SELECT CAST(flow_id AS DOUBLE) AS flow_id, COALESCE(src_ip, '0') AS src_ip, CAST(flow_duration AS DOUBLE) AS flow_duration,
 COALESCE(tot_fwd_pkts, 0) AS tot_fwd_pkts, tot_bwd_pkts,
 CAST(totlen_fwd_pkts AS DOUBLE) AS totlen_fwd_pkts, CAST(totlen_bwd_pkts AS DOUBLE) AS totlen_bwd_pkts,
 round(CASE WHEN flow_iat_max IS NULL OR isinf(flow_iat_max) THEN 0 ELSE flow_iat_max END, 6) AS flow_iat_max,
 round(flow_iat_min, 6) AS flow_iat_min FROM flows_raw""")
def _(t):
    return rounded(clean.clean_for_topic(t.view("flows_raw").select("flow_id", "src_ip", *_DIRTY)))


@query("clean_median_dedup", """
WITH r AS (SELECT flow_id, src_ip, CAST(flow_duration AS DOUBLE) AS flow_duration, tot_fwd_pkts, CASE WHEN isinf(flow_iat_max) THEN NULL ELSE flow_iat_max END AS flow_iat_max FROM flows_raw),
 m AS (SELECT median(tot_fwd_pkts) AS a, median(flow_iat_max) AS b FROM r)
SELECT DISTINCT flow_id, src_ip, flow_duration, COALESCE(tot_fwd_pkts, a) AS tot_fwd_pkts, round(COALESCE(flow_iat_max, b), 6) AS flow_iat_max FROM r, m""")
def _(t):
    raw = t.view("flows_raw").select("flow_id", "src_ip", "flow_duration", "tot_fwd_pkts", "flow_iat_max")
    return rounded(clean.clean_labeled(raw, ["flow_duration", "tot_fwd_pkts", "flow_iat_max"]))


@query("clip_nonnegative", "SELECT flow_id, greatest(flow_duration, 0) AS flow_duration, round(flow_iat_max, 6) AS flow_iat_max FROM flows_raw")
def _(t):
    raw = t.view("flows_raw").select("flow_id", "flow_duration", "flow_iat_max")
    return rounded(clean.clip_nonnegative(raw))


@query("map_label_binary", "SELECT flow_id, CASE WHEN lower(label) = 'benign' THEN 0 ELSE 1 END AS y FROM labeled")
def _(t):
    return t.view("labeled").select("flow_id", clean.binary_label(F.col("label")).alias("y"))


_FEATURES_SQL = """
SELECT flow_id, tp AS total_packets, fb AS total_fwd_bytes, bb AS total_bwd_bytes, fb + bb AS total_bytes, round(d, 6) AS flow_duration,
 round(tp / d, 6) AS packet_rate, round((fb + bb) / d, 6) AS byte_rate, round(COALESCE((fb + bb) / NULLIF(tp, 0), 0), 6) AS mean_packet_size,
 round(COALESCE(f / NULLIF(tp, 0), 0), 6) AS fwd_ratio, round(greatest(flow_iat_max - flow_iat_min, 0), 6) AS iat_range,
 round(ln(1 + tp / d), 6) AS log_packet_rate, round(ln(1 + (fb + bb) / d), 6) AS log_byte_rate, round(ln(1 + fb + bb), 6) AS log_total_bytes, round(ln(1 + tp), 6) AS log_total_packets
FROM (SELECT *, CAST(tot_fwd_pkts AS DOUBLE) AS f, CAST(tot_fwd_pkts + tot_bwd_pkts AS DOUBLE) AS tp, CAST(totlen_fwd_pkts AS DOUBLE) AS fb,
  CAST(totlen_bwd_pkts AS DOUBLE) AS bb, CAST(greatest(flow_duration, 0) AS DOUBLE) + 1e-6 AS d FROM kept) x"""


@query("add_derived_features", _FEATURES_SQL)
def _(t):
    return rounded(add_derived_features(kept(t)).select("flow_id", *DERIVED))


@query("pred_compare", """
SELECT flow_id, protocol = 17 AS is_eq, protocol <> 17 AS is_ne, tot_fwd_pkts > 1000 AS is_gt, tot_fwd_pkts >= 1000 AS is_gte,
 flow_duration < 1000000 AS is_lt, flow_duration <= 1000000 AS is_lte, dst_port IN (37, 74, 111) AS is_in, false AS is_unknown,
 false AS is_uncastable, false AS text_vs_number FROM flows""")
def _(t):
    from rillwatch.functions.compare import compare

    f = t.view("flows")
    dt = {x.name: x.dataType for x in f.schema.fields}
    tries = [("is_eq", "protocol", "eq", 17), ("is_ne", "protocol", "ne", 17), ("is_gt", "tot_fwd_pkts", "gt", 1000),
             ("is_gte", "tot_fwd_pkts", "gte", "1000"), ("is_lt", "flow_duration", "lt", 1000000),
             ("is_lte", "flow_duration", "lte", 1000000), ("is_in", "dst_port", "in", [37, 74, 111, "x"]),
             ("is_unknown", "protocol", "like", 17), ("is_uncastable", "src_ip", "gt", 5), ("text_vs_number", "protocol", "eq", "17")]
    return f.select("flow_id", *[compare(F.col(c), dt[c], op, v).alias(n) for n, c, op, v in tries])


# rules and windows -----------------------------------------------------------------------------------------

@query("per_flow_rules", """
SELECT flow_id, 'PF-001' AS rule_id, 'medium' AS severity, 'protocol eq 17|tot_fwd_pkts gt 1000|flow_duration lt 1000000' AS matched_conditions
FROM kept WHERE protocol = 17 AND tot_fwd_pkts > 1000 AND flow_duration < 1000000""")
def _(t):
    hit, _rest = rules.split_by_rules(kept(t))
    return joined(hit.select("flow_id", "match.rule_id", "match.severity", "match.matched_conditions"), "matched_conditions")


@query("window_stats", "SELECT * FROM stats60")
def _(t):
    return rounded(windows.window_stats(unmatched(t), 60))


_RULES_ON = """
SELECT win, 'AGG-002' AS rule_id, 'critical' AS severity FROM stats60 WHERE udp_packet_count > 10000
UNION ALL SELECT win, 'AGG-005', 'high' FROM stats60 WHERE flows_per_ip > 200 AND packets_per_ip > 50000
UNION ALL SELECT win, 'AGG-006', 'medium' FROM stats60 WHERE unique_dst_ports_per_ip > 50 AND flows_per_ip > 50
UNION ALL SELECT win, 'AGG-007', 'medium' FROM stats60 WHERE unique_dst_ports > 100 AND udp_packet_count > 1000 AND udp_packet_count < 10000
UNION ALL SELECT win, 'AGG-008', 'high' FROM stats60 WHERE unique_src_ips > 50 AND flows_per_ip < 50 AND total_packets > 20000
UNION ALL SELECT win, 'AGG-009', 'critical' FROM stats60 WHERE unique_src_ips > 30 AND total_packets > 50000 AND total_flows > 500
%s"""
_AGG001 = "UNION ALL SELECT win, 'AGG-001', 'critical' FROM stats60 WHERE syn_flag_count > 500 AND syn_ack_ratio > 0.8"


@query("agg_rules", _RULES_ON % "")
def _(t):
    stats = windows.window_stats(unmatched(t), 60)
    return rules.window_matches(stats, window="60s").select("win", "rule_id", "severity")


@query("agg_rules_all_windows", _RULES_ON % _AGG001)
def _(t):
    return rules.window_matches(windows.window_stats(unmatched(t), 60)).select("win", "rule_id", "severity")


@query("flow_rule_theta", _RULES_ON % _AGG001)
def _(t):
    stats = windows.window_stats(unmatched(t), 60)
    return rules.match_rule_rows(stats, windows.STAT_NAMES, config.AGGREGATION_RULES).select("win", "rule_id", "severity")


@query("top_attackers", """
SELECT win, src_ip, flow_count, rank FROM (SELECT win, src_ip, flow_count, CAST(row_number() OVER (PARTITION BY win ORDER BY flow_count DESC, src_ip) AS INTEGER) AS rank
 FROM (SELECT epoch_us(flow_ts) // 60000000 AS win, src_ip, count(*) AS flow_count FROM rest GROUP BY 1, 2) a) b WHERE rank <= 5""")
def _(t):
    return windows.top_sources(unmatched(t), 60)


@query("trailing_counts", """
SELECT flow_id, src_ip, count(*) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS flows_30,
 count(*) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS flows_60,
 count(*) OVER (PARTITION BY src_ip ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS flows_300
FROM (SELECT *, epoch_us(flow_ts) AS us FROM kept) x""")
def _(t):
    return windows.trailing_counts(kept(t))


@query("every_nth_checkpoint", """
SELECT flow_id, rn FROM (SELECT flow_id, row_number() OVER (ORDER BY flow_ts, flow_id) AS rn FROM rest) x WHERE rn % 100 = 0""")
def _(t):
    return windows.every_nth(unmatched(t), 100).select("flow_id", "rn")


@query("checkpoint_range_join", """
WITH n AS (SELECT epoch_us(flow_ts) AS us, tot_fwd_pkts + tot_bwd_pkts AS p, row_number() OVER (ORDER BY flow_ts, flow_id) AS rn FROM rest)
SELECT c.rn, count(*) AS flows_60s, CAST(sum(f.p) AS BIGINT) AS packets_60s
FROM n c JOIN n f ON f.us BETWEEN c.us - 60000000 AND c.us WHERE c.rn % 100 = 0 GROUP BY 1""")
def _(t):
    return windows.checkpoint_totals(unmatched(t), 100, 60)


@query("top_talkers_bandwidth", """
SELECT protocol, src_ip, count(*) AS flows, CAST(sum(totlen_fwd_pkts + totlen_bwd_pkts) AS BIGINT) AS bytes, CAST(sum(tot_fwd_pkts + tot_bwd_pkts) AS BIGINT) AS packets
FROM flows GROUP BY ROLLUP (protocol, src_ip)""")
def _(t):
    return t.view("flows").rollup("protocol", "src_ip").agg(
        F.count("*").alias("flows"), F.sum(F.col("totlen_fwd_pkts") + F.col("totlen_bwd_pkts")).alias("bytes"),
        F.sum(F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")).alias("packets"))


@query("top_talkers_ranked", """
SELECT src_ip, CAST(sum(totlen_fwd_pkts + totlen_bwd_pkts) AS BIGINT) AS bytes FROM flows GROUP BY 1 ORDER BY bytes DESC, src_ip LIMIT 20""")
def _(t):
    return t.view("flows").groupBy("src_ip").agg(
        F.sum(F.col("totlen_fwd_pkts") + F.col("totlen_bwd_pkts")).alias("bytes")).orderBy(F.desc("bytes"), "src_ip").limit(20)
