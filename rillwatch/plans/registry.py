"""Names of the runnable queries, each with the SQL that checks it."""

from __future__ import annotations

from rillwatch.fixtures import Inputs, oracle_query

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# views that only the check SQL uses
CHECK_VIEWS = {
    "kept": """
SELECT * FROM flows WHERE src_ip IS NOT NULL
 AND NOT (src_ip LIKE '192.168.%' OR src_ip LIKE '10.%' OR src_ip LIKE '127.%' OR src_ip LIKE '169.254.%'
  OR (src_ip LIKE '172.%' AND TRY_CAST(split_part(src_ip, '.', 2) AS INTEGER) BETWEEN 16 AND 31))
 AND src_ip NOT IN ('8.8.8.8','8.8.4.4','1.1.1.1','1.0.0.1','9.9.9.9','149.112.112.112','208.67.222.222','208.67.220.220')
 AND split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2) NOT IN
  ('74.125','142.250','142.251','172.217','172.253','216.58','64.233','104.16','104.17','104.18')""",
    "rest": """
SELECT * FROM kept WHERE NOT (protocol = 17 AND tot_fwd_pkts > 1000 AND flow_duration < 1000000)""",
    "stats60": """
SELECT w.*, COALESCE(m.fpi, 0) AS flows_per_ip, COALESCE(m.ppi, 0) AS packets_per_ip, COALESCE(m.dpi, 0) AS unique_dst_ports_per_ip
FROM (SELECT epoch_us(flow_ts) // 60000000 AS win, count(*) AS total_flows,
   CAST(sum(CASE WHEN protocol = 6 THEN syn_flag_cnt ELSE 0 END) AS BIGINT) AS syn_flag_count,
   CAST(sum(CASE WHEN protocol = 6 THEN ack_flag_cnt ELSE 0 END) AS BIGINT) AS ack_flag_count,
   CAST(sum(CASE WHEN protocol = 6 THEN tot_fwd_pkts + tot_bwd_pkts ELSE 0 END) AS BIGINT) AS tcp_packet_count,
   CAST(sum(CASE WHEN protocol = 17 THEN tot_fwd_pkts + tot_bwd_pkts ELSE 0 END) AS BIGINT) AS udp_packet_count,
   CAST(sum(CASE WHEN protocol = 1 THEN tot_fwd_pkts + tot_bwd_pkts ELSE 0 END) AS BIGINT) AS icmp_packet_count,
   CAST(sum(CASE WHEN protocol IN (1, 6, 17) THEN tot_fwd_pkts + tot_bwd_pkts ELSE 0 END) AS BIGINT) AS total_packets,
   count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT CASE WHEN dst_port <> 0 THEN dst_port END) AS unique_dst_ports,
   round(COALESCE(sum(CASE WHEN protocol = 6 THEN syn_flag_cnt ELSE 0 END) / NULLIF(CAST(sum(CASE WHEN protocol = 6 THEN syn_flag_cnt + ack_flag_cnt ELSE 0 END) AS DOUBLE), 0), 0), 6) AS syn_ack_ratio
  FROM rest GROUP BY 1) w
JOIN (SELECT win, max(f) AS fpi, CAST(max(p) AS BIGINT) AS ppi, max(d) AS dpi FROM
  (SELECT epoch_us(flow_ts) // 60000000 AS win, src_ip, count(*) AS f, sum(tot_fwd_pkts + tot_bwd_pkts) AS p,
    count(DISTINCT CASE WHEN dst_port <> 0 THEN dst_port END) AS d FROM rest GROUP BY 1, 2) x GROUP BY 1) m USING (win)""",
}


def query(name: str, check: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``; ``check`` is SQL over tables and fixture views."""

    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if check:
            ORACLES[name] = oracle_query(check, CHECK_VIEWS)
        return fn

    return keep
