"""Views over the base tables that give flows, alerts, logs, metrics, packets, posts and comments.

Each view is one SQL template; the tokens differ between Spark and the SQL oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwatch.session import cut_lineage

SPARK = {
    "K": "CAST(get_json_object(props, '$.k') AS INT)",
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "DIV": "div",
    "TS": "timestamp_micros",
    "STR": "STRING",
    "ARR": "array",
}
DUCK = {
    "K": "CAST(json_extract_string(props, '$.k') AS INTEGER)",
    "US": "epoch_us(ts)",
    "DIV": "//",
    "TS": "make_timestamp",
    "STR": "VARCHAR",
    "ARR": "list_value",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "ev": """
SELECT event_id, user_id, event_type, value, {K} AS k, ({US} - 1704067200000000) {DIV} 720 AS t_us FROM events""",
    "flows": """
SELECT event_id AS flow_id, {TS}(1704067200000000 + t_us) AS flow_ts,
  CASE WHEN user_id % 10 = 0 THEN '192.168.1.' || CAST(user_id % 250 AS {STR})
       WHEN user_id % 10 = 1 THEN '8.8.8.8'
       WHEN user_id % 10 = 2 THEN '74.125.0.' || CAST(user_id % 250 AS {STR})
       WHEN ((t_us {DIV} 60000000) % 60) % 5 = 0 AND user_id % 10 < 9 THEN '198.51.100.7'
       ELSE '203.0.' || CAST(user_id {DIV} 250 AS {STR}) || '.' || CAST(user_id % 250 AS {STR}) END AS src_ip,
  '198.51.100.200' AS dst_ip,
  CAST(1024 + event_id % 60000 AS INT) AS src_port,
  CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE k * 37 + event_id % 7 END AS INT) AS dst_port,
  CASE WHEN event_type IN ('click','view') THEN 6 WHEN event_type = 'signup' THEN 1 ELSE 17 END AS protocol,
  CAST((event_id % 5000) * 400 AS BIGINT) AS flow_duration,
  CAST(FLOOR(value * 20) AS BIGINT) AS tot_fwd_pkts,
  CAST(k AS BIGINT) AS tot_bwd_pkts,
  CAST(FLOOR(value * 20) AS BIGINT) * (40 + k) AS totlen_fwd_pkts,
  CAST(k * 60 AS BIGINT) AS totlen_bwd_pkts,
  value * 1000 AS flow_iat_max, value * 10 AS flow_iat_min,
  CAST(CASE WHEN event_type IN ('click','view') THEN CASE WHEN ((t_us {DIV} 60000000) % 60) % 7 = 0 THEN 40 ELSE 2 END ELSE 0 END AS BIGINT) AS syn_flag_cnt,
  CAST(CASE WHEN event_type IN ('click','view') THEN 4 ELSE 0 END AS BIGINT) AS ack_flag_cnt
FROM ev""",
    "labeled": """
SELECT f.*, CASE WHEN src_ip = '198.51.100.7' THEN 'DDoS' WHEN protocol = 17 THEN 'Syn' WHEN flow_id % 2 = 0 THEN 'BENIGN' ELSE 'Benign' END AS label,
  CASE WHEN src_ip = '198.51.100.7' OR protocol = 17 THEN 0.5e0 + CAST((flow_id * 7919) % 1000 AS DOUBLE) / 2000e0
       ELSE CAST((flow_id * 7919) % 1000 AS DOUBLE) / 1010e0 END AS score
FROM flows f""",
    "flows_raw": """
SELECT flow_id, flow_ts, CASE WHEN flow_id % 97 = 0 THEN NULL ELSE src_ip END AS src_ip, dst_ip, src_port, dst_port, protocol,
  CASE WHEN flow_id % 89 = 0 THEN -flow_duration ELSE flow_duration END AS flow_duration,
  CAST(CASE WHEN flow_id % 83 = 0 THEN NULL ELSE tot_fwd_pkts END AS DOUBLE) AS tot_fwd_pkts,
  CAST(tot_bwd_pkts AS DOUBLE) AS tot_bwd_pkts, totlen_fwd_pkts, totlen_bwd_pkts,
  CASE WHEN flow_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN flow_id % 103 = 0 THEN NULL ELSE flow_iat_max END AS flow_iat_max, flow_iat_min
FROM flows
UNION ALL
SELECT flow_id, flow_ts, src_ip, dst_ip, src_port, dst_port, protocol, flow_duration, CAST(tot_fwd_pkts AS DOUBLE), CAST(tot_bwd_pkts AS DOUBLE), totlen_fwd_pkts, totlen_bwd_pkts, flow_iat_max, flow_iat_min
FROM flows WHERE flow_id % 50 = 0""",
    "alerts": """
SELECT 'rule_' || CAST(k % 7 AS {STR}) || '_' || CAST(t_us {DIV} 1000000 AS {STR}) AS alert_id,
  'R-00' || CAST(k % 7 AS {STR}) AS rule_id,
  CASE k % 7 WHEN 0 THEN 'SYN Flood Attack' WHEN 1 THEN 'UDP Flood Attack' WHEN 2 THEN 'UDP Port Scan' WHEN 3 THEN 'Port Scan Detection' WHEN 4 THEN 'ICMP Flood' WHEN 5 THEN 'Slowloris' ELSE 'High Volume from Single IP' END AS rule_name,
  CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  {TS}(1704067200000000 + t_us) AS alert_ts,
  {ARR}('203.0.113.' || CAST(user_id % 25 AS {STR}), '203.0.113.' || CAST(100 + k % 5 AS {STR})) AS attacker_ips,
  CAST(FLOOR(value) AS BIGINT) AS flow_count, CAST(k AS DOUBLE) / 100e0 AS suspicious_ratio
FROM ev WHERE event_type = 'error'""",
    "admin_actions": """
SELECT '203.0.113.' || CAST(user_id % 25 AS {STR}) AS ip,
  CASE k % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'unblock' END AS action,
  {TS}(1704067200000000 + t_us) AS action_ts
FROM ev WHERE event_type = 'signup' AND k % 5 = 0""",
    "http_log": """
SELECT event_id AS req_id, {TS}(1704067200000000 + t_us) AS req_ts, '203.0.113.' || CAST(user_id % 25 AS {STR}) AS ip, 'host' || CAST(user_id % 3 AS {STR}) AS host,
  CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  CASE k % 12 WHEN 0 THEN '/login' WHEN 1 THEN '/api/items/' || CAST(k AS {STR}) WHEN 2 THEN '/static/app.js' WHEN 3 THEN '/health' WHEN 4 THEN '/admin/users'
    WHEN 5 THEN '/../../etc/passwd' WHEN 6 THEN '/s?q=1+UNION+SELECT+2' WHEN 7 THEN '/p?x=<script>' WHEN 8 THEN '/.env' WHEN 9 THEN '/db.sql' WHEN 10 THEN '/x?c=eval(1)' ELSE '/index.html' END AS uri,
  CASE WHEN event_type IN ('click','view') THEN 200 WHEN event_type = 'purchase' THEN 201 WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 429 ELSE 403 END ELSE CASE k % 3 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 502 END END AS status,
  CAST(FLOOR(value * 100) AS BIGINT) AS bytes, CAST(k * 200000 AS BIGINT) AS req_len, value / 100 AS req_time,
  CASE k % 5 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'GoogleBot/2.1' WHEN 2 THEN '' WHEN 3 THEN 'my-Spider' ELSE 'curl/8' END AS ua,
  CASE k % 3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/xml' ELSE 'text/html' END AS content_type
FROM ev""",
    # samples without the running number; `metrics` below adds it
    "samples": """
SELECT event_id, value, {TS}(1704067200000000 + t_us) AS ts, 'host' || CAST(user_id % 2 AS {STR}) AS instance,
  CASE user_id % 3 WHEN 0 THEN 'ens33' WHEN 1 THEN 'eth1' ELSE 'lo' END AS device,
  CASE event_type WHEN 'click' THEN 'node_network_receive_bytes_total' WHEN 'view' THEN 'node_network_transmit_bytes_total' WHEN 'purchase' THEN 'http_requests_total' WHEN 'signup' THEN 'node_memory_MemAvailable_bytes' ELSE 'node_cpu_seconds_total' END AS name
FROM ev""",
    "metrics": """
SELECT name, instance, device, ts, CASE WHEN name = 'node_memory_MemAvailable_bytes' THEN value * 1000000 ELSE CAST((rn % 40) * 1000 AS DOUBLE) END AS value
FROM (SELECT event_id, name, instance, device, ts, value, ROW_NUMBER() OVER (PARTITION BY name, instance, device ORDER BY event_id) AS rn FROM samples) b
UNION ALL
SELECT 'node_memory_MemTotal_bytes', instance, device, ts, CAST(1000000000 AS DOUBLE) FROM samples WHERE name = 'node_memory_MemAvailable_bytes'""",
    # what exporters would have counted or measured, one row for each event; `exposed` below adds up the counters
    "exposed_steps": """
SELECT {US} AS us, 'http_requests_total' AS name, host AS instance, CAST(status AS {STR}) AS status, '' AS device, '' AS mountpoint, '' AS fstype,
  CASE WHEN ({US} {DIV} 60000000) % 5 < 2 THEN 600e0 ELSE 1e0 END AS step, 1 AS counts FROM (SELECT *, req_ts AS ts FROM http_log) h
UNION ALL SELECT {US}, 'bruteforce_alerts_total', host, '', '', '', '', 1e0, 1 FROM (SELECT *, req_ts AS ts FROM http_log) h WHERE uri = '/login' AND status IN (403, 429)
UNION ALL SELECT {US}, 'suspicious_inputs_total', host, '', '', '', '', CASE WHEN ({US} {DIV} 60000000) % 7 < 3 THEN 40e0 ELSE 1e0 END, 1
  FROM (SELECT *, req_ts AS ts FROM http_log) h WHERE uri LIKE '/s?q=%' OR uri LIKE '/p?x=%' OR uri LIKE '/x?c=%'
UNION ALL SELECT {US}, 'webapp_process_cpu_user_seconds_total', host, '', '', '', '', CASE WHEN ({US} {DIV} 60000000) % 10 < 4 THEN 0.9e0 ELSE 0.1e0 END, 0
  FROM (SELECT *, req_ts AS ts FROM http_log) h WHERE req_id % 4 = 0
UNION ALL SELECT {US}, 'webapp_process_resident_memory_bytes', host, '', '', '', '', CASE WHEN ({US} {DIV} 60000000) % 15 < 6 THEN 2147483648e0 ELSE 536870912e0 END, 0
  FROM (SELECT *, req_ts AS ts FROM http_log) h WHERE req_id % 4 = 1
UNION ALL SELECT {US}, CASE event_id % 4 WHEN 0 THEN 'node_network_receive_errs_total' WHEN 1 THEN 'node_network_transmit_errs_total' WHEN 2 THEN 'node_network_receive_drop_total' ELSE 'node_network_transmit_drop_total' END,
  instance, '', device, '', '', 1e0 + CAST(event_id % 5 AS DOUBLE), 1 FROM samples WHERE event_id % 3 = 0
UNION ALL SELECT {US}, 'node_filesystem_size_bytes', instance, '', device, CASE event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/data' WHEN 2 THEN '/tmp' ELSE '/var/lib/images' END,
  CASE event_id % 4 WHEN 0 THEN 'ext4' WHEN 1 THEN 'xfs' WHEN 2 THEN 'tmpfs' ELSE 'overlay' END, 50000000000e0, 0 FROM samples
UNION ALL SELECT {US}, 'node_filesystem_free_bytes', instance, '', device, CASE event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/data' WHEN 2 THEN '/tmp' ELSE '/var/lib/images' END,
  CASE event_id % 4 WHEN 0 THEN 'ext4' WHEN 1 THEN 'xfs' WHEN 2 THEN 'tmpfs' ELSE 'overlay' END, CAST(FLOOR(value * 1000000) AS DOUBLE), 0 FROM samples WHERE event_id % 8 < 4""",
    # counters begin at 0 again every 20 minutes
    "exposed": """
SELECT DISTINCT name, instance, status, device, mountpoint, fstype, us, CASE WHEN counts = 1 THEN
  sum(step) OVER (PARTITION BY name, instance, status, device, mountpoint, fstype, us {DIV} 1200000000 ORDER BY us) ELSE
  max(step) OVER (PARTITION BY name, instance, status, device, mountpoint, fstype, us) END AS value FROM exposed_steps""",
    "packets": """
SELECT l_orderkey * 8 + l_linenumber AS pkt_id, {TS}(1704067200000000 + l_orderkey * 200000 + l_linenumber * 1000) AS pkt_ts,
  '203.0.113.' || CAST(l_suppkey % 25 AS {STR}) AS src_ip, '198.51.100.200' AS dst_ip, CAST(1024 + l_suppkey AS INT) AS src_port, CAST(l_partkey % 10 AS INT) AS dst_port,
  CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS protocol, CAST(l_quantity * 30 AS INT) AS length, CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS syn
FROM lineitem""",
    # packets of both directions in bursts of ten orders, three seconds apart
    "wire": """
SELECT pkt_id, {TS}(1704067200000000 + g * 3000000 + o * 80000 + CASE WHEN o >= 7 THEN 1500000 ELSE 0 END + line * 700) AS pkt_ts, CASE WHEN ask THEN peer ELSE '198.51.100.200' END AS src_ip,
  CASE WHEN ask THEN '198.51.100.200' ELSE peer END AS dst_ip, CASE WHEN ask THEN port ELSE 80 END AS src_port, CASE WHEN ask THEN 80 ELSE port END AS dst_port, protocol,
  CASE WHEN part % 5 = 0 THEN 0 WHEN g % 4 = 0 THEN 40 + qty ELSE qty * 30 END AS length, 20 + 4 * (line % 4) AS header, 1024 + 100 * (part % 64) AS win, CASE WHEN g % 4 = 0 OR part % 3 = 0 THEN 1 ELSE 0 END AS syn,
  CASE WHEN part % 17 = 0 THEN 1 ELSE 0 END AS fin, CASE WHEN part % 23 = 0 THEN 1 ELSE 0 END AS rst, part % 2 AS psh, CASE WHEN line > 1 THEN 1 ELSE 0 END AS ack, CASE WHEN part % 19 = 0 THEN 1 ELSE 0 END AS urg,
  CASE WHEN part % 29 = 0 THEN 1 ELSE 0 END AS cwr, CASE WHEN part % 31 = 0 THEN 1 ELSE 0 END AS ece, CASE WHEN g % 4 = 0 THEN 1 ELSE 0 END AS attack
FROM (SELECT (l_orderkey * 8 + l_linenumber) * 16777216 + l_partkey * 64 + CAST(l_quantity AS BIGINT) AS pkt_id, l_orderkey {DIV} 10 AS g, l_orderkey % 10 AS o, CAST(l_linenumber AS BIGINT) AS line,
  l_orderkey % 8 < 5 AS ask, '203.0.113.' || CAST((l_orderkey {DIV} 10) * (l_orderkey {DIV} 10) % 37 AS {STR}) AS peer, CAST(1024 + (l_orderkey {DIV} 10) * (l_orderkey {DIV} 10) % 37 AS INT) AS port,
  CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 17 ELSE 1 END AS protocol, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty FROM lineitem) w""",
    "posts": """
SELECT doc_id AS id, substr(text, 1, 40) AS title, text AS content, source AS author, {TS}(1704067200000000 + doc_id * 60000000) AS created_at FROM documents""",
    "comments": """
SELECT conv_id AS post_id, CAST(turn AS BIGINT) AS comment_no, role AS author, text AS content, {TS}(1704067200000000 + conv_id * 60000000 + turn * 1000000) AS created_at FROM conversations""",
}


def _fill(sql: str, tokens: dict[str, str]) -> str:
    for name, text in tokens.items():
        sql = sql.replace("{" + name + "}", text)
    return sql


def _needs(sql: str, known) -> list[str]:
    """Names out of ``known`` that ``sql`` selects from."""
    return [n for n in known if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql, re.IGNORECASE)]


def _chain(sql: str, views: dict[str, str]) -> list[str]:
    """Views ``sql`` rests on, innermost first."""
    order: list[str] = []
    for name in _needs(sql, views):
        for inner in [*_chain(views[name], {k: v for k, v in views.items() if k != name}), name]:
            if inner not in order:
                order.append(inner)
    return order


def oracle_query(sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Oracle SQL with every fixture view it selects from inlined as a WITH chain."""
    views = {**VIEWS, **(extra or {})}
    names = _chain(sql, views)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({_fill(views[n], DUCK)})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Inputs:
    """The base tables of one data folder and the fixture views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name == "metrics":
            return self._metrics()
        if name == "exposed":
            return self._exposed()
        names = [*_chain(VIEWS[name], VIEWS), name]
        ctes = ", ".join(f"{n} AS ({_fill(VIEWS[n], SPARK)})" for n in names)
        sql = f"WITH {ctes} SELECT * FROM {name}"
        for table in _needs(sql, TABLES):
            sql = re.sub(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 parquet.`{self.dir}/{table}.parquet`", sql)
        return self.spark.sql(sql)

    def stream(self, name: str) -> DataFrame:
        """The view over ``events`` as a stream of the table's files."""
        source = (self.spark.readStream.schema(self.table("events").schema)
                  .option("pathGlobFilter", "events.parquet").parquet(self.dir))
        source.createOrReplaceTempView("_events_stream")
        names = [*_chain(VIEWS[name], VIEWS), name]
        ctes = ", ".join(f"{n} AS ({_fill(VIEWS[n], SPARK)})" for n in names)
        return self.spark.sql(re.sub(r"\b(FROM|JOIN)\s+events\b", r"\1 _events_stream", f"WITH {ctes} SELECT * FROM {name}"))

    def _metrics(self) -> DataFrame:
        """Counters count up per series; the running number comes from block prefix sums."""
        from rillwatch.operators.blocks import running_totals

        s = self.view("samples")
        numbered = running_totals(
            s.withColumn("one", F.lit(1)), ["name", "instance", "device"], "event_id", {"rn": "one"}, width=1 << 16
        )
        free = "node_memory_MemAvailable_bytes"
        counted = numbered.select(
            "name", "instance", "device", "ts",
            F.when(F.col("name") == free, F.col("value") * 1000000)
            .otherwise(((F.col("rn") % 40) * 1000).cast("double")).alias("value"),
        )
        total = s.filter(F.col("name") == free).select(
            F.lit("node_memory_MemTotal_bytes").alias("name"), "instance", "device", "ts", F.lit(1e9).alias("value")
        )
        return counted.unionByName(total)

    def exposed(self, names: list[str]) -> DataFrame:
        """Rows of the view ``exposed`` with one of ``names``; the base table is read for these alone, and once."""
        return self._exposed(names)

    def _exposed(self, names: list[str] | None = None) -> DataFrame:
        """Samples of labelled counters and gauges; running sums come from blocks, as above."""
        from rillwatch.operators.blocks import running_totals

        series = ["name", "instance", "status", "device", "mountpoint", "fstype"]
        steps = self.view("exposed_steps")
        at = (steps.filter(F.col("name").isin(*names)) if names else steps).groupBy(*series, "us", "counts").agg(F.sum("step").alias("step"), F.max("step").alias("top"))
        if names:
            at = cut_lineage(at)  # read for the blocks' sums, for the rows and for the gauges
        since = F.expr("us div 1200000000").alias("since")
        counted = running_totals(at.filter("counts = 1").select("*", since), [*series, "since"], "us", {"value": "step"}, width=60_000_000)
        gauges = at.filter("counts = 0").withColumn("value", F.col("top"))
        return counted.select(*series, "us", "value").unionByName(gauges.select(*series, "us", "value"))
