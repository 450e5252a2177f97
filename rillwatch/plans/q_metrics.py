"""Queries over metric series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.operators import rangevectors as rv
from rillwatch.operators import timeseries as ts
from rillwatch.operators.windows import SECOND, micros, window_number
from rillwatch.plans.q_alerts import scored
from rillwatch.plans.q_flows import rounded, unmatched
from rillwatch.plans.registry import CHECK_VIEWS, query
from rillwatch.session import cut_lineage

CHECK_VIEWS.update({
    "stepped": """
SELECT *, lag(value) OVER w AS pv, lag(us) OVER w AS pu FROM (SELECT name, instance, device, epoch_us(ts) AS us, epoch_us(ts) // 300000000 AS win, value FROM metrics) m
WINDOW w AS (PARTITION BY name, instance, device, win ORDER BY us, value)""",
    "rates": """
SELECT name, instance, device, win, sum(d) AS increase, sum(d) / NULLIF((max(us) - min(us)) / 1e6, 0) AS rate, arg_max(lr, (us, value)) AS irate,
 count(CASE WHEN value <> pv THEN 1 END) AS changes, count(*) AS samples
FROM (SELECT *, d / NULLIF((us - pu) / 1e6, 0) AS lr FROM (SELECT *, CASE WHEN value < pv THEN value ELSE value - pv END AS d FROM stepped) a) b GROUP BY 1, 2, 3, 4""",
})
RX, TX = "node_network_receive_bytes_total", "node_network_transmit_bytes_total"
FREE, TOTAL = "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes"


def rates(t, *names, seconds=300):
    m = t.view("metrics")
    return ts.counter_rates(ts.named(m, *names) if names else m, seconds)


@query("counter_rate", "SELECT name, instance, device, win, round(increase, 6) AS increase, round(rate, 6) AS rate, round(irate, 6) AS irate, samples FROM rates WHERE name LIKE '%\\_total' ESCAPE '\\'")
def _(t):
    counters = ts.keep_matching(t.view("metrics"), "name", ".*_total")
    return rounded(ts.counter_rates(counters, 300).drop("changes"))


@query("series_changes", "SELECT name, instance, device, win, changes FROM rates WHERE changes > 0")
def _(t):
    return rates(t).select(*ts.SERIES, "win", "changes").filter("changes > 0")


@query("ts_label_filter", "SELECT name, instance, device, count(*) AS n FROM metrics WHERE device <> 'lo' AND regexp_matches(name, '^(node_.*)$') GROUP BY 1, 2, 3")
def _(t):
    m = ts.keep_matching(ts.drop_matching(t.view("metrics"), "device", "lo"), "name", "node_.*")
    return m.groupBy(*ts.SERIES).agg(F.count("*").alias("n"))


_NGINX_NAME = "CASE status // 100 WHEN 2 THEN 'nginx_server_requests' WHEN 4 THEN 'nginx_server_cache' ELSE 'nginx_server_requests_other' END"


@query("ts_keep_relabel", f"""
SELECT name, count(*) AS n FROM (SELECT {_NGINX_NAME} AS name FROM http_log) x WHERE name IN ('nginx_server_requests', 'nginx_server_bytes', 'nginx_server_cache', 'nginx_server_connections') GROUP BY 1""")
def _(t):
    kind = F.floor(F.col("status") / 100)
    named = t.view("http_log").select(F.when(kind == 2, "nginx_server_requests").when(kind == 4, "nginx_server_cache").otherwise("nginx_server_requests_other").alias("name"))
    return ts.keep_matching(named, "name", config.KEPT_METRICS).groupBy("name").agg(F.count("*").alias("n"))


@query("ts_cpu_usage", "SELECT instance, win, round(100 - avg(irate) * 100, 6) AS cpu_usage FROM rates WHERE name = 'node_cpu_seconds_total' GROUP BY 1, 2")
def _(t):
    return rounded(rates(t, "node_cpu_seconds_total").groupBy("instance", "win").agg((100 - F.avg("irate") * 100).alias("cpu_usage")))


_PAIR = "FROM (SELECT * FROM metrics WHERE name = 'node_memory_MemTotal_bytes') a JOIN (SELECT * FROM metrics WHERE name = 'node_memory_MemAvailable_bytes') b USING (instance, device, ts)"


def memory(t, value):
    m = t.view("metrics")
    return ts.match(ts.named(m, TOTAL), ts.named(m, FREE), value, ["instance", "device", "ts"]).withColumn("us", micros("ts")).drop("ts")


@query("ts_mem_usage", f"SELECT instance, device, epoch_us(ts) AS us, a.value - b.value AS used_bytes, round((1 - b.value / a.value) * 100, 6) AS used_pct {_PAIR}")
def _(t):
    m = memory(t, F.struct((F.col("l") - F.col("r")).alias("used_bytes"), ((1 - F.col("r") / F.col("l")) * 100).alias("used_pct")))
    return rounded(m.select("instance", "device", "us", "value.*"))


@query("metric_vector_match", f"SELECT instance, device, epoch_us(ts) AS us, round(a.value / NULLIF(b.value, 0), 6) AS value {_PAIR}")
def _(t):
    return rounded(memory(t, F.try_divide("l", "r")))


# labelled series: one text names a series in the check SQL too
LABELS = ["instance", "status", "device", "mountpoint", "fstype"]
CHECK_VIEWS.update({
    "series": """
SELECT *, concat_ws('|', name, instance, status, device, mountpoint, fstype) AS series,
 CASE WHEN value < lag(value) OVER w THEN value ELSE value - COALESCE(lag(value) OVER w, value) END AS d
FROM exposed WINDOW w AS (PARTITION BY name, instance, status, device, mountpoint, fstype ORDER BY us)""",
    # every 15 s from a series' first sample to five minutes after its last
    "steps": """
SELECT *, unnest(range(((a + 14999999) // 15000000) * 15000000, b + 300000001, 15000000)) AS us
FROM (SELECT name, instance, status, device, mountpoint, fstype, series, min(us) AS a, max(us) AS b FROM series GROUP BY ALL) x""",
    "marks": """
SELECT series, us, value, d, FALSE AS asked FROM series UNION ALL SELECT series, us, NULL, NULL, TRUE FROM steps""",
    **{f"look{m}": f"""
SELECT series, us, asked, count(value) OVER w AS n, min(us) FILTER (value IS NOT NULL) OVER w AS t0, max(us) FILTER (value IS NOT NULL) OVER w AS t1,
 arg_min(value, us) FILTER (value IS NOT NULL) OVER w AS v0, arg_max(value, us) FILTER (value IS NOT NULL) OVER w AS v1,
 sum(d) OVER w - arg_min(d, us) FILTER (value IS NOT NULL) OVER w AS grown
FROM marks WINDOW w AS (PARTITION BY series ORDER BY us RANGE BETWEEN {m * 60000000} PRECEDING AND CURRENT ROW)""" for m in (1, 5)},
    **{f"range{m}": f"""
SELECT series, us AS tick, CASE WHEN n >= 2 THEN grown * (span + CASE WHEN grown > 0 AND v0 >= 0 THEN least(lead, span * v0 / grown) ELSE lead END
  + CASE WHEN (us - t1) / 1e6 >= gap * 1.1 THEN gap / 2 ELSE (us - t1) / 1e6 END) / span END AS increase
FROM (SELECT *, CASE WHEN (t0 - us) / 1e6 + {m * 60} >= gap * 1.1 THEN gap / 2 ELSE (t0 - us) / 1e6 + {m * 60} END AS lead
 FROM (SELECT *, (t1 - t0) / 1e6 AS span, (t1 - t0) / 1e6 / NULLIF(n - 1, 0) AS gap FROM look{m} WHERE asked) x) y""" for m in (1, 5)},
    "now": "SELECT series, us AS tick, v1 AS value FROM look5 WHERE asked",
    "named": "SELECT DISTINCT series, name, instance, status, device, mountpoint, fstype FROM series",
})


def exposed(t, *names):
    """Samples of ``names`` with a label map, written once: several selections read them."""
    return cut_lineage(rv.labelled(t.exposed(sorted(set(names))), LABELS))


@query("ts_disk_usage", """
SELECT z.instance, z.device, z.mountpoint, z.fstype, s.tick AS us, s.value - f.value AS value
FROM (now JOIN named USING (series)) z JOIN now s ON s.series = z.series AND s.tick = z.tick
JOIN (now JOIN named USING (series)) f ON f.name = 'node_filesystem_free_bytes' AND f.tick = z.tick AND (f.instance, f.device, f.mountpoint, f.fstype) = (z.instance, z.device, z.mountpoint, z.fstype)
WHERE z.name = 'node_filesystem_size_bytes' AND NOT regexp_full_match(z.fstype, 'tmpfs|overlay') AND s.value - f.value IS NOT NULL""")
def _(t):
    samples, real = exposed(t, "node_filesystem_size_bytes", "node_filesystem_free_bytes"), ("fstype", "!~", "tmpfs|overlay")
    size, free = (rv.instant_values(rv.select(samples, f"node_filesystem_{x}_bytes", real).withColumn("_k", F.to_json("labels")), ["series"]).join(
        samples.filter(F.col("name") == f"node_filesystem_{x}_bytes").groupBy("series").agg(F.any_value("labels").alias("labels")), "series")
        for x in ("size", "free"))
    used = rv.combine(size, free, F.col("l") - F.col("r"))
    return used.select(*[F.col("labels")[c].alias(c) for c in ("instance", "device", "mountpoint", "fstype")], F.col("at").alias("us"), "value")


@query("ts_net_rate", f"SELECT name, instance, device, win, round(rate * 8 / 1000000, 9) AS mbit_per_s FROM rates WHERE name IN ('{RX}', '{TX}') AND device <> 'lo'")
def _(t):
    m = ts.drop_matching(rates(t, RX, TX), "device", "lo")
    return m.select(*ts.SERIES, "win", F.round(F.col("rate") * 8 / 1000000, 9).alias("mbit_per_s"))


ERRORS = [f"node_network_{way}_{what}_total" for what in ("errs", "drop") for way in ("receive", "transmit")]


@query("ts_pkt_err_drop", f"""
SELECT name, instance, device, tick AS us, round(increase / 60, 6) AS rate FROM range1 JOIN named USING (series)
WHERE name IN ({", ".join(f"'{n}'" for n in ERRORS)}) AND device = 'ens33' AND increase IS NOT NULL""")
def _(t):
    chosen = t.view("exposed").filter(F.col("name").isin(*ERRORS) & (F.col("device") == "ens33"))
    per_second = rv.range_values(chosen, ["name", "instance", "device"], 60).filter("rate IS NOT NULL")
    return per_second.select("name", "instance", "device", F.col("at").alias("us"), F.round("rate", 6).alias("rate"))


@query("ts_sum_by", "SELECT instance, win, round(sum(increase), 6) AS increase, round(sum(rate), 6) AS rate FROM rates WHERE name = 'http_requests_total' GROUP BY 1, 2")
def _(t):
    return rounded(rates(t, "http_requests_total").groupBy("instance", "win").agg(F.sum("increase").alias("increase"), F.sum("rate").alias("rate")))


# Histogram bounds of the request time, seconds
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
_HIST = "SELECT host, le, count(CASE WHEN req_time <= le THEN 1 END) AS cum FROM http_log, (SELECT unnest([" + ", ".join(map(str, BOUNDS)) + ", 'Infinity'::DOUBLE]) AS le) b GROUP BY 1, 2"


def _quantile_sql(q):
    return f"""
SELECT host, {q}::DOUBLE AS q, round(arg_min(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * ({q} * n - below) / NULLIF(cum - below, 0) END, le), 6) AS value
FROM (SELECT *, COALESCE(lag(le) OVER w, 0) AS lower, COALESCE(lag(cum) OVER w, 0) AS below, max(cum) OVER (PARTITION BY host) AS n FROM ({_HIST}) h WINDOW w AS (PARTITION BY host ORDER BY le)) x
WHERE cum >= {q} * n GROUP BY 1"""


@query("ts_hist_quantile", " UNION ALL ".join(f"SELECT * FROM ({_quantile_sql(q)}) z" for q in (0.5, 0.95, 0.99)))
def _(t):
    buckets = ts.histogram(t.view("http_log"), ["host"], "req_time", BOUNDS)
    parts = [ts.histogram_quantile(buckets, ["host"], q).withColumn("q", F.lit(q)) for q in (0.5, 0.95, 0.99)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("ts_avg_latency", "SELECT host, epoch_us(req_ts) // 60000000 AS win, round(sum(req_time) / count(*) * 1000, 6) AS latency_ms FROM http_log GROUP BY 1, 2")
def _(t):
    grouped = t.view("http_log").groupBy("host", window_number("req_ts", 60).alias("win"))
    return rounded(grouped.agg((F.sum("req_time") / F.count("*") * 1000).alias("latency_ms")))


@query("ts_or_zero", """
SELECT s.win, COALESCE(n, 0) AS suspicious FROM (SELECT unnest(generate_series(lo, hi)) AS win FROM (SELECT min(epoch_us(flow_ts) // 10000000) AS lo, max(epoch_us(flow_ts) // 10000000) AS hi FROM labeled) r) s
LEFT JOIN (SELECT epoch_us(flow_ts) // 10000000 AS win, count(*) AS n FROM labeled WHERE score >= 0.98 GROUP BY 1) x USING (win)""")
def _(t):
    flows = t.view("labeled").withColumn("win", window_number("flow_ts", 10))
    hits = flows.filter("score >= 0.98").groupBy("win").agg(F.count("*").alias("suspicious"))
    return ts.or_zero(hits, ts.spine(flows, "win"), "win", "suspicious")


# alerts on series ------------------------------------------------------------------------------------------

# fixed values: alert, series, matchers, function, seconds of its range, divisor, threshold, seconds that it must hold
ALERTS = [
    ("DDoSAttackDetected", "http_requests_total", (), "rate", 60, 1, 100, 30),
    ("HighErrorRate", "http_requests_total", (("status", "=~", "5.."),), "rate", 300, 1, 10, 60),
    ("BruteForceAttack", "bruteforce_alerts_total", (), "increase", 300, 1, 0, 0),
    ("SuspiciousInputSurge", "suspicious_inputs_total", (), "rate", 60, 1, 5, 30),
    ("HighCPUUsage", "webapp_process_cpu_user_seconds_total", (), "value", None, 1, 0.8, 120),
    ("HighMemoryUsage", "webapp_process_resident_memory_bytes", (), "value", None, 1024 ** 3, 1, 120),
]


def _points_sql(alert, name, matchers, how, seconds, divisor, least, hold):
    where = " AND ".join([f"name = '{name}'", *[f"regexp_full_match({c}, '{p}')" for c, _, p in matchers]])
    value = {"rate": f"increase / {seconds}", "increase": "increase", "value": f"value / {divisor}"}[how]
    return (f"SELECT '{alert}' AS alert, instance, status, tick, {value} > {least} AS ok, {hold * 1000000} AS hold "
            f"FROM {f'range{seconds // 60}' if seconds else 'now'} JOIN named USING (series) WHERE {where}")


def holding_sql(points, keys):
    k = ", ".join(keys)
    return f"""
SELECT {k}, min(us) AS since, max(us) AS until, count(*) AS points FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY {k} ORDER BY us) AS run FROM ({points}) p) x
WHERE ok GROUP BY {k}, run, hold HAVING max(us) - min(us) >= hold"""


@query("ts_alert_rules", f"""
WITH points AS ({" UNION ALL ".join(_points_sql(*a) for a in ALERTS)}),
 runs AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY alert, instance, status ORDER BY tick) AS run FROM points),
 held AS (SELECT *, min(tick) OVER (PARTITION BY alert, instance, status, run) AS since FROM runs WHERE ok)
SELECT alert, instance, status, since, min(tick) AS fired, max(tick) AS until, count(*) AS steps FROM held WHERE tick - since >= hold GROUP BY 1, 2, 3, since""")
def _(t):
    samples, keys = exposed(t, *(a[1] for a in ALERTS)), ["alert", "series", "instance", "status"]
    label = lambda c: F.coalesce(F.col("labels")[c], F.lit("")).alias(c)

    def chosen(a):
        return rv.select(samples, a[1], *a[2]).select(F.lit(a[0]).alias("alert"), "series", label("instance"), label("status"), "us", "value",
                                                      F.lit(float(a[4] or 0)).alias("seconds"))

    def union(parts):
        return reduce(lambda x, y: x.unionByName(y), parts)

    # one evaluation for all range expressions, each with its own range
    ranges = rv.range_values(union(chosen(a) for a in ALERTS if a[4]), keys, F.col("seconds"))
    gauges = rv.instant_values(union(chosen(a) for a in ALERTS if not a[4]), keys)
    value, least, hold = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for alert, _, _, how, _, divisor, over, seconds in ALERTS:
        mine = F.col("alert") == alert
        value = F.when(mine, F.col(how) / divisor).otherwise(value)
        least, hold = F.when(mine, float(over)).otherwise(least), F.when(mine, float(seconds)).otherwise(hold)
    points = ranges.withColumn("value", F.lit(None).cast("double")).unionByName(gauges, allowMissingColumns=True)
    return rv.firing(points.select(*keys, "at", (value > least).alias("ok"), hold.alias("hold")), keys).drop("series")


@query("alert_for_duration", holding_sql("SELECT name, instance, device, epoch_us(ts) AS us, value > 5000 AS ok, 30000000 AS hold FROM metrics", ["name", "instance", "device"]))
def _(t):
    points = t.view("metrics").withColumn("us", micros("ts"))
    return ts.holding(points, ts.SERIES, F.col("value") > 5000, 30)


@query("ts_annotations", f"""
SELECT 'traffic' AS kind, name, instance, device, win * 300000000 AS us, round(rate, 6) AS value FROM rates WHERE name = '{RX}' AND rate > 100
UNION ALL SELECT 'change', name, instance, device, us, value FROM (SELECT *, lag(value) OVER (PARTITION BY name, instance, device ORDER BY us, value) AS before
 FROM (SELECT name, instance, device, epoch_us(ts) AS us, value FROM metrics WHERE name = 'http_requests_total') m) x WHERE value <> before""")
def _(t):
    traffic = rates(t, RX).filter("rate > 100").select(F.lit("traffic").alias("kind"), *ts.SERIES, (F.col("win") * 300 * SECOND).alias("us"), F.col("rate").alias("value"))
    moved = ts.changes(ts.named(t.view("metrics"), "http_requests_total"))
    return rounded(traffic.unionByName(moved.select(F.lit("change").alias("kind"), *ts.SERIES, "us", "value")))


@query("ts_from_alerts", """
SELECT severity, rule_id, alert_id, epoch_us(alert_ts) AS us, CAST(count(*) OVER (PARTITION BY severity, rule_id ORDER BY alert_ts) AS BIGINT) AS value FROM alerts""")
def _(t):
    return ts.running_counter(t.view("alerts"), ["severity", "rule_id"], "alert_ts").select("severity", "rule_id", "alert_id", "us", "value")


@query("ts_window_gauges", """
SELECT 'rule_detector_window_flows' AS name, CAST(total_flows AS DOUBLE) AS value, win FROM stats60
UNION ALL SELECT 'ddos_active_attackers', CAST(unique_attackers AS DOUBLE), win FROM ml30""")
def _(t):
    from rillwatch.operators import windows

    flows = windows.window_stats(unmatched(t), 60).select(F.lit("rule_detector_window_flows").alias("name"), F.col("total_flows").cast("double").alias("value"), "win")
    attackers = windows.scored_window_stats(scored(t), 30)
    return flows.unionByName(attackers.select(F.lit("ddos_active_attackers").alias("name"), F.col("unique_attackers").cast("double").alias("value"), "win"))


@query("ts_flatten_labels", """
SELECT name, epoch_us(ts) AS us, value, 'instance' AS label, instance AS label_value FROM metrics UNION ALL SELECT name, epoch_us(ts), value, 'device', device FROM metrics""")
def _(t):
    nested = t.view("metrics").select(F.to_json(F.struct(
        "name", F.create_map(F.lit("instance"), "instance", F.lit("device"), "device").alias("labels"), micros("ts").alias("us"), "value")).alias("line"))
    parsed = nested.select(F.from_json("line", "name string, labels map<string,string>, us long, value double").alias("m"))
    return parsed.select("m.name", "m.us", "m.value", F.explode("m.labels").alias("label", "label_value"))
