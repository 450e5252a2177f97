"""Queries over the access log, posts and comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwatch.functions import weblog
from rillwatch.operators.blocks import running_totals
from rillwatch.operators.windows import SECOND, micros, window_number
from rillwatch.plans.q_flows import joined, rounded
from rillwatch.plans.registry import query


@query("log_is_blocked", "SELECT req_id, ip, status FROM http_log WHERE status IN (403, 429)")
def _(t):
    return t.view("http_log").filter(weblog.is_blocked(F.col("status"))).select("req_id", "ip", "status")


@query("log_bot_detect", "SELECT req_id, ua, regexp_matches(lower(ua), 'bot|crawler|spider|scraper') OR ua = '' AS is_bot FROM http_log")
def _(t):
    return t.view("http_log").select("req_id", "ua", weblog.is_bot(F.col("ua")).alias("is_bot"))


@query("log_suspicious_uri", r"""
SELECT req_id, uri, concat_ws('|', CASE WHEN contains(uri, '../..') THEN 'path_traversal' END, CASE WHEN contains(lower(uri), 'eval(') THEN 'code_injection' END,
 CASE WHEN lower(uri) LIKE '%union%select%' THEN 'sql_injection' END, CASE WHEN contains(lower(uri), '<script') THEN 'script_tag' END,
 CASE WHEN contains(lower(uri), 'javascript:') THEN 'script_url' END) AS classes FROM http_log""")
def _(t):
    return joined(t.view("http_log").select("req_id", "uri", weblog.suspicious_classes(F.col("uri")).alias("classes")), "classes")


@query("log_sensitive_path", r"""
SELECT req_id, concat_ws('|', CASE WHEN regexp_matches(lower(p), '^/(admin|phpmyadmin|wp-admin)') THEN 'admin_path' END,
 CASE WHEN regexp_matches(lower(p), '\.(sql|env|config|ini|bak|old|tmp)$') THEN 'file_type' END,
 CASE WHEN contains(p, '/.') THEN 'hidden_file' END, CASE WHEN p LIKE '%~' THEN 'backup_file' END) AS classes
FROM (SELECT req_id, split_part(uri, '?', 1) AS p FROM http_log) x""")
def _(t):
    return joined(t.view("http_log").select("req_id", weblog.sensitive_classes(F.col("uri")).alias("classes")), "classes")


_ROUTE = r"""CASE WHEN regexp_matches(lower(split_part(uri, '?', 1)), '\.(jpg|jpeg|png|gif|ico|css|js|svg|woff|woff2|ttf|eot)$') THEN 'static'
 WHEN regexp_matches(uri, '^/(login|signin|auth|authenticate)') THEN 'login' WHEN uri LIKE '/api/%' THEN 'api' WHEN uri LIKE '/health%' THEN 'health' ELSE 'other' END"""


@query("log_route_class", f"SELECT req_id, uri, {_ROUTE} AS route FROM http_log")
def _(t):
    return t.view("http_log").select("req_id", "uri", weblog.route_class(F.col("uri")).alias("route"))


@query("log_xml_json_body", "SELECT req_id, CASE WHEN content_type = 'text/xml' THEN 'XML' WHEN content_type = 'application/json' THEN 'JSON' ELSE 'OTHER' END AS kind FROM http_log")
def _(t):
    return t.view("http_log").select("req_id", weblog.body_kind(F.col("content_type")).alias("kind"))


@query("log_audit_relevant", "SELECT req_id, status FROM http_log WHERE status BETWEEN 500 AND 599 OR (status BETWEEN 400 AND 499 AND status <> 404)")
def _(t):
    return t.view("http_log").filter(weblog.audit_relevant(F.col("status"))).select("req_id", "status")


@query("req_limits_check", """
SELECT req_id, concat_ws('|', CASE WHEN req_len > 10485760 THEN 'body_size' END, CASE WHEN req_len > 13107200 THEN 'request_size' END) AS breaches FROM http_log""")
def _(t):
    args = F.when(F.col("uri").contains("?"), F.substring_index("uri", "?", -1))
    return joined(t.view("http_log").select("req_id", weblog.limit_breaches(F.col("req_len"), args).alias("breaches")), "breaches")


@query("log_line_filter", """
SELECT job, line FROM (SELECT event_type AS job, CASE WHEN event_type = 'error' THEN 'ALERT [' || CAST(event_id AS VARCHAR) || ']' ELSE 'flow ' || CAST(event_id AS VARCHAR) END AS line FROM ev) x
WHERE job = 'error' AND contains(line, 'ALERT')""")
def _(t):
    number = F.col("event_id").cast("string")
    lines = t.view("ev").select(
        F.col("event_type").alias("job"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("ALERT ["), number, F.lit("]"))).otherwise(F.concat(F.lit("flow "), number)).alias("line"))
    return lines.filter((F.col("job") == "error") & F.col("line").contains("ALERT"))


@query("http_status_rates", """
SELECT epoch_us(req_ts) // 60000000 AS win, host, status, CAST(status // 100 AS VARCHAR) || 'xx' AS status_class, count(*) AS requests, round(count(*) / 60.0, 6) AS per_second
FROM http_log GROUP BY 1, 2, 3, 4""")
def _(t):
    return rounded(t.view("http_log").groupBy(
        window_number("req_ts", 60).alias("win"), "host", "status",
        F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")).alias("status_class"),
    ).agg(F.count("*").alias("requests")).withColumn("per_second", F.col("requests") / F.lit(60.0)))


@query("topk_status_codes", """
SELECT status, round(sum(n) / 60.0, 6) AS per_minute FROM (SELECT status, count(*) AS n FROM http_log GROUP BY 1) x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return rounded(t.view("http_log").groupBy("status").agg((F.count("*") / F.lit(60.0)).alias("per_minute"))
                   .orderBy(F.desc("per_minute"), "status").limit(10))


@query("rate_over_second", """
SELECT ip, zone, sec, n FROM (SELECT ip, CASE WHEN r IN ('login', 'api') THEN r ELSE 'global' END AS zone, epoch_us(req_ts) // 1000000 AS sec, count(*) AS n
 FROM (SELECT *, """ + _ROUTE + """ AS r FROM http_log) x WHERE r <> 'health' GROUP BY 1, 2, 3) y WHERE n > 1""")
def _(t):
    zone = weblog.rate_zone(F.col("uri")).alias("zone")
    counted = t.view("http_log").groupBy("ip", zone, window_number("req_ts", 1).alias("sec")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("zone").isNotNull() & (F.col("n") > 1))


def open_requests(log, ts="req_ts", seconds="req_time"):
    """Requests open per address at each request start: +1 at start, -1 at end, running total in time blocks."""
    start = micros(ts)
    end = start + F.greatest(F.round(F.col(seconds) * SECOND).cast("long"), F.lit(0))
    # doubled clock: an end frees its place before a start at the same instant takes one
    edges = log.select("ip", "req_id", F.inline(F.array(
        F.struct((start * 2 + 1).alias("pos"), F.lit(1).alias("step")),
        F.struct((end * 2).alias("pos"), F.lit(-1).alias("step")))))
    run = running_totals(edges, ["ip"], "pos", {"open_now": "step"}, 2 * 60 * SECOND)
    return run.filter(F.col("step") == 1).select("ip", "req_id", "open_now")


_OPEN = """
SELECT ip, req_id, open_now FROM (SELECT ip, req_id, step, CAST(sum(step) OVER (PARTITION BY ip ORDER BY pos RANGE UNBOUNDED PRECEDING) AS BIGINT) AS open_now FROM (
 SELECT ip, req_id, epoch_us(req_ts) * 2 + 1 AS pos, 1 AS step FROM http_log
 UNION ALL SELECT ip, req_id, (epoch_us(req_ts) + CAST(round(req_time * 1000000) AS BIGINT)) * 2, -1 FROM http_log) e) x WHERE step = 1"""


@query("conn_limit_replay", _OPEN + " AND open_now > 20")
def _(t):
    from rillwatch import config

    return open_requests(t.view("http_log")).filter(F.col("open_now") > config.MAX_CONNECTIONS)


@query("conn_limit_tight", _OPEN + " AND open_now > 2")
def _(t):
    return open_requests(t.view("http_log")).filter(F.col("open_now") > 2)


@query("blocked_ip_lookup", """
SELECT req_id, ip, 403 AS status FROM http_log WHERE ip IN (SELECT ip FROM admin_actions WHERE action = 'approve')""")
def _(t):
    listed = t.view("admin_actions").filter("action = 'approve'").select("ip").distinct()
    return t.view("http_log").join(listed, "ip", "left_semi").select("req_id", "ip", F.lit(403).alias("status"))


# posts and comments ----------------------------------------------------------------------------------------

@query("text_like_search", """
SELECT id, title, author, epoch_us(created_at) AS created_us FROM posts WHERE lower(title) LIKE '%data%' OR lower(content) LIKE '%data%' ORDER BY created_at DESC""")
def _(t):
    hits = t.view("posts").filter(weblog.like_search("data", F.col("title"), F.col("content")))
    return hits.orderBy(F.desc("created_at")).select("id", "title", "author", micros("created_at").alias("created_us"))


@query("newest_first", "SELECT id, title, epoch_us(created_at) AS created_us FROM posts ORDER BY created_at DESC")
def _(t):
    return t.view("posts").orderBy(F.desc("created_at")).select("id", "title", micros("created_at").alias("created_us"))


@query("post_comments", """
SELECT p.id, p.title, c.comment_no, c.author AS comment_author, c.content AS comment FROM posts p LEFT JOIN comments c ON c.post_id = p.id""")
def _(t):
    posts = t.view("posts").select("id", "title")
    comments = t.view("comments").select(F.col("post_id").alias("id"), "comment_no", F.col("author").alias("comment_author"),
                                         F.col("content").alias("comment"), "created_at")
    return posts.join(comments, "id", "left").orderBy("id", "created_at").drop("created_at")
