"""Queries on whole tables: profiles, unions, duplicates, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwatch.operators import clean, profile
from rillwatch.operators.blocks import running_totals
from rillwatch.operators.windows import micros
from rillwatch.plans.q_flows import rounded
from rillwatch.plans.registry import query

_NUMERIC = ["src_port", "dst_port", "protocol", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_iat_max", "flow_iat_min"]


@query("profile_missing", """
SELECT * FROM (SELECT 'src_ip' AS column_name, count(*) - count(src_ip) AS missing FROM flows_raw UNION ALL SELECT 'tot_fwd_pkts', count(*) - count(tot_fwd_pkts) FROM flows_raw
 UNION ALL SELECT 'flow_iat_max', count(*) - count(flow_iat_max) FROM flows_raw UNION ALL SELECT 'dst_ip', count(*) - count(dst_ip) FROM flows_raw) x WHERE missing > 0""")
def _(t):
    return profile.missing(t.view("flows_raw"))


@query("profile_infinite", "SELECT * FROM (SELECT 'flow_iat_max' AS column_name, count(CASE WHEN isinf(flow_iat_max) THEN 1 END) AS infinite FROM flows_raw) x WHERE infinite > 0")
def _(t):
    return profile.infinite(t.view("flows_raw"))


@query("profile_negative", "SELECT * FROM (SELECT 'flow_duration' AS column_name, count(CASE WHEN flow_duration < 0 THEN 1 END) AS negative FROM flows_raw) x WHERE negative > 0")
def _(t):
    return profile.negative(t.view("flows_raw"))


@query("profile_duplicates", "SELECT (SELECT count(*) FROM flows_raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flows_raw) x) AS duplicate_rows")
def _(t):
    return profile.duplicates(t.view("flows_raw"))


@query("profile_shape", "SELECT count(*) AS n_rows, 14::BIGINT AS n_columns FROM flows_raw")
def _(t):
    return profile.shape(t.view("flows_raw"))


@query("profile_label_detect", "SELECT 'label' AS label_column, label AS label_value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM labeled), 3) AS percent FROM labeled GROUP BY 2")
def _(t):
    df = t.view("labeled")
    name = profile.label_column(df)
    return profile.label_distribution(df, name).withColumn("label_column", F.lit(name))


@query("label_distribution", """
SELECT CASE WHEN lower(label) = 'benign' THEN 0 ELSE 1 END AS label_value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM labeled), 3) AS percent FROM labeled GROUP BY 1""")
def _(t):
    return profile.label_distribution(t.view("labeled").withColumn("y", clean.binary_label(F.col("label"))), "y")


_BALANCE = "count(*) AS total, count(CASE WHEN y = 0 THEN 1 END) AS benign, count(CASE WHEN y = 1 THEN 1 END) AS attack, round(count(CASE WHEN y = 0 THEN 1 END) * 100.0 / count(*), 2) AS benign_pct, round(count(CASE WHEN y = 1 THEN 1 END) * 100.0 / count(*), 2) AS attack_pct, round(count(CASE WHEN y = 1 THEN 1 END) / CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE), 2) AS attack_per_benign"


@query("dataset_balance_report", f"""
SELECT 'tcp' AS dataset, {_BALANCE} FROM (SELECT CASE WHEN lower(label) = 'benign' THEN 0 ELSE 1 END AS y FROM labeled WHERE protocol = 6) a
UNION ALL SELECT 'all', {_BALANCE} FROM (SELECT CASE WHEN lower(label) = 'benign' THEN 0 ELSE 1 END AS y FROM labeled) b""")
def _(t):
    df = t.view("labeled").withColumn("y", clean.binary_label(F.col("label")))
    return profile.balance_report({"tcp": df.filter("protocol = 6"), "all": df}, "y")


@query("numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM flows) x"
    for c in _NUMERIC))
def _(t):
    return rounded(profile.numeric_profile(t.view("flows"), _NUMERIC), 4).withColumns(
        {c: F.col(c).cast("double") for c in ("min", "max")})


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM flows" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i:]))
def _(t):
    return rounded(profile.correlations(t.view("flows"), _NUMERIC))


# sets ------------------------------------------------------------------------------------------------------

@query("union_datasets", """
SELECT flow_id, protocol, CAST(tot_bwd_pkts AS DOUBLE) AS tot_bwd_pkts, syn_flag_cnt FROM flows UNION ALL SELECT flow_id, protocol, tot_bwd_pkts, NULL FROM flows_raw""")
def _(t):
    a = t.view("flows").select("flow_id", "protocol", F.col("tot_bwd_pkts").cast("double"), "syn_flag_cnt")
    return a.unionByName(t.view("flows_raw").select("flow_id", "protocol", "tot_bwd_pkts"), allowMissingColumns=True)


@query("drop_duplicates", """
SELECT DISTINCT flow_id, epoch_us(flow_ts) AS us, src_ip, dst_ip, src_port, dst_port, protocol, flow_duration, tot_fwd_pkts, tot_bwd_pkts, totlen_fwd_pkts, totlen_bwd_pkts, round(flow_iat_max, 6) AS flow_iat_max, round(flow_iat_min, 6) AS flow_iat_min FROM flows_raw""")
def _(t):
    return rounded(t.view("flows_raw").dropDuplicates().withColumn("us", micros("flow_ts")).drop("flow_ts"))


@query("common_columns", "SELECT flow_id, src_ip, dst_port, CAST(tot_bwd_pkts AS DOUBLE) AS tot_bwd_pkts FROM flows_raw")
def _(t):
    a = t.view("flows_raw").select("flow_id", "src_ip", "dst_port", "tot_bwd_pkts")
    b = t.view("labeled").drop("flow_ts")
    return a.select(clean.common_columns(a, b))


@query("retry_attempt_rank", """
SELECT file, us, row_number() OVER (PARTITION BY file ORDER BY us) AS attempt FROM (SELECT 'flows_' || CAST(user_id % 20 AS VARCHAR) || '.csv' AS file, t_us AS us FROM ev WHERE event_type = 'error') x""")
def _(t):
    failures = t.view("ev").filter("event_type = 'error'").select(
        F.concat(F.lit("flows_"), (F.col("user_id") % 20).cast("string"), F.lit(".csv")).alias("file"), F.col("t_us").alias("us"), F.lit(1).alias("one"))
    return running_totals(failures, ["file"], "us", {"attempt": "one"}, 60_000_000).drop("one")


@query("src_file_retry_deadletter", """
SELECT file, CAST(sum(CASE WHEN ok OR us < COALESCE(last_ok, -1) THEN 0 ELSE 1 END) AS BIGINT) AS attempts, sum(CASE WHEN ok OR us < COALESCE(last_ok, -1) THEN 0 ELSE 1 END) >= 3 AS dead FROM
 (SELECT *, max(CASE WHEN ok THEN us END) OVER (PARTITION BY file) AS last_ok FROM (SELECT 'flows_' || CAST(user_id AS VARCHAR) || '.csv' AS file, t_us AS us, event_type <> 'error' AS ok FROM ev) e) x GROUP BY 1""")
def _(t):
    from rillwatch.sources.files import retry_state

    tries = t.view("ev").select(F.concat(F.lit("flows_"), F.col("user_id").cast("string"), F.lit(".csv")).alias("file"),
                                F.col("t_us").alias("us"), (F.col("event_type") != "error").alias("ok"))
    return retry_state(tries)


# scalar functions, one query per family --------------------------------------------------------------------

@query("scalar_math", """
SELECT flow_id, round(ln(1 + tot_fwd_pkts), 6) AS l, greatest(tot_fwd_pkts - 5000, 0) AS clipped, round(tot_fwd_pkts / NULLIF(CAST(tot_bwd_pkts AS DOUBLE), 0), 6) AS ratio, greatest(tot_bwd_pkts, 1) AS at_least_one,
 CAST(floor(flow_iat_min / 7) AS BIGINT) AS whole FROM flows""")
def _(t):
    return rounded(t.view("flows").select(
        "flow_id", F.log1p("tot_fwd_pkts").alias("l"), F.greatest(F.col("tot_fwd_pkts") - 5000, F.lit(0)).alias("clipped"),
        F.try_divide(F.col("tot_fwd_pkts").cast("double"), F.col("tot_bwd_pkts")).alias("ratio"),
        F.greatest("tot_bwd_pkts", F.lit(1)).alias("at_least_one"), F.floor(F.col("flow_iat_min") / 7).cast("long").alias("whole")))


@query("scalar_string", """
SELECT id, trim(title) AS trimmed, replace(lower(title), ' ', '_') AS tidy, replace(upper(substr(title, 1, 10)), 'ẞ', 'SS') AS head, regexp_replace(title, '[^A-Za-z0-9_]', '', 'g') AS plain, starts_with(title, 'The') AS the,
 contains(content, 'a') AS has_a, author || '/' || CAST(id AS VARCHAR) AS tag FROM posts""")
def _(t):
    p = t.view("posts")
    return p.select("id", F.trim("title").alias("trimmed"), F.replace(F.lower("title"), F.lit(" "), F.lit("_")).alias("tidy"),
                    F.upper(F.substring("title", 1, 10)).alias("head"), F.regexp_replace("title", "[^A-Za-z0-9_]", "").alias("plain"),
                    F.col("title").startswith("The").alias("the"), F.col("content").contains("a").alias("has_a"),
                    F.concat_ws("/", "author", F.col("id").cast("string")).alias("tag"))


@query("scalar_format", """
SELECT flow_id, format('{:,}', totlen_fwd_pkts) AS thousands, printf('%.1f%%', flow_iat_min) AS pct, printf('%.2f', flow_iat_max / 7.0) AS fixed FROM flows""")
def _(t):
    return t.view("flows").select("flow_id", F.format_number("totlen_fwd_pkts", 0).alias("thousands"),
                                  F.format_string("%.1f%%", "flow_iat_min").alias("pct"), F.format_string("%.2f", F.col("flow_iat_max") / 7.0).alias("fixed"))


@query("scalar_date", """
SELECT flow_id, strftime(flow_ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(flow_ts) // 1000000 AS secs, epoch_us(flow_ts + INTERVAL 60 SECOND) AS later_us, 'rule_X_' || CAST(epoch_us(flow_ts) // 1000000 AS VARCHAR) AS id_text FROM flows""")
def _(t):
    f = t.view("flows")
    return f.select("flow_id", F.date_format("flow_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_seconds("flow_ts").alias("secs"),
                    micros(F.col("flow_ts") + F.expr("INTERVAL 60 SECONDS")).alias("later_us"),
                    F.concat(F.lit("rule_X_"), F.unix_seconds("flow_ts").cast("string")).alias("id_text"))


@query("scalar_null", """
SELECT flow_id, src_ip IS NULL AS no_ip, COALESCE(isinf(flow_iat_max), false) AS is_inf, COALESCE(tot_fwd_pkts, 0) AS filled, COALESCE(src_ip, 'unknown') AS ip FROM flows_raw""")
def _(t):
    return t.view("flows_raw").select(
        "flow_id", F.col("src_ip").isNull().alias("no_ip"), F.coalesce(F.abs("flow_iat_max") == float("inf"), F.lit(False)).alias("is_inf"),
        F.coalesce("tot_fwd_pkts", F.lit(0.0)).alias("filled"), F.coalesce("src_ip", F.lit("unknown")).alias("ip"))


@query("scalar_collections", """
SELECT alert_id, epoch_us(alert_ts) AS us, severity, attacker_ips[1] AS first_ip, len(attacker_ips) AS n_ips, array_to_string(['<' || x || '>' for x in attacker_ips], '') AS tagged, flow_count AS from_map FROM alerts""")
def _(t):
    a = t.view("alerts")
    sizes = F.create_map(F.lit("flows"), F.col("flow_count"))
    return a.select("alert_id", micros("alert_ts").alias("us"), "severity", F.slice("attacker_ips", 1, 1)[0].alias("first_ip"),
                    F.size("attacker_ips").cast("long").alias("n_ips"),
                    F.array_join(F.transform("attacker_ips", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("tagged"),
                    F.try_element_at(sizes, F.lit("flows")).alias("from_map"))


@query("scalar_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id, value FROM events")
def _(t):
    e = t.table("events")
    text = F.to_json(F.struct("event_id", "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k")))
    return e.select(F.from_json(text, "event_id long, k int, user_id long, value double").alias("r")).select("r.*")


@query("scalar_sample", """
SELECT flow_id FROM (SELECT flow_id, row_number() OVER (ORDER BY md5(CAST(flow_id AS VARCHAR)), flow_id) AS i FROM flows) x WHERE i <= 500""")
def _(t):
    from rillwatch.operators.sampling import exact_sample

    return exact_sample(t.view("flows"), "flow_id", 500).select("flow_id")
