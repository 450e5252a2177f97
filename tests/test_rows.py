"""Conditions, filters, cleaning, features and rules on hand rows."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwatch import config
from rillwatch.functions import weblog
from rillwatch.functions.compare import compare
from rillwatch.functions.features import add_derived_features
from rillwatch.operators import clean, ipfilter, profile, rules, sampling, scoring


def values(df, col):
    return [r[col] for r in df.collect()]


@pytest.mark.parametrize("value,dtype,op,expected,want", [
    (17, T.IntegerType(), "eq", 17, True), (17, T.IntegerType(), "eq", "17", False), (17, T.IntegerType(), "ne", "17", True),
    ("17", T.StringType(), "gt", 16, True), ("abc", T.StringType(), "gt", 1, False), ("abc", T.StringType(), "lt", 1, False),
    (5, T.LongType(), "gte", "5", True), (5, T.LongType(), "lte", 4, False), (5, T.LongType(), "in", [1, 5], True),
    ("a", T.StringType(), "in", ["a", 3], True), (5, T.LongType(), "in", [], False), (5, T.LongType(), "like", 5, False),
    (5, T.LongType(), "gt", "five", False), (None, T.LongType(), "lt", 5, False), (None, T.LongType(), "ne", 5, False),
])
def test_compare(spark, value, dtype, op, expected, want):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    assert df.select(compare(F.col("v"), dtype, op, expected).alias("r")).first()["r"] is want


IPS = [None, "192.168.1.4", "10.1.1.1", "172.16.0.9", "172.31.9.9", "172.32.0.1", "127.0.0.1", "8.8.8.8", "8.8.8.88", "74.125.3.4",
       "74.12.5.4", "203.0.113.5", "110.1.1.1", "10", "1.1.1.1", "169.254.0.3"]
OUTSIDE = {"172.32.0.1", "8.8.8.88", "74.12.5.4", "203.0.113.5", "110.1.1.1", "10"}


def test_ip_filter_and_join_agree(spark):
    df = spark.createDataFrame([(ip,) for ip in IPS], "src_ip string")
    assert set(values(ipfilter.drop_filtered(df), "src_ip")) == OUTSIDE
    assert set(values(ipfilter.drop_listed(df, ipfilter.filter_lists(spark)), "src_ip")) == OUTSIDE


def test_ip_filter_flags_and_columns(spark):
    df = spark.createDataFrame([(ip,) for ip in IPS], "src_ip string")
    assert ipfilter.drop_filtered(df, enabled=False).count() == len(IPS)
    assert ipfilter.drop_filtered(df, filter_local=False).count() == len(IPS)
    assert set(values(ipfilter.drop_filtered(df.withColumnRenamed("src_ip", "Src IP")), "Src IP")) == OUTSIDE
    assert ipfilter.drop_filtered(df.withColumnRenamed("src_ip", "host")).count() == len(IPS)
    assert ipfilter.drop_filtered(df, local=[], trusted=[], prefixes=[]).count() == len(IPS) - 1


def test_exclude_hosts_either_end(spark):
    df = spark.createDataFrame([("a", "b"), ("172.217.194.81", "b"), ("a", "192.168.241.1"), (None, "b")], "src_ip string, dst_ip string")
    assert ipfilter.exclude_hosts(df).count() == 2


def test_clean_for_topic(spark):
    df = spark.createDataFrame([(1, float("inf"), None), (None, float("nan"), "x"), (3, -float("inf"), "y")], "a int, b double, c string")
    assert [tuple(r) for r in clean.clean_for_topic(df).collect()] == [(1.0, 0.0, "0"), (0.0, 0.0, "x"), (3.0, 0.0, "y")]


def test_clean_runs_twice_and_collapses_more(spark):
    raw = spark.createDataFrame([(1.0, "DDoS"), (1.0, "Syn"), (2.0, "BENIGN"), (None, "Benign")], "` Flow IAT Max` double, ` Label` string")
    a, b = clean.prepare_labeled(raw, raw)
    # the two attacks become equal once their label is binary
    assert sorted(tuple(r) for r in a.collect()) == [(1.0, 0), (1.0, 1), (2.0, 0)]
    assert a.columns == ["flow_iat_max", "label"] == b.columns


def test_label_and_names():
    assert clean.tidy_name("  Flow Bytes/s ") == "flow_bytess"


def test_binary_label_null_is_attack(spark):
    df = spark.createDataFrame([("BENIGN",), ("benign",), ("x",), (None,)], "label string")
    assert values(df.select(clean.binary_label(F.col("label")).alias("y")), "y") == [0, 0, 1, 1]


def test_features_guards(spark):
    df = spark.createDataFrame([(0, 0, -5, 10.0, 30.0), (4, 6, 2, 30.0, 10.0)],
                               "tot_fwd_pkts long, tot_bwd_pkts long, flow_duration long, flow_iat_max double, flow_iat_min double")
    zero, some = add_derived_features(df).orderBy("total_packets").collect()
    assert zero["mean_packet_size"] == 0 and zero["fwd_ratio"] == 0 and zero["flow_duration"] == 1e-6 and zero["iat_range"] == 0
    assert some["fwd_ratio"] == 0.4 and some["iat_range"] == 20 and some["total_bytes"] == 0
    assert math.isclose(some["log_packet_rate"], math.log1p(10 / (2 + 1e-6)))


def test_features_without_duration(spark):
    row = add_derived_features(spark.createDataFrame([(3,)], "total_fwd_packets long")).first()
    assert row["flow_duration"] == 1.0 and row["packet_rate"] == 3.0 and row["iat_range"] == 0.0


def rule(id_, field, op, value, **kw):
    return {"id": id_, "name": id_, "severity": "low", "description": "", "action": "alert", "conditions": [{"field": field, "metric": field, "operator": op, "value": value}], **kw}


def test_first_enabled_rule_wins(spark):
    df = spark.createDataFrame([(5, 17), (5, 6), (None, 17)], "n long, protocol int")
    tried = [rule("off", "n", "gt", 0, enabled=False), rule("a", "n", "gt", 3), rule("b", "protocol", "eq", 17)]
    out = rules.per_flow_match(df, tried).select("match.rule_id").collect()
    assert [r[0] for r in out] == ["a", "a", "b"]
    hit, rest = rules.split_by_rules(df, [rule("x", "absent", "ne", 3)])
    assert hit.count() == 0 and rest.count() == 3
    assert rules.split_by_rules(df, [])[1].count() == 3


STAT = dict.fromkeys(["total_flows", "syn_flag_count", "ack_flag_count", "tcp_packet_count", "udp_packet_count", "icmp_packet_count", "total_packets",
                      "unique_src_ips", "unique_dst_ports", "flows_per_ip", "packets_per_ip", "unique_dst_ports_per_ip"], 0)


@pytest.mark.parametrize("stats,want", [
    ({"syn_flag_count": 501, "syn_ack_ratio": 0.81}, {"AGG-001"}),
    ({"syn_flag_count": 501, "syn_ack_ratio": 0.8}, set()),
    ({"udp_packet_count": 10001}, {"AGG-002"}),
    ({"flows_per_ip": 201, "packets_per_ip": 50001}, {"AGG-005"}),
    ({"unique_dst_ports_per_ip": 51, "flows_per_ip": 51}, {"AGG-006"}),
    ({"unique_dst_ports": 101, "udp_packet_count": 1001}, {"AGG-007"}),
    ({"unique_dst_ports": 101, "udp_packet_count": 10000}, set()),
    ({"unique_src_ips": 51, "flows_per_ip": 49, "total_packets": 20001}, {"AGG-008"}),
    ({"unique_src_ips": 51, "flows_per_ip": 50, "total_packets": 60000, "total_flows": 501}, {"AGG-009"}),
])
def test_window_rules(spark, stats, want):
    from rillwatch.operators.windows import STAT_NAMES

    row = {"syn_ack_ratio": 0.0, **STAT, **stats}
    df = spark.createDataFrame([row], ", ".join(f"{k} {'double' if k == 'syn_ack_ratio' else 'long'}" for k in row))
    assert set(values(rules.window_matches(df), "rule_id")) == want
    assert set(values(rules.match_rule_rows(df, STAT_NAMES, config.AGGREGATION_RULES), "rule_id")) == want


def test_missing_metric_counts_as_zero(spark):
    df = spark.createDataFrame([(7,)], "total_flows long")
    assert values(rules.window_matches(df, [rule("low", "nothing", "lt", 5), rule("high", "nothing", "gt", 5)]), "rule_id") == ["low"]


def test_rule_window_is_honoured(spark):
    df = spark.createDataFrame([(900, 0.9, 20000)], "syn_flag_count long, syn_ack_ratio double, udp_packet_count long")
    assert values(rules.window_matches(df, window="60s"), "rule_id") == ["AGG-002"]
    assert values(rules.window_matches(df, window="30s"), "rule_id") == ["AGG-001"]


@pytest.mark.parametrize("bad,ratio,total,want", [(100, 0.8, 125, "critical"), (100, 0.79, 126, "high"), (20, 0.4, 50, "medium"), (10, 0.2, 50, "low"),
                                                  (10, 0.19, 53, None), (49, 0.99, 49, None), (9, 0.9, 60, None)])
def test_severity_ladder(spark, bad, ratio, total, want):
    df = spark.createDataFrame([(bad, ratio, total)], "b long, r double, t long")
    assert df.select(scoring.severity(F.col("b"), F.col("r"), F.col("t")).alias("s")).first()["s"] == want


def test_recommendation_default(spark):
    df = spark.createDataFrame([("high",), ("odd",), (None,)], "s string")
    out = values(df.select(scoring.recommendation(F.col("s")).alias("r")), "r")
    assert out[0].startswith("Investigate") and out[1:] == ["Unknown severity level"] * 2


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.98,), (0.979,)], "score double")
    assert [tuple(r) for r in scoring.label_scores(df).select("prediction", "confidence").collect()] == [("DDoS", 0.98), ("BENIGN", pytest.approx(0.021))]


@pytest.mark.parametrize("uri,route,zone", [("/login", "login", "login"), ("/loginpage?x=1", "login", "login"), ("/api/x", "api", "api"), ("/api/x.js", "static", "global"),
                                            ("/health", "health", None), ("/a/b.PNG?z=/login", "static", "global"), ("/", "other", "global")])
def test_routes(spark, uri, route, zone):
    df = spark.createDataFrame([(uri,)], "uri string")
    assert tuple(df.select(weblog.route_class(F.col("uri")), weblog.rate_zone(F.col("uri"))).first()) == (route, zone)


def test_weblog_classes(spark):
    df = spark.createDataFrame([("/a?x=1 UNION all SELECT", "CRAWLER/1", 404, "Application/JSON; q"), ("/x/.git/config.bak", "", 403, "application/soap+xml"), ("/ok", None, 599, "text/html")],
                               "uri string, ua string, status int, ct string")
    out = df.select(weblog.suspicious_classes(F.col("uri")), weblog.sensitive_classes(F.col("uri")), weblog.is_bot(F.col("ua")), weblog.audit_relevant(F.col("status")),
                    weblog.is_blocked(F.col("status")), weblog.body_kind(F.col("ct"))).collect()
    assert tuple(out[0]) == (["sql_injection"], [], True, False, False, "JSON")
    assert tuple(out[1]) == ([], ["file_type", "hidden_file"], True, True, True, "XML")
    assert tuple(out[2]) == ([], [], True, True, False, "OTHER")


def test_request_limits(spark):
    df = spark.createDataFrame([(1, "&".join(["a"] * 1000)), (10485761, ""), (13107201, None)], "n long, args string")
    assert values(df.select(weblog.limit_breaches(F.col("n"), F.col("args")).alias("b")), "b") == [["arguments"], ["body_size"], ["body_size", "request_size"]]


def test_like_ignores_ascii_case(spark):
    df = spark.createDataFrame([("Big DATA", "x"), ("x", "no"), (None, "my data")], "title string, content string")
    assert df.filter(weblog.like_search("data", F.col("title"), F.col("content"))).count() == 2


def test_profiles(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (-1, float("inf"), "a"), (-1, float("inf"), "a")], "a int, b double, label string")
    assert {tuple(r) for r in profile.missing(df).collect()} == {("b", 1), ("label", 1)}
    assert [tuple(r) for r in profile.infinite(df).collect()] == [("b", 2)]
    assert [tuple(r) for r in profile.negative(df).collect()] == [("a", 2)]
    assert profile.duplicates(df).first()[0] == 1
    assert tuple(profile.shape(df).first()) == (3, 3)
    assert profile.label_column(df) == "label" and profile.label_column(df.drop("label")) is None


def test_exact_sample_and_split(spark):
    df = spark.range(5000).withColumn("y", F.when(F.col("id") % 10 == 0, 1).otherwise(0))
    assert sampling.exact_sample(df, "id", 777).count() == 777
    assert sampling.exact_sample(df, "id", 9999).count() == 5000
    one, two = (set(values(sampling.exact_sample(d, "id", 300), "id")) for d in (df, df.repartition(7)))
    assert one == two
    split = sampling.stratified_split(df, "id", "y").groupBy("y", "is_validation").count().collect()
    assert {(r["y"], r["is_validation"]): r["count"] for r in split} == {(0, False): 4050, (0, True): 450, (1, False): 450, (1, True): 50}
    assert sampling.mix_attacks(df.filter("id < 100"), df.filter("id >= 100 AND id < 120"), "id").count() == 101


def test_order_statistics_over_extreme_values(spark):
    """Ends near the largest double overflow any width; many distinct values, ties and one huge outlier."""
    from rillwatch.operators import quantiles

    rows = [(float(i % 7000),) for i in range(20000)] + [(1.7e308,), (-1.7e308,), (None,), (float("nan"),), (float("inf"),)]
    values = sorted(v for v, in rows if v is not None and v == v and abs(v) != float("inf"))
    df = spark.createDataFrame(rows, "v double")
    wanted = [0, 1, 5000, 10000, 20000, 20001]
    old = quantiles.ACCURACY
    try:
        for quantiles.ACCURACY in (old, 50):  # many narrowing rounds
            got = quantiles.order_statistics(df, {"v": wanted})["v"]
            assert [got[r] for r in wanted] == [values[r] for r in wanted]
            assert [got["below", r] for r in wanted] == [sum(v < values[r] for v in values) for r in wanted]
    finally:
        quantiles.ACCURACY = old


def test_split_over_many_classes(spark):
    from rillwatch.operators import sampling

    df = spark.range(6000).selectExpr("id", "id % 120 as c")
    out = sampling.stratified_split(df, "id", "c", 0.1)
    assert out.count() == 6000
    assert {(r["c"], r["n"]) for r in out.filter("is_validation").groupBy("c").count().withColumnRenamed("count", "n").collect()} == {(c, 5) for c in range(120)}


def test_samples_against_sorting(spark):
    """Equal ids in bulk, NULL labels, text ids, stretches of a few rows: the same rows as sorting by hash picks."""
    import hashlib
    import random

    from rillwatch.operators import sampling

    rng = random.Random(4)
    rows = [(f"id{rng.randrange(400)}" if i % 3 else "hot", None if i % 50 == 0 else rng.choice("abc")) for i in range(3000)] + [("only", "d")]
    df = spark.createDataFrame(rows, "id string, y string")
    digest = lambda x: (hashlib.md5(x.encode()).hexdigest(), x)
    old = sampling.STRETCH
    try:
        for sampling.STRETCH in (old, 7):
            for n in (1, 50, 999):
                edge = sorted(digest(i) for i, _ in rows)[n - 1]
                want = sorted(i for i, _ in rows if digest(i) <= edge)
                assert sorted(r.id for r in sampling.exact_sample(df, "id", n).collect()) == want
            out = sampling.stratified_split(df, "id", "y", 0.2)
            assert out.columns == ["id", "y", "is_validation"] and out.count() == len(rows)
            for y in "abcd":
                mine = sorted(digest(i) for i, v in rows if v == y)
                k = int(len(mine) * 0.2)
                want = sorted(i for _, i in mine if k and digest(i) <= mine[k - 1])
                assert sorted(r.id for r in out.filter(f"y = '{y}' AND is_validation").collect()) == want
            assert out.filter("y IS NULL AND is_validation").count() == 0
    finally:
        sampling.STRETCH = old
    assert sampling.exact_sample(df.limit(0), "id", 5).count() == 0 and sampling.exact_sample(df, "id", 0).count() == 0


def test_split_leaves_rows_where_they_are(spark, monkeypatch):
    """Two labels hold all rows; neither is gathered in one task."""
    monkeypatch.setattr(sampling, "STRETCH", 10_000)
    df = spark.range(0, 40_000, 1, 8).select("id", (F.col("id") % 2).alias("y"))
    out = sampling.stratified_split(df, "id", "y", 0.1)
    found = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if("is_validation").alias("held")).collect()
    assert len(found) == 8 and max(r["n"] for r in found) <= 5_000
    assert sum(r["held"] for r in found) == 4_000
