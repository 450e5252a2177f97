"""Fixed schemas of flows, alerts and access logs."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW = T.StructType([
    T.StructField("flow_id", T.LongType()),
    T.StructField("flow_ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("flow_duration", T.LongType()),
    T.StructField("tot_fwd_pkts", T.LongType()),
    T.StructField("tot_bwd_pkts", T.LongType()),
    T.StructField("totlen_fwd_pkts", T.LongType()),
    T.StructField("totlen_bwd_pkts", T.LongType()),
    T.StructField("flow_iat_max", T.DoubleType()),
    T.StructField("flow_iat_min", T.DoubleType()),
    T.StructField("syn_flag_cnt", T.LongType()),
    T.StructField("ack_flag_cnt", T.LongType()),
])

ALERT = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("alert_ts", T.TimestampType()),
    T.StructField("attacker_ips", T.ArrayType(T.StringType())),
    T.StructField("flow_count", T.LongType()),
    T.StructField("suspicious_ratio", T.DoubleType()),
])

# one JSON line per request, as the proxy writes it
ACCESS_LOG = T.StructType([
    T.StructField("time", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("xff", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("args", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("req_len", T.LongType()),
    T.StructField("req_time", T.DoubleType()),
    T.StructField("up_time", T.StringType()),
    T.StructField("ua", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("blocked", T.StringType()),
    T.StructField("limit_req", T.StringType()),
    T.StructField("cache", T.StringType()),
])


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]
