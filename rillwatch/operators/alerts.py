"""Alerts: building, counting, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.operators import scoring, windows
from rillwatch.operators.windows import SECOND
from rillwatch.session import cut_lineage


def flow_alerts(matched: DataFrame, ts: str = "flow_ts") -> DataFrame:
    """One alert per flow that met a per-flow rule."""
    return matched.select(
        F.concat(F.lit("rule_"), F.col("match.rule_id"), F.lit("_"), F.unix_seconds(ts).cast("string")).alias("alert_id"),
        F.lit("rule-based").alias("source"),
        *[F.col(f"match.{c}").alias(c) for c in ("rule_id", "rule_name", "severity", "description", "action", "matched_conditions")],
        F.col(ts).alias("alert_ts"),
        F.array(F.coalesce("src_ip", F.lit("unknown"))).alias("attacker_ips"),
        F.lit(1.0).alias("confidence"),
        F.lit(None).cast("struct<" + ",".join(f"{n}:{'double' if n == 'syn_ack_ratio' else 'bigint'}" for n in windows.STAT_NAMES) + ">").alias("window_stats"),
    )


def window_alerts(matches: DataFrame, top: DataFrame, seconds: int) -> DataFrame:
    """One alert per window and rule met, stamped with the window end and naming its top sources.

    ``top`` has one short array per window; both sides are keyed by window number.
    """
    end = F.timestamp_micros((F.col("win") + 1) * seconds * SECOND)
    return matches.join(top, "win", "left").select(
        F.concat(F.lit("rule_"), F.col("rule_id"), F.lit("_"), ((F.col("win") + 1) * seconds).cast("string")).alias("alert_id"),
        F.lit("rule-based").alias("source"), "rule_id", "rule_name", "severity", "description", "action",
        "matched_conditions", end.alias("alert_ts"),
        F.coalesce("attacker_ips", F.array().cast("array<string>")).alias("attacker_ips"),
        F.lit(1.0).alias("confidence"), F.struct(*windows.STAT_NAMES).alias("window_stats"),
    )


def model_alerts(stats: DataFrame, top: DataFrame, seconds: int) -> DataFrame:
    """One alert per scored window that reaches a severity."""
    level = scoring.severity(F.col("suspicious_flows"), F.col("suspicious_ratio"), F.col("total_flows"))
    end = (F.col("win") + 1) * seconds
    return stats.withColumn("severity", level).filter(F.col("severity").isNotNull()).join(top, "win", "left").select(
        "win", F.concat(F.lit("ddos_"), end.cast("string")).alias("alert_id"),
        F.timestamp_micros(end * SECOND).alias("alert_ts"), "severity", F.lit("DDoS_Mixed").alias("attack_type"),
        "attacker_ips", F.lit("server").alias("target_ip"), F.col("suspicious_flows").alias("flow_count"),
        F.lit(0.0).alias("avg_confidence"), F.lit(f"{seconds}s").alias("time_window"),
        F.create_map(
            F.lit("total_flows"), F.col("total_flows").cast("double"), F.lit("suspicious_ratio"), F.col("suspicious_ratio"),
            F.lit("unique_attackers"), F.col("unique_attackers").cast("double")).alias("metrics"),
        scoring.recommendation(F.col("severity")).alias("recommendation"),
    )


def first_of_each(alerts: DataFrame, order: list[str], key: str = "alert_id") -> DataFrame:
    """The first row per alert id; copies collapse before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in alerts.columns])
    return alerts.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def per_attacker(alerts: DataFrame) -> DataFrame:
    """One row per alert and attacker address."""
    return alerts.withColumn("ip", F.explode("attacker_ips"))


def attacker_summary(alerts: DataFrame) -> DataFrame:
    """Per address: alerts, first and last seen, and how often each severity occurred.

    Severities are kept as (severity, n) so a busy address yields a few entries, not one per alert.
    """
    parts = per_attacker(alerts).groupBy("ip", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.min("alert_ts").alias("first_seen"), F.max("alert_ts").alias("last_seen"))
    return parts.groupBy("ip").agg(
        F.sum("n").alias("alert_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sort_array(F.collect_list(F.struct("severity", "n"))).alias("severities"))


def fold_ip_state(alerts: DataFrame, attack_type: str = "rule_name", confidence: str = "suspicious_ratio") -> DataFrame:
    """Alerts to one row per address: type and confidence of its first alert, worst severity, totals, seen range."""
    order = F.struct("alert_ts", "alert_id")
    return per_attacker(alerts).groupBy("ip").agg(
        F.min_by(F.col(attack_type), order).alias("attack_type"),
        F.min_by(F.col(confidence), order).alias("confidence"),
        F.max(scoring.severity_rank(F.col("severity"))).alias("_rank"),
        F.sum("flow_count").alias("flow_count"),
        F.count(F.lit(1)).alias("alert_count"),
        F.min("alert_ts").alias("first_seen"), F.max("alert_ts").alias("last_seen"),
    ).withColumn("severity", scoring.severity_name(F.col("_rank"))).drop("_rank")


# rendering -------------------------------------------------------------------------------------------------

def attack_family(rule_name: Column) -> Column:
    """Which statistics an alert reports, tried in this order; a UDP port scan therefore counts as UDP."""
    up = F.upper(rule_name)
    family = F.lit("OTHER")
    for word in reversed(["SYN", "UDP", "ICMP", "SCAN", "SLOW"]):
        family = F.when(up.contains(word), F.lit(word)).otherwise(family)
    return family


def _whole(c):
    return F.format_number(c.cast("long"), 0)


def _one(c):
    return F.format_string("%.1f", c.cast("double"))


def _plain(c):
    return c.cast("string")


# The lines each family reports, as (label, metric, format).
_REPORTS = {
    "SYN": [("SYN Packets", "syn_flag_count", _whole), ("ACK Packets", "ack_flag_count", _whole),
            ("SYN/ACK Ratio", "syn_ack_ratio", lambda c: F.format_string("%.2f%%", c * 100)),
            ("TCP Packets", "tcp_packet_count", _whole)],
    "UDP": [("UDP Packets", "udp_packet_count", _whole), ("Unique Dst Ports", "unique_dst_ports", _plain),
            ("Packets/IP", "packets_per_ip", _one)],
    "ICMP": [("ICMP Packets", "icmp_packet_count", _whole), ("Packets/IP", "packets_per_ip", _one)],
    "SCAN": [("Unique Dst Ports", "unique_dst_ports", _plain), ("Ports/IP", "unique_dst_ports_per_ip", _one),
             ("Unique Src IPs", "unique_src_ips", _plain)],
    "SLOW": [("TCP Packets", "tcp_packet_count", _whole), ("Flows/IP", "flows_per_ip", _one),
             ("Packets/IP", "packets_per_ip", _one)],
    "OTHER": [("Unique Src IPs", "unique_src_ips", _plain), ("Unique Dst Ports", "unique_dst_ports", _plain)],
}
_EMOJI = {"LOW": "⚠️", "MEDIUM": "🟡", "HIGH": "🔴", "CRITICAL": "🚨"}
_NO_EMOJI = "📌"


def family_report(family: Column, stats: str = "window_stats") -> Column:
    """The statistic lines of a family; 0 stands in for a missing figure, an absent port count is left out."""
    text = F.lit("")
    for name, lines in _REPORTS.items():
        parts = []
        for label, metric, form in lines:
            value = F.coalesce(F.col(f"{stats}.{metric}"), F.lit(0))
            line = F.concat(F.lit(f"  • {label}: <b>"), form(value), F.lit("</b>\n"))
            parts.append(F.when(value != 0, line).otherwise("") if (name, metric) == ("OTHER", "unique_dst_ports") else line)
        text = F.when(family == name, F.concat(*parts)).otherwise(text)
    return text


def _bullets(items: Column, keep: int, form) -> Column:
    shown = F.array_join(F.transform(F.slice(items, 1, keep), form), "")
    return F.concat(shown, F.when(F.size(items) > keep, F.concat(F.lit("  ... +"), (F.size(items) - keep).cast("string"), F.lit(" more\n"))).otherwise(""))


def _has(alerts, *cols):
    return set(cols) <= set(alerts.columns)


def format_alert(alerts: DataFrame) -> DataFrame:
    """Adds ``message``, the text sent to the chat, for rule alerts (with ``rule_name``) and model alerts."""
    level = F.upper(F.coalesce("severity", F.lit("UNKNOWN")))
    emoji = F.lit(_NO_EMOJI)
    for name, sign in _EMOJI.items():
        emoji = F.when(level == name, F.lit(sign)).otherwise(emoji)
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    parts = [emoji, F.lit(" <b>DDoS ALERT - "), level, F.lit("</b>\n\n<b>Time:</b> "),
             F.date_format("alert_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("\n")]
    if _has(alerts, "rule_name"):
        parts += [F.lit("<b>Type:</b> "), text("rule_name", "Unknown"), F.lit("\n<b>Rule:</b> "), text("rule_id", "N/A"),
                  F.lit("\n<b>Description:</b> "), text("description", "N/A"), F.lit("\n")]
    else:
        parts += [F.lit("<b>Type:</b> "), text("attack_type", "Unknown"), F.lit("\n<b>Target:</b> <code>"),
                  text("target_ip", "N/A"), F.lit("</code>\n<b>Flows:</b> "), text("flow_count", "0"), F.lit("\n")]
    sure = next((c for c in ("confidence", "avg_confidence") if _has(alerts, c)), None)
    if sure:
        parts.append(F.when(F.col(sure).isNotNull(), F.format_string("<b>Confidence:</b> %.1f%%\n", F.col(sure) * 100)).otherwise(""))
    if _has(alerts, "window_stats"):
        detail = family_report(attack_family(F.col("rule_name"))) if _has(alerts, "rule_name") else F.lit("")
        parts.append(F.when(F.col("window_stats").isNotNull(), F.concat(
            F.lit("\n<b>📊 Attack Statistics:</b>\n  • Total Flows: <b>"), _whole(F.col("window_stats.total_flows")), F.lit("</b>\n"), detail)).otherwise(""))
    ips = F.coalesce(F.col("attacker_ips"), F.array().cast("array<string>"))
    parts.append(F.when(F.size(ips) > 0, F.concat(
        F.lit("\n<b>🎯 Attackers ("), F.size(ips).cast("string"), F.lit("):</b>\n"),
        _bullets(ips, 5, lambda ip: F.concat(F.lit("  • <code>"), ip, F.lit("</code>\n"))))).otherwise(""))
    if _has(alerts, "action"):
        parts.append(F.when(F.col("action") != "", F.concat(F.lit("\n<b>⚡ Action:</b> "), F.col("action"), F.lit("\n"))).otherwise(""))
    if _has(alerts, "matched_conditions"):
        conds = F.coalesce(F.col("matched_conditions"), F.array().cast("array<string>"))
        parts.append(F.when(F.size(conds) > 0, F.concat(
            F.lit("\n<b>✓ Matched Conditions:</b>\n"), _bullets(conds, 3, lambda c: F.concat(F.lit("  • "), c, F.lit("\n"))))).otherwise(""))
    parts += [F.lit("\n<i>ID: "), text("alert_id", "N/A"), F.lit("</i>")]
    # "otherwise('')" covers NULL conditions, so no part can blank the whole message
    return alerts.withColumn("message", F.concat(*parts))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def top_attackers_with_rest(alerts: DataFrame, top_n: int = 10) -> DataFrame:
    """The addresses with most alerts, each row with how many more there are."""
    counts = cut_lineage(per_attacker(alerts).groupBy("ip").agg(F.count(F.lit(1)).alias("alert_count")))  # used twice
    more = max(counts.count() - top_n, 0)  # one number
    return counts.orderBy(F.desc("alert_count"), "ip").limit(top_n).withColumn("n_more", F.lit(more).cast("long"))
