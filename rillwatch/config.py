"""Shipped settings. Every value can be replaced by the caller's own."""

from __future__ import annotations

# Address lists that are never treated as attackers.
LOCAL_PREFIXES = [
    "192.168.", "10.",
    "172.16.", "172.17.", "172.18.", "172.19.", "172.20.", "172.21.", "172.22.", "172.23.",
    "172.24.", "172.25.", "172.26.", "172.27.", "172.28.", "172.29.", "172.30.", "172.31.",
    "127.", "169.254.",
]
TRUSTED_IPS = [
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "149.112.112.112", "208.67.222.222", "208.67.220.220",
]
TRUSTED_PREFIXES = [
    "74.125.", "142.250.", "142.251.", "172.217.", "172.253.", "216.58.", "64.233.", "104.16.", "104.17.", "104.18.",
]
CAPTURE_EXCLUDED_IPS = ["192.168.241.1", "172.217.194.81"]

# Shipped detection rules.
PER_FLOW_RULES = [
    {"id": "PF-001", "name": "High-Volume UDP Single Flow", "enabled": True, "severity": "medium",
     "description": "Single UDP flow with extremely high packet count (early signal)",
     "conditions": [{"field": "protocol", "operator": "eq", "value": 17},
                    {"field": "tot_fwd_pkts", "operator": "gt", "value": 1000},
                    {"field": "flow_duration", "operator": "lt", "value": 1000000}],
     "action": "alert"},
]
AGGREGATION_RULES = [
    {"id": "AGG-001", "name": "SYN Flood Attack", "enabled": True, "severity": "critical", "window": "30s",
     "description": "High SYN count with low ACK ratio - classic SYN flood",
     "conditions": [{"metric": "syn_flag_count", "operator": "gt", "value": 500},
                    {"metric": "syn_ack_ratio", "operator": "gt", "value": 0.8}],
     "action": "alert_and_block"},
    {"id": "AGG-002", "name": "UDP Flood Attack", "enabled": True, "severity": "critical", "window": "60s",
     "description": "Massive UDP packet flood",
     "conditions": [{"metric": "udp_packet_count", "operator": "gt", "value": 10000}],
     "action": "alert_and_block"},
    {"id": "AGG-005", "name": "High Volume from Single IP", "enabled": True, "severity": "high", "window": "60s",
     "description": "Excessive traffic from one source",
     "conditions": [{"metric": "flows_per_ip", "operator": "gt", "value": 200},
                    {"metric": "packets_per_ip", "operator": "gt", "value": 50000}],
     "action": "alert"},
    {"id": "AGG-006", "name": "Port Scan Detection", "enabled": True, "severity": "medium", "window": "60s",
     "description": "Scanning multiple ports from single IP",
     "conditions": [{"metric": "unique_dst_ports_per_ip", "operator": "gt", "value": 50},
                    {"metric": "flows_per_ip", "operator": "gt", "value": 50}],
     "action": "alert"},
    {"id": "AGG-007", "name": "UDP Port Scan", "enabled": True, "severity": "medium", "window": "60s",
     "description": "UDP scanning multiple ports",
     "conditions": [{"metric": "unique_dst_ports", "operator": "gt", "value": 100},
                    {"metric": "udp_packet_count", "operator": "gt", "value": 1000},
                    {"metric": "udp_packet_count", "operator": "lt", "value": 10000}],
     "action": "alert"},
    {"id": "AGG-008", "name": "Low-Rate DDoS / Distributed Attack", "enabled": True, "severity": "high", "window": "60s",
     "description": "Many sources with moderate traffic each - distributed DDoS",
     "conditions": [{"metric": "unique_src_ips", "operator": "gt", "value": 50},
                    {"metric": "flows_per_ip", "operator": "lt", "value": 50},
                    {"metric": "total_packets", "operator": "gt", "value": 20000}],
     "action": "alert"},
    {"id": "AGG-009", "name": "High-Volume Distributed Attack (Botnet Flood)", "enabled": True, "severity": "critical",
     "window": "60s", "description": "Massive traffic from many sources - coordinated botnet attack",
     "conditions": [{"metric": "unique_src_ips", "operator": "gt", "value": 30},
                    {"metric": "total_packets", "operator": "gt", "value": 50000},
                    {"metric": "total_flows", "operator": "gt", "value": 500}],
     "action": "alert_and_block"},
]
WINDOW_SECONDS = {"short": 30, "medium": 60, "long": 300}
ENABLED_WINDOWS = ["short", "medium"]
RULE_COOLDOWN_SECONDS = 60

# Severity ladder over scored windows, first level whose two minimums are met.
SEVERITY_LADDER = [("critical", 100, 0.8), ("high", 50, 0.6), ("medium", 20, 0.4), ("low", 10, 0.2)]
MIN_FLOWS_FOR_ANALYSIS = 50
SEVERITY_COOLDOWN_SECONDS = 300
RECOMMENDATIONS = {
    "critical": "Immediate blocking required. High confidence attack.",
    "high": "Investigate and block if confirmed.",
    "medium": "Monitor closely. Potential attack.",
    "low": "Low priority warning.",
}
UNKNOWN_RECOMMENDATION = "Unknown severity level"
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}

# Classification threshold and block time.
SCORE_THRESHOLD = 0.98
BLOCK_SECONDS = 3600

# Notifier limits, in seconds and alerts.
NOTIFY_WINDOW, NOTIFY_MAX, NOTIFY_MIN_INTERVAL, NOTIFY_COOLDOWN = 300, 5, 60, 600
SUMMARY_AFTER, SUMMARY_SIZE, SUMMARY_CHECK = 180, 10, 30

# Request limits per zone, (requests per second, burst).
RATE_ZONES = {"global": (50, 100), "login": (5, 10), "api": (30, 50)}
MAX_CONNECTIONS = 20
MAX_REQUEST_BYTES, MAX_UPLOAD_BYTES, MAX_ARGUMENTS = 13107200, 10 * 1024 * 1024, 1000

# Column names of the labelled sets, the renames between the two, and the clipping list.
TRAINING_RENAMES = {
    "total_length_of_fwd_packets": "fwd_packets_length_total",
    "total_length_of_bwd_packets": "bwd_packets_length_total",
    "min_packet_length": "packet_length_min",
    "max_packet_length": "packet_length_max",
    "average_packet_size": "avg_packet_size",
    "init_win_bytes_forward": "init_fwd_win_bytes",
    "init_win_bytes_backward": "init_bwd_win_bytes",
    "act_data_pkt_fwd": "fwd_act_data_packets",
    "min_seg_size_forward": "fwd_seg_size_min",
}
UNIMPORTANT_COLUMNS = ["init_fwd_win_bytes", "init_bwd_win_bytes", "fwd_seg_size_min"]
NEVER_NEGATIVE = [
    "flow_duration", "flow_bytess", "flow_packetss", "flow_iat_min", "flow_iat_max", "flow_iat_mean", "fwd_iat_min",
    "fwd_header_length", "bwd_header_length", "packet_length_min", "packet_length_max", "packet_length_mean",
    "packet_length_std", "packet_length_variance",
]
LABEL_NAMES = ["Label", "Attack", "attack_cat", "class", "label"]
SOURCE_IP_NAMES = ["src_ip", "Src IP", "Source IP", "src"]
FWD_BYTES_NAMES = ["totlen_fwd_pkts", "fwd_packets_length_total", "total_length_of_fwd_packets", "subflow_fwd_byts",
                   "subflow_fwd_bytes", "Subflow Fwd Bytes"]
BWD_BYTES_NAMES = ["totlen_bwd_pkts", "bwd_packets_length_total", "total_length_of_bwd_packets", "subflow_bwd_byts",
                   "subflow_bwd_bytes", "Subflow Bwd Bytes"]
FWD_PACKET_NAMES = ["tot_fwd_pkts", "total_fwd_packets"]
BWD_PACKET_NAMES = ["tot_bwd_pkts", "total_backward_packets", "total_backwards_packets"]
REQUIRED_FLOW_COLUMNS = ["src_ip", "dst_ip", "tot_fwd_pkts"]

# Metric names a scrape keeps.
KEPT_METRICS = "nginx_server_requests|nginx_server_bytes|nginx_server_cache|nginx_server_connections"


def load_yaml(path: str) -> dict:
    """Read a settings file; a missing or broken file gives an empty mapping, so defaults apply."""
    import yaml

    try:
        with open(path, encoding="utf-8") as fh:
            return yaml.safe_load(fh) or {}
    except (OSError, yaml.YAMLError):
        return {}


def enabled_rules(rules: list[dict]) -> list[dict]:
    return [r for r in rules if r.get("enabled", True)]
