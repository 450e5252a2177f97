"""All queries by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwatch.fixtures import Inputs
from rillwatch.operators import rules, windows
from rillwatch.plans import q_alerts, q_flows, q_logs, q_metrics, q_models, q_sources, q_streams, q_tables
from rillwatch.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "flagship", "q_alerts", "q_logs", "q_metrics", "q_models", "q_sources", "q_streams", "q_tables"]


def flagship(spark, sf_dir):
    """Window statistics after address filter and per-flow rules, with fired rules and top sources."""
    flows = q_flows.unmatched(Inputs(spark, sf_dir))
    stats = windows.window_stats(flows, 60)
    fired = rules.window_matches(stats, window="60s").groupBy("win").agg(
        F.array_sort(F.collect_list("rule_id")).alias("rules"))  # at most one entry per configured rule
    top = windows.top_list(windows.top_sources(flows, 60))
    return stats.join(fired, "win", "left").join(top, "win", "left").orderBy("win")
