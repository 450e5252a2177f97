"""Address filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwatch import config


def should_filter(ip: Column, local=None, trusted=None, prefixes=None) -> Column:
    """True for NULL, local, trusted and trusted-prefix addresses.

    All lists go into one anchored pattern, so the address is looked at once, whatever it is computed from.
    """
    local = config.LOCAL_PREFIXES if local is None else local
    trusted = config.TRUSTED_IPS if trusted is None else trusted
    prefixes = config.TRUSTED_PREFIXES if prefixes is None else prefixes
    starts = [re.escape(p) for p in [*local, *prefixes]]
    whole = [re.escape(ip) + r"\z" for ip in trusted]
    if not starts and not whole:
        return ip.isNull()
    return F.coalesce(ip.rlike("^(?:" + "|".join([*starts, *whole]) + ")"), F.lit(True))


def drop_filtered(flows: DataFrame, enabled: bool = True, filter_local: bool = True, **lists) -> DataFrame:
    """Flows from outside addresses only. Without a source column, or with a flag off, all rows stay."""
    column = next((c for c in config.SOURCE_IP_NAMES if c in flows.columns), None)
    if column is None or not (enabled and filter_local):
        return flows
    return flows.filter(~should_filter(F.col(f"`{column}`"), **lists))


def filter_lists(spark, local=None, trusted=None, prefixes=None) -> DataFrame:
    """The configured lists as rows (kind, entry)."""
    rows = [("local_prefix", p) for p in (config.LOCAL_PREFIXES if local is None else local)]
    rows += [("trusted_ip", p) for p in (config.TRUSTED_IPS if trusted is None else trusted)]
    rows += [("trusted_prefix", p) for p in (config.TRUSTED_PREFIXES if prefixes is None else prefixes)]
    return spark.createDataFrame(rows, "kind string, entry string")


def prefix_keys(ip: Column) -> Column:
    """An address and its one, two and three octet prefixes, the keys a listed entry can equal."""
    return F.array(*[_octets(ip, n) for n in (1, 2, 3)], ip)


def _octets(ip: Column, n: int) -> Column:
    """The first ``n`` octets with their dots, NULL for text without that many dots."""
    head = F.substring_index(ip, ".", n)
    return F.when(head != ip, F.concat(head, F.lit(".")))


def drop_listed(flows: DataFrame, entries: DataFrame, column: str = "src_ip") -> DataFrame:
    """Anti joins against listed addresses and octet prefixes (ending in a dot).

    ``startswith`` becomes one equality per prefix length, so long lists need no nested loop; the lists are
    small tables and Spark broadcasts them by their measured size.
    """
    kept = flows.filter(F.col(column).isNotNull())
    listed = entries.select("entry").distinct()
    for n in (1, 2, 3):
        of_length = listed.filter(F.col("entry").endswith(".") & (F.size(F.split("entry", r"\.")) == n + 1))
        kept = kept.join(of_length, _octets(F.col(column), n) == F.col("entry"), "left_anti")
    exact = listed.filter(~F.col("entry").endswith("."))
    return kept.join(exact, F.col(column) == F.col("entry"), "left_anti")


def exclude_hosts(flows: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """Flows touching none of ``hosts`` at either end."""
    hosts = config.CAPTURE_EXCLUDED_IPS if hosts is None else hosts
    return flows.filter(~F.coalesce(F.col("src_ip").isin(hosts), F.lit(False))
                        & ~F.coalesce(F.col("dst_ip").isin(hosts), F.lit(False)))


def drop_whitelisted(flows: DataFrame, whitelist: DataFrame, column: str = "src_ip") -> DataFrame:
    return flows.join(whitelist.select(F.col("ip").alias(column)).distinct(), column, "left_anti")


def override_blacklisted(scored: DataFrame, blacklist: DataFrame, column: str = "src_ip") -> DataFrame:
    """Listed sources are attackers with full confidence, whatever their score."""
    listed = blacklist.select(F.col("ip").alias(column)).distinct().withColumn("_listed", F.lit(True))
    return (
        scored.join(listed, column, "left")
        .withColumn("prediction", F.when(F.col("_listed"), F.lit("DDoS")).otherwise(F.col("prediction")))
        .withColumn("confidence", F.when(F.col("_listed"), F.lit(1.0)).otherwise(F.col("confidence")))
        .drop("_listed")
    )
