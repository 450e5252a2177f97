"""Engineered flow features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.operators.clean import first_existing, to_number

DERIVED = [
    "total_packets", "total_fwd_bytes", "total_bwd_bytes", "total_bytes", "flow_duration", "packet_rate", "byte_rate",
    "mean_packet_size", "fwd_ratio", "iat_range", "log_packet_rate", "log_byte_rate", "log_total_bytes",
    "log_total_packets",
]


def add_derived_features(flows: DataFrame) -> DataFrame:
    """Totals, rates, mean size, forward share, inter-arrival range and their logs.

    A flow without a duration column lasts 1; a duration below 0 counts as 0 plus a tiny epsilon.
    """
    fwd = first_existing(flows, config.FWD_PACKET_NAMES).cast("double")
    bwd = first_existing(flows, config.BWD_PACKET_NAMES).cast("double")
    has = set(flows.columns)
    lasts = (
        F.greatest(to_number(F.col("flow_duration")), F.lit(0.0)) + F.lit(1e-6) if "flow_duration" in has else F.lit(1.0)
    )
    gap = (
        F.greatest(to_number(F.col("flow_iat_max")) - to_number(F.col("flow_iat_min")), F.lit(0.0))
        if {"flow_iat_max", "flow_iat_min"} <= has else F.lit(0.0)
    )
    out = flows.withColumns({
        "total_packets": fwd + bwd,
        "total_fwd_bytes": first_existing(flows, config.FWD_BYTES_NAMES).cast("double"),
        "total_bwd_bytes": first_existing(flows, config.BWD_BYTES_NAMES).cast("double"),
        "flow_duration": lasts,
        "iat_range": gap,
        "_fwd": fwd,
    })
    out = out.withColumn("total_bytes", F.col("total_fwd_bytes") + F.col("total_bwd_bytes"))
    packets = F.nullif(F.col("total_packets"), F.lit(0.0))
    out = out.withColumns({
        "packet_rate": F.col("total_packets") / F.col("flow_duration"),
        "byte_rate": F.col("total_bytes") / F.col("flow_duration"),
        "mean_packet_size": F.coalesce(F.col("total_bytes") / packets, F.lit(0.0)),
        "fwd_ratio": F.coalesce(F.col("_fwd") / packets, F.lit(0.0)),
    })
    return out.withColumns({
        f"log_{n}": F.log1p(F.greatest(F.col(n), F.lit(0.0)))
        for n in ("packet_rate", "byte_rate", "total_bytes", "total_packets")
    }).drop("_fwd")


def add_lineage(df: DataFrame) -> DataFrame:
    """File a row came from and when it was read."""
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "processed_at": F.current_timestamp()})
