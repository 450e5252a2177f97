"""From scores to labels, severities and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwatch import config


def label_scores(df: DataFrame, score: str = "score", threshold: float = config.SCORE_THRESHOLD) -> DataFrame:
    """Label and confidence of a score."""
    p = F.col(score)
    hit = p >= F.lit(threshold)
    return df.withColumns({
        "prediction": F.when(hit, "DDoS").otherwise("BENIGN"),
        "confidence": F.when(hit, p).otherwise(1 - p),
    })


def severity(suspicious: Column, ratio: Column, total: Column, ladder=None,
             min_flows: int = config.MIN_FLOWS_FOR_ANALYSIS) -> Column:
    """The first level whose two minimums are met; NULL below ``min_flows`` or with none met."""
    level = F.lit(None).cast("string")
    for name, flows, share in reversed(config.SEVERITY_LADDER if ladder is None else ladder):
        level = F.when((suspicious >= flows) & (ratio >= share), F.lit(name)).otherwise(level)
    return F.when(total >= min_flows, level)


def recommendation(level: Column, texts: dict[str, str] | None = None) -> Column:
    texts = config.RECOMMENDATIONS if texts is None else texts
    table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit(config.UNKNOWN_RECOMMENDATION))


def severity_rank(level: Column) -> Column:
    """1 low to 4 critical, 0 for anything else."""
    table = F.create_map(*[F.lit(x) for pair in config.SEVERITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit(0))


def severity_name(rank: Column) -> Column:
    name = F.lit("unknown")
    for level, r in config.SEVERITY_RANK.items():
        name = F.when(rank == r, F.lit(level)).otherwise(name)
    return name
