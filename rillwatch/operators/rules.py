"""Detection rules compiled to Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwatch import config
from rillwatch.functions.compare import compare

_MATCH_FIELDS = ["rule_id", "rule_name", "severity", "description", "action", "matched_conditions"]


def _condition_text(rule: dict, name_key: str) -> list[str]:
    return [f"{c[name_key]} {c['operator']} {c['value']}" for c in rule["conditions"]]


def _match(rule: dict, name_key: str) -> Column:
    return F.struct(
        F.lit(rule["id"]).alias("rule_id"),
        F.lit(rule["name"]).alias("rule_name"),
        F.lit(rule["severity"]).alias("severity"),
        F.lit(rule["description"]).alias("description"),
        F.lit(rule["action"]).alias("action"),
        F.array(*map(F.lit, _condition_text(rule, name_key))).alias("matched_conditions"),
    )


def _holds(df: DataFrame, rule: dict, name_key: str, absent_is_zero: bool) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in rule["conditions"]:
        name = c[name_key]
        if name in types:
            actual, dtype = F.col(name), types[name]
            if absent_is_zero:
                actual = F.coalesce(actual, F.lit(0).cast(dtype))
            part = compare(actual, dtype, c["operator"], c["value"])
            parts.append(part & actual.isNotNull())
        elif absent_is_zero:
            parts.append(compare(F.lit(0), T.IntegerType(), c["operator"], c["value"]))
        else:
            parts.append(F.lit(False))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def per_flow_match(flows: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Adds struct ``match``: the first enabled rule whose conditions all hold, else NULL."""
    rules = config.enabled_rules(config.PER_FLOW_RULES if rules is None else rules)
    if not rules:
        fields = [f"{f}:{'array<string>' if f == 'matched_conditions' else 'string'}" for f in _MATCH_FIELDS]
        return flows.withColumn("match", F.lit(None).cast(f"struct<{','.join(fields)}>"))
    first = F.coalesce(*[F.when(_holds(flows, r, "field", False), _match(r, "field")) for r in rules])
    return flows.withColumn("match", first)


def split_by_rules(flows: DataFrame, rules: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(matched flows with their rule, unmatched flows): the two branches of the detector."""
    tagged = per_flow_match(flows, rules)
    return tagged.filter(F.col("match").isNotNull()), tagged.filter(F.col("match").isNull()).drop("match")


def window_matches(stats: DataFrame, rules: list[dict] | None = None, window: str | None = None) -> DataFrame:
    """One row per window row and matching rule, with all columns of ``stats``.

    With ``window`` (such as ``"60s"``) only rules written for that window are tried, without it all are.
    A metric that ``stats`` lacks counts as 0.
    """
    rules = config.enabled_rules(config.AGGREGATION_RULES if rules is None else rules)
    rules = [r for r in rules if window is None or r.get("window") == window]
    tried = F.array(*[F.when(_holds(stats, r, "metric", True), _match(r, "metric")) for r in rules])
    return stats.withColumn("_m", F.explode(F.filter(tried, lambda m: m.isNotNull()))).select(
        *stats.columns, *[F.col(f"_m.{f}") for f in _MATCH_FIELDS]
    )


def rules_table(spark, rules: list[dict], name_key: str) -> DataFrame:
    """Enabled rules as rows with their conditions as an array of structs."""
    rows = [
        (r["id"], r["name"], r["severity"], r.get("window"), r["action"],
         [(c[name_key], c["operator"], float(c["value"])) for c in r["conditions"]])
        for r in config.enabled_rules(rules)
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, rule_name string, severity string, window string, action string, "
        "conditions array<struct<field:string,operator:string,value:double>>",
    )


def match_rule_rows(stats: DataFrame, metrics: list[str], rules: list[dict]) -> DataFrame:
    """Data-driven form: rules travel as one literal array and are checked against a map of the metrics.

    No cross join: each window row filters the (small, configured) rule array in place.
    """
    values = F.create_map(*[x for m in metrics for x in (F.lit(m), F.coalesce(F.col(m).cast("double"), F.lit(0.0)))])
    table = F.array(*[
        F.struct(
            F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"),
            F.array(*[
                F.struct(F.lit(c["metric"]).alias("metric"), F.lit(c["operator"]).alias("operator"),
                         F.lit(float(c["value"])).alias("value"))
                for c in r["conditions"]
            ]).alias("conditions"),
        )
        for r in config.enabled_rules(rules)
    ])

    def holds(c: Column) -> Column:
        actual = F.coalesce(F.element_at(F.col("_values"), c["metric"]), F.lit(0.0))
        return (
            F.when(c["operator"] == "gt", actual > c["value"])
            .when(c["operator"] == "gte", actual >= c["value"])
            .when(c["operator"] == "lt", actual < c["value"])
            .when(c["operator"] == "lte", actual <= c["value"])
            .when(c["operator"] == "eq", actual == c["value"])
            .when(c["operator"] == "ne", actual != c["value"])
            .otherwise(F.lit(False))
        )

    hit = F.filter(table, lambda r: F.forall(r["conditions"], holds))
    return stats.withColumn("_values", values).withColumn("_rule", F.explode(hit)).select(
        *stats.columns, F.col("_rule.rule_id").alias("rule_id"), F.col("_rule.severity").alias("severity")
    )
