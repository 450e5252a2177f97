"""State per attacker address: alerts raise it, administrators approve, reject or unblock it, blocks expire."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.operators import scoring
from rillwatch.operators.alerts import per_attacker
from rillwatch.operators.windows import SECOND, micros
from rillwatch.session import cut_lineage

RUN_SECONDS = 60
_ALERT, _CUT = 0, 1

STATE_SCHEMA = (
    "ip string, status string, severity string, attack_type string, confidence double, flow_count long, "
    "alert_count long, first_us long, last_us long, expires_us long, duration_us long, whitelisted boolean, recheck_us long"
)


class AddressState:
    """One address. ``seen`` and ``act`` are the two events; both first let an overdue record expire."""

    def __init__(self, ttl_us: int):
        self.ttl, self.row, self.whitelisted = ttl_us, None, False

    def _expire(self, now: int) -> None:
        if self.row and self.row["expires_us"] is not None and now >= self.row["expires_us"]:
            self.row = None

    def seen(self, run: dict) -> int | None:
        """A run of alerts with nothing else between. Returns a time at which the run must be cut, if any."""
        if self.whitelisted:
            self._expire(run["last_us"])
            return None
        self._expire(run["first_us"])
        row = self.row
        if row is None:
            self.row = {"status": "pending", "rank": run["rank"], "attack_type": run["attack_type"],
                        "confidence": run["confidence"], "flow_count": run["flow_count"], "alert_count": run["n"],
                        "first_us": run["first_us"], "last_us": run["last_us"], "expires_us": None, "duration_us": self.ttl}
            return None
        # a record that is no longer blocked keeps its old expiry, which may fall inside the run
        due = row["expires_us"]
        if row["status"] != "blocked" and due is not None and run["first_us"] < due <= run["last_us"]:
            return due
        row["alert_count"] += run["n"]
        row["flow_count"] += run["flow_count"]
        row["rank"] = max(row["rank"], run["rank"])
        row["last_us"] = run["last_us"]
        if row["status"] == "blocked" and row["duration_us"] > 0:
            row["expires_us"] = run["last_us"] + row["duration_us"]
        return None

    def act(self, now: int, action: str, duration_us: int | None = None) -> None:
        """An administrator's action; an approval may have a duration of its own, one of 0 sets no end."""
        self._expire(now)
        if self.row is None:
            return
        if action == "approve":
            duration_us = self.ttl if duration_us is None else duration_us
            self.row.update(status="blocked", duration_us=duration_us)
            if duration_us > 0:
                self.row["expires_us"] = now + duration_us
        elif action == "reject":
            self.row["status"] = "whitelisted"
            self.whitelisted = True
        elif action == "unblock":
            self.row["status"] = "unblocked"


def _runs(alerts: DataFrame, cuts: DataFrame) -> DataFrame:
    """Alerts per address merged into runs: same minute, no cut (administrator action) between."""
    minute = lambda c: F.floor(F.col(c) / F.lit(RUN_SECONDS * SECOND)).cast("long")
    empty = {"alert_id": "string", "rank": "int", "flow_count": "long", "attack_type": "string", "confidence": "double"}
    marks = cuts.select("ip", F.col("cut_us").alias("us"), F.lit(_CUT).alias("kind"),
                        *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    both = alerts.select("ip", "us", F.lit(_ALERT).alias("kind"), *empty).unionByName(marks).withColumn("minute", minute("us"))
    order = Window.partitionBy("ip", "minute").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = both.withColumn("part", F.sum("kind").over(order)).filter(F.col("kind") == _ALERT)
    first = F.struct("us", "alert_id")
    return numbered.groupBy("ip", "minute", "part").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"),
        F.sum("flow_count").alias("flow_count"), F.max("rank").alias("rank"),
        F.min_by("attack_type", first).alias("attack_type"), F.min_by("confidence", first).alias("confidence"),
    ).drop("minute", "part")


def _fold(ttl_us: int):
    def run(key: tuple, events: pd.DataFrame) -> pd.DataFrame:
        state, recheck = AddressState(ttl_us), None
        for e in events.sort_values(["first_us", "kind", "action", "duration_us"]).to_dict("records"):
            if e["kind"] == _ALERT:
                recheck = state.seen(e)
                if recheck is not None:
                    break
            else:
                own = e["duration_us"]
                state.act(int(e["first_us"]), e["action"], None if pd.isna(own) else int(own))
        row = state.row or {}
        names = ["attack_type", "confidence", "flow_count", "alert_count", "first_us", "last_us", "expires_us", "duration_us"]
        rank = row.get("rank")
        severity = {v: k for k, v in config.SEVERITY_RANK.items()}.get(rank, "unknown") if row else None
        values = [key[0], row.get("status"), severity, *[row.get(n) for n in names], state.whitelisted, recheck]
        columns = ["ip", "status", "severity", *names, "whitelisted", "recheck_us"]
        out = pd.DataFrame([values], columns=columns)
        whole = ["flow_count", "alert_count", "first_us", "last_us", "expires_us", "duration_us", "recheck_us"]
        return out.astype({c: "Int64" for c in whole})

    return run


def address_states(alerts: DataFrame, actions: DataFrame, block_seconds: int = config.BLOCK_SECONDS,
                   attack_type: str = "rule_name", confidence: str = "suspicious_ratio") -> DataFrame:
    """Final state per address after all alerts and administrator actions, in time order (alerts first on ties).

    Blocks last ``block_seconds``, or the ``duration`` (seconds) of their approval where ``actions`` has one, from the
    last save of a blocked record, so alerts extend them; a duration of 0 sets no end. A record that
    leaves the blocked state keeps its expiry. An expired record is forgotten, the whitelist is not. Alerts are
    merged to at most one run a minute between actions, so even an address with a third of all alerts is a short
    list of runs.
    """
    if block_seconds <= RUN_SECONDS:
        raise ValueError("blocks must outlast a run of alerts")
    own = duration_us(actions)
    facts = per_attacker(alerts).select(
        "ip", micros("alert_ts").alias("us"), "alert_id", scoring.severity_rank(F.col("severity")).alias("rank"),
        "flow_count", F.col(attack_type).alias("attack_type"), F.col(confidence).alias("confidence"))
    acts = actions.select("ip", micros("action_ts").alias("first_us"), "action", own.alias("duration_us")).distinct()
    # a block shorter than a run of alerts may end inside one: such addresses are cut at every alert
    short = acts.filter((F.col("duration_us") > 0) & (F.col("duration_us") <= RUN_SECONDS * SECOND)).select("ip").distinct()
    cuts = acts.select("ip", F.col("first_us").alias("cut_us")).unionByName(
        facts.join(short, "ip", "left_semi").select("ip", F.col("us").alias("cut_us")).distinct())
    while True:
        runs = _runs(facts, cuts).withColumn("kind", F.lit(_ALERT)).withColumns({
            "action": F.lit(None).cast("string"), "duration_us": F.lit(None).cast("long")})
        events = runs.unionByName(acts.withColumn("kind", F.lit(_CUT)), allowMissingColumns=True)
        states = cut_lineage(events.groupBy("ip").applyInPandas(_fold(block_seconds * SECOND), STATE_SCHEMA))
        late = states.filter(F.col("recheck_us").isNotNull()).select("ip", (F.col("recheck_us") - 1).alias("cut_us"))
        if late.isEmpty():
            return states.filter(F.col("status").isNotNull() | F.col("whitelisted")).drop("recheck_us")
        cuts = cut_lineage(cuts.unionByName(late))


def duration_us(actions: DataFrame):
    """The approvals' own durations in microseconds, NULL where they have none or the table has no such column."""
    if "duration" not in actions.columns:
        return F.lit(None).cast("long")
    return (F.col("duration").cast("double") * SECOND).cast("long")


def live(states: DataFrame, as_of_us) -> DataFrame:
    """Records that still exist at a time, with the seconds a block has left (0 for others)."""
    here = states.filter(F.col("status").isNotNull() & (F.col("expires_us").isNull() | (F.col("expires_us") > as_of_us)))
    left = F.floor((F.col("expires_us") - as_of_us) / F.lit(SECOND)).cast("long")
    return here.withColumn("ttl_seconds", F.when(F.col("status") == "blocked", F.greatest(left, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))


def pending(states: DataFrame) -> DataFrame:
    return states.filter("status = 'pending'").orderBy(F.desc("alert_count"), "ip")


def blocked(states: DataFrame) -> DataFrame:
    return states.filter("status = 'blocked'").orderBy(F.desc("last_us"), "ip")


def status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_sets(states: DataFrame) -> DataFrame:
    """Pending, blocked and whitelisted addresses in one list with their status."""
    one = lambda s: states.filter(F.col("status") == s).select("ip", F.lit(s).alias("block_status"))
    return one("pending").union(one("blocked")).union(one("whitelisted"))


def metadata_snapshot(states: DataFrame) -> DataFrame:
    """One metric row of value 1 per address, everything else as text labels."""
    text = lambda c: F.col(c).cast("string").alias(c)
    known = states.filter(F.col("status").isin("pending", "blocked", "whitelisted"))
    return known.select(
        "ip", "severity", "attack_type", F.col("status").alias("block_status"), text("confidence"), text("flow_count"),
        text("alert_count"), text("first_us"), text("last_us"),
        F.floor(F.col("duration_us") / SECOND).cast("string").alias("block_duration"), text("ttl_seconds"), F.lit(1.0).alias("value"))


def with_block_list(alerts_ips: DataFrame, states: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Alert rows per address without whitelisted ones, next to the address's current state."""
    kept = alerts_ips.join(whitelist.select("ip").distinct(), "ip", "left_anti")
    return kept.join(states.select("ip", F.col("status").alias("known_status"), F.col("severity").alias("known_severity")), "ip", "left")
