"""Suppression and address state over streams, with the same steps as the batch operators.

State per key is small and fixed (a time, the gate's memory, one address record). Rows of a micro-batch arrive
in no order, so each handler sorts its own by event time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillwatch import config
from rillwatch.operators import scoring
from rillwatch.operators.ipstate import AddressState, duration_us
from rillwatch.operators.suppress import cooldown_step, gate_step
from rillwatch.operators.windows import SECOND, micros

FOREVER = 1 << 62


class _Kept(StatefulProcessor):
    """One text value of state per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "text string")

    def load(self) -> str | None:
        return self.kept.get()[0] if self.kept.exists() else None

    def save(self, text: str | None) -> None:
        if text is not None:
            self.kept.update((text,))

    def close(self) -> None:
        pass


class CooldownProcessor(_Kept):
    def __init__(self, gap_us: int):
        self.step = cooldown_step(gap_us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "alert_id"]).reset_index(drop=True)
        state, kept = self.step(self.load(), batch, -FOREVER)
        self.save(state)
        kept.insert(0, "key", key[0])
        yield kept


def stream_cooldown(alerts: DataFrame, key: str, seconds: float, ts: str = "alert_ts") -> DataFrame:
    """Alerts that pass the cooldown per key: key, time and id."""
    rows = alerts.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key"), micros(ts).alias("us"), "alert_id")
    return rows.groupBy("key").transformWithStateInPandas(
        CooldownProcessor(int(seconds * SECOND)), "key string, us long, alert_id string", "Append", "None")


class GateProcessor(_Kept):
    def __init__(self, tick_us: int, critical_bypass: bool):
        self.step = gate_step(tick_us, critical_bypass, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["tick", "first_us", "alert_id", "severity"])
        state, decided = self.step(self.load(), batch, -FOREVER)
        self.save(state)
        decided.insert(0, "channel", key[0])
        yield decided


def stream_notify_gate(alerts: DataFrame, tick_us: int = SECOND, critical_bypass: bool = False, channel: str = "chat") -> DataFrame:
    rows = alerts.select(
        F.lit(channel).alias("channel"), F.floor(micros("alert_ts") / F.lit(tick_us)).cast("long").alias("tick"),
        F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"), "alert_id", F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.lit(1).cast("long").alias("n"), micros("alert_ts").alias("first_us"))
    return rows.groupBy("channel").transformWithStateInPandas(
        GateProcessor(tick_us, critical_bypass),
        "channel string, tick long, rule_id string, alert_id string, severity string, sent boolean, reason string, n long", "Append", "None")


_STATE = "ip string, seq int, status string, alert_count long, flow_count long, expires_us long, duration_us long, whitelisted boolean"


class AddressProcessor(_Kept):
    """One address: its record and whether it is whitelisted, and with ``timers`` one event-time timer at the record's end.

    Without timers an overdue record goes at the address's next event only; with them it goes once the watermark has
    passed its end, and an address that is not whitelisted leaves no state behind.
    """

    def __init__(self, ttl_us: int, timers: bool = False):
        self.ttl, self.timers = ttl_us, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def _state(self) -> AddressState:
        state, text = AddressState(self.ttl), self.load()
        if text:
            state.row, state.whitelisted = json.loads(text)
        return state

    def _keep(self, ip: str, seq: int, state: AddressState) -> pd.DataFrame:
        row = state.row or {}
        if self.timers and not row and not state.whitelisted:
            self.kept.clear()
        else:
            self.save(json.dumps([state.row, state.whitelisted]))
        if self.timers:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if row.get("expires_us") is not None:
                self.handle.registerTimer(-(-row["expires_us"] // 1000))
        out = pd.DataFrame({"ip": [ip], "seq": [seq], "status": [row.get("status")], "alert_count": [row.get("alert_count", 0)], "flow_count": [row.get("flow_count", 0)],
                            "expires_us": [row.get("expires_us")], "duration_us": [row.get("duration_us")], "whitelisted": [state.whitelisted]})
        return out.astype({"expires_us": "Int64", "duration_us": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        for e in pd.concat(list(rows)).sort_values(["us", "kind", "alert_id", "action", "duration_us"]).to_dict("records"):
            if e["kind"] == 0:
                state.seen({"first_us": int(e["us"]), "last_us": int(e["us"]), "n": 1, "flow_count": int(e["flow_count"]),
                            "rank": int(e["rank"]), "attack_type": e["attack_type"], "confidence": e["confidence"]})
            else:
                state.act(int(e["us"]), e["action"], None if pd.isna(e["duration_us"]) else int(e["duration_us"]))
        yield self._keep(key[0], 0, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._state()
        if state.row and state.row["expires_us"] is not None and state.row["expires_us"] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            state.row = None
            yield self._keep(key[0], 1, state)


def address_events(alerts: DataFrame, actions: DataFrame, attack_type: str = "rule_name", confidence: str = "suspicious_ratio") -> DataFrame:
    """Alerts (per address) and administrator actions in one stream of events."""
    seen = alerts.withColumn("ip", F.explode("attacker_ips")).select(
        "ip", micros("alert_ts").alias("us"), F.lit(0).alias("kind"), "alert_id", F.lit("").alias("action"), "flow_count",
        scoring.severity_rank(F.col("severity")).alias("rank"), F.col(attack_type).alias("attack_type"), F.col(confidence).alias("confidence"),
        F.lit(None).cast("long").alias("duration_us"), F.col("alert_ts").alias("event_ts"))
    acts = actions.select(
        "ip", micros("action_ts").alias("us"), F.lit(1).alias("kind"), F.lit("").alias("alert_id"), "action", F.lit(0).cast("long").alias("flow_count"),
        F.lit(0).alias("rank"), F.lit("").alias("attack_type"), F.lit(0.0).alias("confidence"), duration_us(actions).alias("duration_us"),
        F.col("action_ts").alias("event_ts"))
    return seen.unionByName(acts)


def stream_address_states(events: DataFrame, block_seconds: int = config.BLOCK_SECONDS, delay: str | None = None) -> DataFrame:
    """The new state of every address that had events in the micro-batch (``seq`` 0) or whose record ended (``seq`` 1).

    With ``delay`` the events have a watermark that far behind the newest: later ones are dropped, and records end by
    timers when it passes their end, also without any further event of the address.
    """
    timers = delay is not None
    rows = events.withWatermark("event_ts", delay) if timers else events
    return rows.groupBy("ip").transformWithStateInPandas(
        AddressProcessor(block_seconds * SECOND, timers), _STATE, "Update", "EventTime" if timers else "None")
