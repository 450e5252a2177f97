"""Alert suppression: cooldowns, the notifier's gate and its summaries, request limits."""

from __future__ import annotations

import json
import zlib
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.operators.folds import fold
from rillwatch.operators.windows import SECOND, micros


def cooldown_step(gap_us: int):
    """Keep a row if the last kept one is at least ``gap_us`` back; jumps from kept row to kept row."""

    def step(state, rows, next_block):
        at = rows["us"].to_numpy()
        last = None if state is None else int(state)
        i = 0 if last is None else int(np.searchsorted(at, last + gap_us, "left"))
        kept = []
        while i < len(at):
            kept.append(i)
            last = int(at[i])
            i = int(np.searchsorted(at, last + gap_us, "left"))
        matters = last is not None and last + gap_us > next_block
        return (str(last) if matters else None), rows.iloc[kept][["us", "alert_id"]].reset_index(drop=True)

    return step


def cooldown(alerts: DataFrame, key: str, seconds: float, ts: str = "alert_ts", block_seconds: int = 3600) -> DataFrame:
    """Alerts that pass a cooldown per ``key``, counted from the last alert that passed."""
    cells = alerts.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key), micros(ts).alias("us")).agg(F.min("alert_id").alias("alert_id"))
    return fold(cells, [key], ["us"], cooldown_step(int(seconds * SECOND)), "us long, alert_id string", block_seconds * SECOND)


# notifier ----------------------------------------------------------------------------------------------------

class Gate:
    """What the notifier remembers: recent sends, last send per rule, sent ids, end of its cooldown (microseconds)."""

    def __init__(self, state: dict | None, critical_bypass: bool):
        s = state or {}
        self.sent = s.get("sent", [])
        self.by_rule = s.get("rules", {})
        self.ids = s.get("ids", {})  # sent ids, each with the time up to which it can come again, None: for ever
        self.until = s.get("until")
        self.bypass = critical_bypass

    def dump(self, now: int) -> dict:
        """What still matters from ``now`` on."""
        return {
            "sent": [t for t in self.sent if t > now - config.NOTIFY_WINDOW * SECOND],
            "rules": {r: t for r, t in self.by_rule.items() if now - t < config.NOTIFY_MIN_INTERVAL * SECOND},
            "ids": {i: t for i, t in self.ids.items() if t is None or t >= now},
            "until": self.until if self.until is not None and now < self.until else None,
        }

    def decide(self, now: int, rule: str, alert_id: str, severity: str, comes_until: int | None = None) -> tuple[bool, str]:
        if alert_id in self.ids:
            return False, "duplicate"
        critical = severity.upper() == "CRITICAL"
        if not (self.bypass and critical):
            if self.until is not None:
                if now < self.until:
                    return False, "cooldown"
                self.until = None
            self.sent = [t for t in self.sent if t > now - config.NOTIFY_WINDOW * SECOND]
            if len(self.sent) >= config.NOTIFY_MAX:
                self.until = now + config.NOTIFY_COOLDOWN * SECOND
                return False, "rate_limit"
            last = self.by_rule.get(rule)
            if last is not None and now - last < config.NOTIFY_MIN_INTERVAL * SECOND:
                return False, f"min_interval_{rule}"
        self.sent.append(now)
        self.by_rule[rule] = now
        self.ids[alert_id] = comes_until
        return True, "critical" if critical else "ok"


class Summary:
    """Buffer of suppressed alerts and when it is flushed."""

    def __init__(self, state: dict | None):
        s = state or {}
        self.pending = s.get("pending", {})
        self.last = s.get("last")
        self.checked = s.get("checked")
        self.flushed = []

    def dump(self) -> dict:
        return {"pending": self.pending, "last": self.last, "checked": self.checked}

    def _due(self, now: int) -> bool:
        n = sum(self.pending.values())
        return n >= config.SUMMARY_SIZE or bool(n and self.last is not None and now - self.last >= config.SUMMARY_AFTER * SECOND)

    def _flush(self, now: int) -> None:
        self.flushed.append((now, sum(self.pending.values()), json.dumps(self.pending, sort_keys=True)))
        self.pending, self.last = {}, now

    def after(self, now: int, severity: str, suppressed: int) -> None:
        """Note ``suppressed`` alerts of one instant (0 for a sent one), then the half-minute check."""
        if self.checked is None:
            self.checked = now
        for _ in range(suppressed):
            self.pending[severity] = self.pending.get(severity, 0) + 1
            if self._due(now):
                self._flush(now)
        if now - self.checked >= config.SUMMARY_CHECK * SECOND:
            if self._due(now):
                self._flush(now)
            self.checked = now


def _gate_cells(alerts: DataFrame, tick_us: int, channel: str | None) -> DataFrame:
    """Alerts alike in channel, clock tick, rule, id and severity become one row with their number, and the id's last tick."""
    chat = F.col(channel) if channel else F.lit("chat")
    tick = F.floor(micros("alert_ts") / F.lit(tick_us)).cast("long")
    cells = alerts.groupBy(
        chat.alias("channel"), tick.alias("tick"), F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"),
        F.coalesce("alert_id", F.lit("unknown")).alias("alert_id"), F.coalesce("severity", F.lit("unknown")).alias("severity"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min(micros("alert_ts")).alias("first_us"))
    last = cells.groupBy("channel", "alert_id").agg(F.max("tick").alias("last_tick"))
    return cells.join(last, ["channel", "alert_id"])


_GATE_ORDER = ["tick", "first_us", "alert_id", "severity"]


def gate_step(tick_us: int, critical_bypass: bool, summaries: bool):
    def step(state, rows, next_block):
        saved = json.loads(state) if state else {}
        gate = Gate(saved.get("gate"), critical_bypass)
        summary = Summary(saved.get("summary")) if summaries else None
        decided = []
        # a stream does not know when an id comes last, a table does: the state then holds only ids that come again
        until = [int(t) * tick_us for t in rows["last_tick"]] if "last_tick" in rows else [None] * len(rows)
        for (tick, rule, alert_id, severity, n), last in zip(rows[["tick", "rule_id", "alert_id", "severity", "n"]].itertuples(index=False), until):
            now, left = int(tick) * tick_us, int(n)
            while left:
                send, reason = gate.decide(now, rule, alert_id, severity, last)
                # the first of a cell may be sent or start a cooldown; the rest all meet the same answer
                take = 1 if send or reason == "rate_limit" else left
                decided.append((tick, rule, alert_id, severity, send, reason, take))
                if summaries:
                    summary.after(now, severity, 0 if send else take)
                left -= take
        kept = {"gate": gate.dump(next_block * tick_us)}
        out = json.dumps(kept | {"summary": summary.dump()}, sort_keys=True) if summaries else None
        if not summaries and any(kept["gate"].values()):  # a gate that remembers nothing is a fresh one
            out = json.dumps(kept, sort_keys=True)
        if summaries:
            frame = pd.DataFrame(summary.flushed, columns=["at_us", "alerts", "severities"])
        else:
            frame = pd.DataFrame(decided, columns=["tick", "rule_id", "alert_id", "severity", "sent", "reason", "n"])
        return out, frame

    return step


def notify_gate(alerts: DataFrame, tick_us: int = SECOND, critical_bypass: bool = False, channel: str | None = None,
                block_seconds: int = 86400) -> DataFrame:
    """What the notifier does with every alert: sent or not, why, and how many alike.

    The gate's clock ticks in whole seconds, like the times in alert ids; alerts alike within a tick are counted
    together first, so a channel has at most (rules x severities x seconds) rows however many alerts arrive.
    ``tick_us=1`` gives the microsecond clock. Checks run duplicate, cooldown, rate limit, interval per rule;
    critical alerts pass the last three only with ``critical_bypass``.
    """
    return fold(_gate_cells(alerts, tick_us, channel), ["channel"], _GATE_ORDER, gate_step(tick_us, critical_bypass, False),
                "tick long, rule_id string, alert_id string, severity string, sent boolean, reason string, n long",
                block_seconds * SECOND // tick_us)


def notify_summaries(alerts: DataFrame, tick_us: int = SECOND, critical_bypass: bool = False, channel: str | None = None,
                     block_seconds: int = 86400) -> DataFrame:
    """Summaries of suppressed alerts: when, how many, and how many of each severity (JSON)."""
    return fold(_gate_cells(alerts, tick_us, channel), ["channel"], _GATE_ORDER, gate_step(tick_us, critical_bypass, True),
                "at_us long, alerts long, severities string", block_seconds * SECOND // tick_us)


# request limits ----------------------------------------------------------------------------------------------

def bucket_step(zones: dict[str, tuple[int, int]]):
    """Leaky bucket in thousandths of a request on a millisecond clock; a rejected request changes nothing."""

    def step(state, rows, next_block):
        rate, burst = zones[rows["zone"].iloc[0]]
        limit = burst * 1000
        excess, last = json.loads(state) if state else (None, None)
        accepted = []
        for ms, n in zip(rows["ms"].tolist(), rows["n"].tolist()):
            level = 0 if excess is None else max(excess - rate * (ms - last) + 1000, 0)
            if level > limit:
                accepted.append(0)
                continue
            ok = 1 + min(n - 1, (limit - level) // 1000)
            excess, last = level + (ok - 1) * 1000, ms
            accepted.append(ok)
        out = rows[["ms", "n"]].reset_index(drop=True)
        out["accepted"] = accepted
        # a bucket that is empty again by the next block is as good as new
        drained = excess is None or excess - rate * (next_block - last) + 1000 <= 0
        return (None if drained else json.dumps([excess, last])), out

    return step


#: a bucket with more states than this has its blocks folded in rounds
MOST_STATES = 1 << 16


def _states(rate: int, burst: int) -> tuple[int, int]:
    """Room of an empty bucket, in thousandths of a request, and the step in which room changes.

    Requests take whole thousands of it and time gives multiples of the rate, so room is always a multiple of the step.
    """
    return (burst + 1) * 1000, gcd(rate, 1000)


def bucket_effect(zones: dict[str, tuple[int, int]]):
    """The room left at a block's end for every room there may be at its begin.

    ``n`` requests leave ``max(room - 1000 * n, room % 1000)``. Begins that come to the same room are one from there on, so
    soon at most a thousand differ, and one alone once the bucket has been empty for all of them.
    """

    def effect(rows, start, next_block):
        rate, burst = zones[rows["zone"].iloc[0]]
        room, unit = _states(rate, burst)
        left = np.arange(0, room + 1, unit, dtype=np.int64)
        where, at, due = np.arange(len(left)), start, 1
        for i, (ms, n) in enumerate(zip(rows["ms"].tolist(), rows["n"].tolist()), 1):
            if len(left) > 1:
                left = np.minimum(left + rate * (ms - at), room)
                left = np.maximum(left - 1000 * n, left % 1000)
                if i == due:
                    left, same = np.unique(left, return_inverse=True)
                    where, due = same[where], due + min(due, 64)
                    one = int(left[0])
            else:
                one = min(one + rate * (ms - at), room)
                one = max(one - 1000 * n, one % 1000)
            at = ms
        if len(left) == 1:
            left = np.array([one], dtype=np.int64)
        ends = np.minimum(left + rate * (next_block - at), room)[where]
        return zlib.compress(np.diff(ends, prepend=0).astype("<i8").tobytes())

    return effect


def bucket_follow(zones: dict[str, tuple[int, int]]):
    def follow(name, state, effect, start, next_block):
        rate, burst = zones[name[-1]]
        room, unit = _states(rate, burst)
        left = room
        if state:
            excess, last = json.loads(state)
            left = min(burst * 1000 - excess + rate * (start - last), room)
        left = int(np.cumsum(np.frombuffer(zlib.decompress(effect), "<i8"))[left // unit])
        return None if left == room else json.dumps([burst * 1000 - left, next_block])

    return follow


def replay_rate_limit(requests: DataFrame, zones: dict[str, tuple[int, int]] | None = None, ts: str = "req_ts",
                      block_seconds: int = 600) -> DataFrame:
    """Accepted and rejected requests per (ip, zone, millisecond).

    Requests of one address and zone in the same millisecond are counted together, which the bucket's own clock
    allows; a block of ten minutes then has at most 600,000 rows per address and zone. A bucket that never runs empty carries
    its state through all blocks, so blocks are composed by their effects on every room, whatever the load.
    """
    zones = config.RATE_ZONES if zones is None else zones
    cells = requests.filter(F.col("zone").isNotNull()).groupBy(
        "ip", "zone", F.floor(micros(ts) / F.lit(1000)).cast("long").alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    few = all(room // unit <= MOST_STATES for room, unit in (_states(*z) for z in zones.values()))
    out = fold(cells, ["ip", "zone"], ["ms"], bucket_step(zones), "ms long, n long, accepted long", block_seconds * 1000,
               (bucket_effect(zones), bucket_follow(zones)) if few else None)
    return out.withColumn("rejected", F.col("n") - F.col("accepted"))
