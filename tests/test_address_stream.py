"""Address state as a stream: timers, own durations, late events, restarts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rillwatch.operators import ipstate
from rillwatch.sources import sinks
from rillwatch.streaming import stateful

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERTS = "alert_id string, alert_ts timestamp, rule_name string, severity string, suspicious_ratio double, flow_count long, attacker_ips array<string>"
ACTIONS = "ip string, action string, action_ts timestamp, duration double"
EVENTS = ("ip string, us long, kind int, alert_id string, action string, flow_count long, rank int, attack_type string, confidence double, "
          "duration_us long, event_ts timestamp")


T0 = 1_700_000_000  # a watermark begins at 0: what happens then is late


def frames(spark, events):
    """Alerts (seconds, ip) and actions (seconds, ip, action, duration) as the two tables."""
    found = [(f"a{i}", T0 + float(e[0]), "r", "high", 0.5, 2, [e[1]]) for i, e in enumerate(events) if len(e) == 2]
    acts = [(e[1], e[2], T0 + float(e[0]), e[3]) for e in events if len(e) == 4]
    alerts = spark.createDataFrame(found, ALERTS.replace("alert_ts timestamp", "alert_ts double")).withColumn("alert_ts", F.timestamp_micros((F.col("alert_ts") * 1000000).cast("long")))
    actions = spark.createDataFrame(acts, ACTIONS.replace("action_ts timestamp", "action_ts double")).withColumn("action_ts", F.timestamp_micros((F.col("action_ts") * 1000000).cast("long")))
    return alerts, actions


def run(spark, where, delay, out="table", block_seconds=100):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    changes = stateful.stream_address_states(stream, block_seconds, delay)
    query = sinks.stream_table(changes, "ip", "seq", F.col("status").isNull(), f"{where}/{out}", f"{where}/{out}-check").trigger(availableNow=True).start()
    query.awaitTermination()
    table = sinks.latest_version(spark, f"{where}/{out}", changes.schema)
    return query, {r.ip: (r.status, r.alert_count, r.expires_us and r.expires_us // 1_000_000 - T0, r.duration_us // 1_000_000) for r in table.collect()}


def land(spark, where, *batches):
    for events in batches:
        alerts, actions = frames(spark, events)
        rows = stateful.address_events(alerts, actions)
        rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in EVENTS.split(", ")]).coalesce(1).write.mode("append").parquet(f"{where}/in")


def test_blocks_end_by_timer_and_state_shrinks(spark, tmp_path):
    where = str(tmp_path)
    land(spark, where,
         [(0, "a"), (0, "b"), (0, "c"), (0, "d"), (1, "a", "approve", None), (1, "b", "approve", 500.0), (1, "c", "approve", 0.0), (2, "d", "reject", None)],
         [(50, "a"), (60, "b")],       # alerts move the end of a block on, by its own duration
         [(400, "e"), (401, "d")],     # a's block ended at 150, without any event of a; d is whitelisted
         [(1500, "f")])                # b's ended at 560, c's never ends
    query, got = run(spark, where, "10 seconds")
    assert got == {"c": ("blocked", 1, None, 0), "d": ("whitelisted", 1, None, 100), "e": ("pending", 1, None, 100), "f": ("pending", 1, None, 100)}
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress) if p["stateOperators"]]
    assert max(sizes) > sizes[-1]
    steps = [{r.ip for r in spark.read.parquet(f"{where}/table/rows/version={v}").collect()} for v in range(len([d for d in os.listdir(f"{where}/table/rows") if "=" in d]))]
    assert any("a" in s for s in steps) and any("a" not in s and "b" in s for s in steps[1:])


def test_late_events_are_dropped(spark, tmp_path):
    where = str(tmp_path)
    # what is late is told by the watermark with which the micro-batch before began
    land(spark, where, [(0, "a"), (1000, "b")], [(999, "b")], [(5, "late"), (995, "in-time"), (1001, "c")])
    query, got = run(spark, where, "10 seconds")
    assert set(got) == {"a", "b", "in-time", "c"}
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress) if p["stateOperators"])
    assert dropped == 1


def test_killed_and_restarted(spark, tmp_path, monkeypatch):
    where = str(tmp_path)
    land(spark, where, [(0, "a"), (0, "b"), (1, "a", "approve", None)], [(50, "a"), (60, "b")], [(300, "c")], [(700, "d")])
    _, want = run(spark, where, "10 seconds")
    own, calls = sinks.upsert, []

    def dies(*a):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return own(*a)

    monkeypatch.setattr(sinks, "upsert", dies)
    with pytest.raises(Exception, match="killed"):
        run(spark, where, "10 seconds", "again")
    assert run(spark, where, "10 seconds", "again")[1] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_own_durations_in_batch_and_stream(spark, tmp_path, seed):
    """Against one plain fold per address; some blocks are shorter than the minute in which alerts are merged."""
    import random

    rng = random.Random(seed)
    events = sorted([(float(rng.randrange(2000)), rng.choice("abc")) for _ in range(120)]
                    + [(rng.randrange(2000) + 0.5, rng.choice("abc"), rng.choice(["approve", "approve", "unblock"]), rng.choice([None, 5.0, 30.0, 400.0, 0.0])) for _ in range(25)])
    want = {}
    for ip in "abc":
        s = ipstate.AddressState(100_000_000)
        for e in events:
            if e[1] == ip and len(e) == 2:
                s.seen({"first_us": int(e[0] * 1e6), "last_us": int(e[0] * 1e6), "n": 1, "flow_count": 2, "rank": 3, "attack_type": "r", "confidence": 0.5})
            elif e[1] == ip:
                s.act(int(e[0] * 1e6), e[2], None if e[3] is None else int(e[3] * 1e6))
        if s.row:
            want[ip] = (s.row["status"], s.row["alert_count"], s.row["expires_us"] and s.row["expires_us"] // 1_000_000, s.row["duration_us"] // 1_000_000)
    alerts, actions = frames(spark, events)
    got = {r.ip: (r.status, r.alert_count, r.expires_us and r.expires_us // 1_000_000 - T0, r.duration_us // 1_000_000)
           for r in ipstate.address_states(alerts, actions, block_seconds=100).filter("status IS NOT NULL").collect()}
    assert got == want
    land(spark, str(tmp_path), *[events[i:i + 50] for i in range(0, len(events), 50)])
    end = events[-1][0] - 10
    assert run(spark, str(tmp_path), "10 seconds")[1] == {ip: r for ip, r in want.items() if r[2] is None or r[2] > end}
    snapshot = {r.ip: r.block_duration for r in ipstate.metadata_snapshot(ipstate.live(ipstate.address_states(alerts, actions, block_seconds=100), F.lit(0))).collect()}
    assert snapshot == {ip: str(r[3]) for ip, r in want.items() if r[0] in ("pending", "blocked", "whitelisted")}
