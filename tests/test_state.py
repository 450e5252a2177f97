"""Suppression, request limits and address state against plain one-by-one folds."""

import random

import pytest
from pyspark.sql import functions as F

from rillwatch import config
from rillwatch.operators import alerts, folds, ipstate, suppress

T0 = 1_704_067_200_000_000
SEC = 1_000_000


def alert_frame(spark, rows):
    """(seconds, rule, severity, id, ips, flows)"""
    df = spark.createDataFrame([(T0 + int(t * SEC), r, s, i, ips, n, r, 0.5) for t, r, s, i, ips, n in rows],
                               "us long, rule_id string, severity string, alert_id string, attacker_ips array<string>, flow_count long, rule_name string, suspicious_ratio double")
    return df.withColumn("alert_ts", F.timestamp_micros("us")).drop("us")


def random_alerts(seed, n, span, ips=("a", "b", "c")):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        t = round(r.uniform(0, span), 3)
        rule = r.choice(["hot", "hot", "hot", "x", "y"])
        rows.append((t, rule, r.choice(["low", "high", "critical"]), f"{rule}_{int(t)}", [r.choice(ips)], r.randrange(9)))
    return rows


def plain_cooldown(rows, gap):
    last, out = {}, set()
    for t, rule, _s, i, *_ in sorted(rows, key=lambda x: (x[0], x[3])):
        us = T0 + int(t * SEC)
        if rule not in last or us - last[rule] >= gap * SEC:
            last[rule] = us
            out.add((rule, us, i))
    return out


@pytest.mark.parametrize("block", [100, 3600, 1_000_000])
def test_cooldown_over_blocks(spark, block):
    rows = random_alerts(1, 600, 4000)
    got = suppress.cooldown(alert_frame(spark, rows), "rule_id", 60, block_seconds=block)
    assert {tuple(r) for r in got.collect()} == plain_cooldown(rows, 60)


def test_cooldown_strictly_periodic_alerts(spark):
    # the worst case: no block forgets its past, every block waits for the one before
    rows = [(t * 59, "r", "low", f"r_{t}", [], 0) for t in range(60)]
    got = suppress.cooldown(alert_frame(spark, rows), "rule_id", 60, block_seconds=300)
    assert {tuple(r) for r in got.collect()} == plain_cooldown(rows, 60)


def plain_gate(rows, tick_us, bypass=False):
    """The notifier one alert at a time; also returns its summaries."""
    sent, per_rule, seen, until = [], {}, set(), None
    pending, last_summary, checked = [], None, None
    out, summaries = [], []

    def due(now):
        return bool(pending) and (len(pending) >= 10 or (last_summary is not None and now - last_summary >= 180 * SEC))

    first = {}
    for t, rule, sev, i, *_ in rows:
        us = T0 + int(t * SEC)
        k = (us // tick_us, rule, i, sev)
        first[k] = min(first.get(k, us), us)
    order = sorted(rows, key=lambda x: (lambda us: (us // tick_us, first[(us // tick_us, x[1], x[3], x[2])], x[3], x[2], us))(T0 + int(x[0] * SEC)))
    for t, rule, sev, i, *_ in order:
        tick = (T0 + int(t * SEC)) // tick_us
        now = tick * tick_us
        if i in seen:
            reason, ok = "duplicate", False
        elif bypass and sev == "critical":
            reason, ok = "critical", True
        else:
            if until is not None and now >= until:
                until = None
            recent = [s for s in sent if s > now - 300 * SEC]
            if until is not None:
                reason, ok = "cooldown", False
            elif len(recent) >= 5:
                until = now + 600 * SEC
                reason, ok = "rate_limit", False
            elif rule in per_rule and now - per_rule[rule] < 60 * SEC:
                reason, ok = f"min_interval_{rule}", False
            else:
                reason, ok = ("critical" if sev == "critical" else "ok"), True
        out.append((tick, rule, i, sev, ok, reason))
        if checked is None:
            checked = now
        if ok:
            sent.append(now)
            per_rule[rule] = now
            seen.add(i)
        else:
            pending.append(sev)
            if due(now):
                summaries.append((now, len(pending)))
                pending, last_summary = [], now
        if now - checked >= 30 * SEC:
            if due(now):
                summaries.append((now, len(pending)))
                pending, last_summary = [], now
            checked = now
    return out, summaries


@pytest.mark.parametrize("tick,bypass,block", [(1, False, 86400), (SEC, False, 86400), (SEC, True, 86400), (SEC, False, 700), (1, True, 900)])
def test_notify_gate(spark, tick, bypass, block):
    rows = random_alerts(2, 400, 5000)
    frame = alert_frame(spark, rows)
    want, summaries = plain_gate(rows, tick, bypass)
    got = []
    for r in suppress.notify_gate(frame, tick, bypass, block_seconds=block).collect():
        got += [(r["tick"], r["rule_id"], r["alert_id"], r["severity"], r["sent"], r["reason"])] * r["n"]
    assert sorted(got) == sorted(want)
    flushed = suppress.notify_summaries(frame, tick, bypass, block_seconds=block).select("at_us", "alerts").collect()
    assert sorted(tuple(r) for r in flushed) == sorted(summaries)


def test_gate_reasons_in_order(spark):
    rows = [(0, f"r{k}", "critical", f"r{k}_0", [], 0) for k in range(5)] + [(1, "r0", "critical", "r0_0", [], 0), (2, "r9", "low", "r9_2", [], 0), (3, "r9", "critical", "r9_3", [], 0)]
    out = {r["alert_id"] + str(r["tick"] - T0 // SEC): r["reason"] for r in suppress.notify_gate(alert_frame(spark, rows)).collect()}
    assert out["r0_01"] == "duplicate" and out["r9_22"] == "rate_limit" and out["r9_33"] == "cooldown" and out["r4_00"] == "critical"


def plain_bucket(times_ms, rate, burst):
    excess = last = None
    accepted = 0
    for ms in times_ms:
        level = 0 if excess is None else max(excess - rate * (ms - last) + 1000, 0)
        if level <= burst * 1000:
            excess, last = level, ms
            accepted += 1
    return accepted


@pytest.mark.parametrize("block", [1, 7, 600])
def test_rate_limit_over_blocks(spark, block):
    r = random.Random(4)
    reqs = [("hot", "login", r.randrange(30_000)) for _ in range(900)] + [("b", "api", r.randrange(30_000)) for _ in range(200)]
    df = spark.createDataFrame([(ip, z, T0 + ms * 1000 + r.randrange(1000)) for ip, z, ms in reqs], "ip string, zone string, us long").withColumn("req_ts", F.timestamp_micros("us"))
    got = {(x["ip"], x["zone"]): (x["n"], x["a"]) for x in suppress.replay_rate_limit(df, block_seconds=block).groupBy("ip", "zone").agg(F.sum("n").alias("n"), F.sum("accepted").alias("a")).collect()}
    for ip, zone in (("hot", "login"), ("b", "api")):
        times = sorted(ms for i, z, ms in reqs if (i, z) == (ip, zone))
        assert got[(ip, zone)] == (len(times), plain_bucket(times, *config.RATE_ZONES[zone]))


def plain_cells(cells, rate, burst):
    excess, last, out = None, None, {}
    for ms, n in sorted(cells.items()):
        out[ms] = 0
        for _ in range(n):
            level = 0 if excess is None else max(excess - rate * (ms - last) + 1000, 0)
            if level <= burst * 1000:
                excess, last = level, ms
                out[ms] += 1
    return out


def test_rate_limit_without_rounds(spark, monkeypatch):
    """A bucket that never runs empty changes every block's start; the number of passes does not follow the number of blocks."""
    r = random.Random(9)
    zones = {"global": (50, 100), "login": (5, 10), "api": (30, 50), "odd": (7, 0), "shut": (0, 3)}
    reqs = {(ip, z): {} for ip in "ab" for z in zones}
    for (ip, z), cells in reqs.items():
        quiet = r.randrange(20_000, 30_000)  # in one half the bucket is full, the other has a pause in which it runs empty
        for _ in range(6000 if z == "global" else 700):
            ms = r.randrange(60_000)
            if ip == "a" or not quiet <= ms < quiet + 12_000:
                cells[ms] = cells.get(ms, 0) + r.choice([1, 1, 1, 4, 30])
    rows = [(ip, z, T0 + ms * 1000) for (ip, z), cells in reqs.items() for ms, n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "ip string, zone string, us long").withColumn("req_ts", F.timestamp_micros("us"))
    written = []
    monkeypatch.setattr(folds, "cut_lineage", lambda d, keep=folds.cut_lineage: written.append(1) or keep(d))
    out = suppress.replay_rate_limit(df, zones, block_seconds=1).collect()
    assert len(written) <= 2
    want = {(ip, z, T0 // 1000 + ms): (cells[ms], ok) for (ip, z), cells in reqs.items() for ms, ok in plain_cells(cells, *zones[z]).items()}
    assert {(x["ip"], x["zone"], x["ms"]): (x["n"], x["accepted"]) for x in out} == want


def plain_states(rows, actions, ttl):
    events = [(T0 + int(t * SEC), 0, i, (rule, sev, n), ip) for t, rule, sev, i, ips, n in rows for ip in ips]
    events += [(T0 + int(t * SEC), 1, a, None, ip) for t, ip, a in actions]
    state, white = {}, set()
    for us, kind, name, what, ip in sorted(events, key=lambda e: e[:3]):
        s = state.get(ip)
        if s and s["exp"] is not None and us >= s["exp"]:
            s = state[ip] = None
        if kind == 0:
            rule, sev, n = what
            if ip in white:
                continue
            rank = config.SEVERITY_RANK[sev]
            if s is None:
                state[ip] = {"st": "pending", "rank": rank, "type": rule, "n": 1, "flows": n, "exp": None}
            else:
                s["n"] += 1
                s["flows"] += n
                s["rank"] = max(s["rank"], rank)
                if s["st"] == "blocked":
                    s["exp"] = us + ttl * SEC
        elif s:
            if name == "approve":
                s.update(st="blocked", exp=us + ttl * SEC)
            elif name == "reject":
                s["st"] = "whitelisted"
                white.add(ip)
            else:
                s["st"] = "unblocked"
    return {ip: (s["st"], s["rank"], s["type"], s["n"], s["flows"], s["exp"]) for ip, s in state.items() if s}


@pytest.mark.parametrize("seed", range(4))
def test_address_states(spark, seed):
    r = random.Random(seed)
    rows = random_alerts(seed + 10, 700, 6000, ips=[f"ip{k}" for k in range(6)])
    actions = [(round(r.uniform(0, 6000), 3), f"ip{r.randrange(6)}", r.choice(["approve", "unblock", "approve", "unblock", "reject"] if seed else ["approve", "unblock"])) for _ in range(60)]
    acts = spark.createDataFrame([(ip, a, T0 + int(t * SEC)) for t, ip, a in actions], "ip string, action string, us long").withColumn("action_ts", F.timestamp_micros("us"))
    got = {x["ip"]: (x["status"], config.SEVERITY_RANK[x["severity"]], x["attack_type"], x["alert_count"], x["flow_count"], x["expires_us"])
           for x in ipstate.address_states(alert_frame(spark, rows), acts, block_seconds=70).filter("status IS NOT NULL").collect()}
    assert got == plain_states(rows, actions, 70)


def test_live_states_and_sets(spark):
    rows = [(0, "r", "low", "r_0", ["a", "b", "c", "d"], 1)]
    acts = spark.createDataFrame([("a", "approve", 5), ("b", "reject", 5), ("c", "unblock", 5), ("zz", "approve", 5)], "ip string, action string, s long").withColumn("action_ts", F.timestamp_micros(F.lit(T0) + F.col("s") * SEC))
    states = ipstate.address_states(alert_frame(spark, rows), acts)
    now = ipstate.live(states, F.lit(T0 + 15 * SEC))
    assert {(r["ip"], r["status"], r["ttl_seconds"]) for r in now.collect()} == {("a", "blocked", 3590), ("b", "whitelisted", 0), ("c", "unblocked", 0), ("d", "pending", 0)}
    assert {tuple(r) for r in ipstate.status_sets(now).collect()} == {("a", "blocked"), ("b", "whitelisted"), ("d", "pending")}
    later = ipstate.live(states, F.lit(T0 + 3605 * SEC))
    assert "a" not in {r["ip"] for r in later.collect()}
    assert {r["block_status"] for r in ipstate.metadata_snapshot(now).collect()} == {"blocked", "whitelisted", "pending"}


def test_fold_keeps_first_type_and_worst_severity(spark):
    rows = [(5, "late", "high", "l", ["a"], 3), (1, "early", "low", "e", ["a", "b"], 2)]
    out = {r["ip"]: r for r in alerts.fold_ip_state(alert_frame(spark, rows)).collect()}
    assert (out["a"]["attack_type"], out["a"]["severity"], out["a"]["flow_count"], out["a"]["alert_count"]) == ("early", "high", 5, 2)


def test_formats(spark):
    model = spark.createDataFrame([("ddos_5", T0, "high", "DDoS_Mixed", ["1.1.1." + str(k) for k in range(7)], "server", 60, 0.0)],
                                  "alert_id string, us long, severity string, attack_type string, attacker_ips array<string>, target_ip string, flow_count long, avg_confidence double")
    text = alerts.format_alert(model.withColumn("alert_ts", F.timestamp_micros("us"))).first()["message"]
    assert text.startswith("🔴 <b>DDoS ALERT - HIGH</b>\n\n<b>Time:</b> 2024-01-01 00:00:00\n<b>Type:</b> DDoS_Mixed\n<b>Target:</b> <code>server</code>\n<b>Flows:</b> 60\n")
    assert "Attackers (7)" in text and "1.1.1.4</code>" in text and "1.1.1.5" not in text and "... +2 more" in text and text.endswith("<i>ID: ddos_5</i>")
    names = spark.createDataFrame([("SYN Flood Attack",), ("UDP Port Scan",), ("ICMP Flood",), ("Port Scan Detection",), ("Slowloris",), ("Botnet",)], "n string")
    assert [r[0] for r in names.select(alerts.attack_family(F.col("n"))).collect()] == ["SYN", "UDP", "ICMP", "SCAN", "SLOW", "OTHER"]


def test_long_condition_lists_are_cut(spark):
    df = spark.createDataFrame([("x", T0, "odd", "Some", "R", "d", "alert", ["c1", "c2", "c3", "c4", "c5"], ["9.9.9.9"], None)],
                               "alert_id string, us long, severity string, rule_name string, rule_id string, description string, action string, matched_conditions array<string>, attacker_ips array<string>, confidence double")
    text = alerts.format_alert(df.withColumn("alert_ts", F.timestamp_micros("us"))).first()["message"]
    assert "c3" in text and "c4" not in text and "+2 more" in text and text.startswith("📌") and "Confidence" not in text


def test_dedup_and_summary(spark):
    rows = [(0, "r", "low", "i", ["a"], 1), (1, "r", "high", "i", ["a", "b"], 2), (2, "r", "low", "j", ["a"], 3)]
    frame = alert_frame(spark, rows)
    assert {r["alert_id"]: r["flow_count"] for r in alerts.first_of_each(frame, ["alert_ts"]).collect()} == {"i": 1, "j": 3}
    s = {r["ip"]: (r["alert_count"], [tuple(x) for x in r["severities"]]) for r in alerts.attacker_summary(frame).collect()}
    assert s == {"a": (3, [("high", 1), ("low", 2)]), "b": (1, [("high", 1)])}
    assert {tuple(r) for r in alerts.top_attackers_with_rest(frame, 1).collect()} == {("a", 3, 1)}


def test_gate_forgets_between_blocks(spark, monkeypatch):
    """Ids that never come again and a quiet time between blocks leave no state: the rounds do not grow with the blocks."""
    from rillwatch.operators import folds

    calls = []
    real = folds.cut_lineage
    monkeypatch.setattr(folds, "cut_lineage", lambda df: calls.append(1) or real(df))
    rows = [(f"id{b}-{k}", "r1", "high", b * 3600 + k) for b in range(12) for k in range(3)]
    df = spark.createDataFrame(rows, "alert_id string, rule_id string, severity string, s long").withColumn("alert_ts", F.timestamp_seconds("s"))
    got = suppress.notify_gate(df, block_seconds=3600)
    assert got.filter("sent").count() >= 12
    assert len(calls) <= 4
