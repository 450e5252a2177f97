import math
import random

import pytest
from pyspark.sql import functions as F

from rillwatch.operators import blocks
from rillwatch.operators import rangevectors as rv

S = 1_000_000


def plain_range(samples, at, seconds):
    """The usual definition, sample by sample: (increase, rate) or None."""
    inside = [(us, v) for us, v in samples if at - seconds * S <= us <= at]
    if len(inside) < 2:
        return None
    grown = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
    span = (inside[-1][0] - inside[0][0]) / S
    gap = span / (len(inside) - 1)
    start, end = (inside[0][0] - (at - seconds * S)) / S, (at - inside[-1][0]) / S
    if start >= gap * 1.1:
        start = gap / 2
    if grown > 0 and inside[0][1] >= 0:
        start = min(start, span * inside[0][1] / grown)
    if end >= gap * 1.1:
        end = gap / 2
    increase = grown * (span + start + end) / span
    return increase, increase / seconds


def counters(rng, series=3, n=120):
    out = {}
    for s in range(series):
        us, value, rows = rng.randrange(5 * S), 0.0, []
        for _ in range(n):
            us += int(rng.choice([1, 5, 15, 15, 40, 400, 2000] if s else [1, 2, 3]) * S * (0.5 + rng.random()))
            value = 0.0 if rng.random() < 0.05 else value + rng.randrange(0, 50)
            rows.append((us, value))
        out[f"s{s}"] = rows
    out["one"] = [(7 * S, 3.0)]
    return out


@pytest.mark.parametrize("seconds", [60, 300])
def test_ranges_against_loops(spark, seconds):
    data = counters(random.Random(seconds))
    df = spark.createDataFrame([(s, us, v) for s, rows in data.items() for us, v in rows], "series string, us long, value double")
    got = {(r.series, r.at): (r.increase, r.rate) for r in rv.range_values(df, ["series"], seconds).collect()}
    for s, rows in data.items():
        for at in range(0, rows[-1][0] + (seconds + 60) * S, 15 * S):
            want, have = plain_range(rows, at, seconds), got.get((s, at), (None, None))
            if want is None:
                assert have == (None, None)
            else:
                assert math.isclose(have[0], want[0], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(have[1], want[1], rel_tol=1e-9, abs_tol=1e-9)
    # steps without a value follow every gap, so that an alert ends there
    assert all(any(got[k][0] is None for k in got if k[0] == s) for s in data)


def test_own_range_for_each_key(spark):
    data = counters(random.Random(3), series=2, n=60)
    df = spark.createDataFrame([(s, us, v, x) for s, rows in data.items() for us, v in rows for x in (60.0, 120.0)],
                               "series string, us long, value double, seconds double")
    df = df.withColumn("alert", F.col("seconds").cast("string"))
    for r in rv.range_values(df, ["alert", "series"], F.col("seconds")).filter("rate is not null").collect():
        assert math.isclose(r.rate, plain_range(data[r.series], r.at, float(r.alert))[1], rel_tol=1e-9, abs_tol=1e-9)


def test_instant_values_go_stale(spark):
    data = {"a": [(0, 1.0), (20 * S, 2.0), (20 * S, 5.0), (1000 * S, 3.0)], "b": [(14 * S, 7.0)]}
    df = spark.createDataFrame([(s, us, v) for s, rows in data.items() for us, v in rows], "series string, us long, value double")
    got = {(r.series, r.at // S): r.value for r in rv.instant_values(df, ["series"]).collect()}
    assert got["a", 0] == got["a", 15] == 1 and got["a", 30] == got["a", 315] == 5 and got["a", 330] is None
    assert got.get(("a", 990)) is None and got["a", 1005] == 3 and got["a", 1305] is None
    assert got["b", 15] == got["b", 300] == 7 and got["b", 315] is None and got["b", 0] is None


@pytest.mark.parametrize("following", [False, True])
def test_nearest_against_loops(spark, following):
    rng = random.Random(11)
    rows = {k: sorted(rng.sample(range(-2000, 4000), 60 if k else 2)) for k in range(3)}
    probes = [(k, i, rng.randrange(-3000, 6000)) for k in range(4) for i in range(150)]
    df = spark.createDataFrame([(k, p, f"v{p}") for k, ps in rows.items() for p in ps], "k int, pos long, v string")
    asked = spark.createDataFrame(probes, "k int, i int, t long")
    got = {(r.k, r.i): r.near and (r.near.pos, r.near.v) for r in blocks.nearest(df, asked, ["k"], "pos", "t", ["pos", "v"], 500, "near", following).collect()}
    assert len(got) == len(probes)
    for k, i, t in probes:
        fit = [p for p in rows.get(k, []) if (p >= t if following else p <= t)]
        want = (min(fit) if following else max(fit)) if fit else None
        assert got[k, i] == (None if want is None else (want, f"v{want}"))


def test_label_maps(spark):
    df = spark.createDataFrame([("m", "a", "x", None, 1, 2.0), ("m", "a", "", "502", 1, 3.0), ("m", "a=b,c", "x", "200", 1, 4.0)],
                               "name string, host string, dev string, status string, us long, value double")
    s = rv.labelled(df, ["host", "dev", "status"])
    assert sorted(r.labels.keys() for r in s.collect()) and s.select("series").distinct().count() == 3
    same = rv.labelled(df, ["status", "dev", "host"])  # the order of labels plays no part
    assert sorted(r.series for r in same.collect()) == sorted(r.series for r in s.collect())
    assert rv.select(s, "m", ("status", "=~", "5..")).count() == 1 and rv.select(s, "m", ("status", "!~", "5..")).count() == 2
    assert rv.select(s, "m", ("dev", "=", "")).count() == 1 and rv.select(s, "m", ("dev", "!=", "x")).count() == 1
    assert rv.select(s, "m", ("host", "=~", "a")).count() == 2 and rv.select(s, "other").count() == 0


def test_arithmetic_ignores_labels(spark):
    df = lambda *rows: spark.createDataFrame([({"host": h, "kind": k}, at, v) for h, k, at, v in rows], "labels map<string,string>, at long, value double")
    a, b = df(("x", "p", 1, 10.0), ("x", "p", 2, 20.0), ("y", "p", 1, 5.0)), df(("x", "q", 1, 4.0), ("x", "q", 3, 1.0), ("z", "p", 1, 1.0))
    assert rv.combine(a, b, F.col("l") - F.col("r")).count() == 0
    (row,) = rv.combine(a, b, F.col("l") - F.col("r"), ignoring=("kind",)).collect()
    assert (row.labels, row.at, row.value) == ({"host": "x"}, 1, 6.0)


def test_alerts_fire_after_their_hold(spark):
    """a: true, gap of one false, true; b: never long enough; c: without hold, fires at once."""
    rows = [("a", i * 15, i != 4, 30.0) for i in range(9)] + [("b", i * 15, i < 2, 30.0) for i in range(5)] + [("c", 0, True, 0.0), ("c", 15, None, 0.0)]
    df = spark.createDataFrame([(k, s * S, ok, h) for k, s, ok, h in rows], "k string, at long, ok boolean, hold double")
    got = sorted((r.k, r.since // S, r.fired // S, r.until // S, r.steps) for r in rv.firing(df, ["k"], block_seconds=30).collect())
    assert got == [("a", 0, 30, 45, 2), ("a", 75, 105, 120, 2), ("c", 0, 0, 0, 1)]
