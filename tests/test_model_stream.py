"""The saved model on a stream against the batch job."""

import pytest
from pyspark.sql import functions as F

from rillwatch.fixtures import Inputs
from rillwatch.operators import model
from rillwatch.plans import q_models
from rillwatch.session import run_dir
from rillwatch.streaming import jobs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def job(spark):
    """Flows in five files by time, the shared model, and a whitelist that takes a busy source out."""
    t = Inputs(spark, SF)
    flows = t.view("flows")
    where = run_dir(spark, "stream-test")
    ends = flows.agg(F.min("flow_ts"), F.max("flow_ts")).first()
    part = F.floor((F.unix_micros("flow_ts") - F.unix_micros(F.lit(ends[0]))) * 5 / (F.unix_micros(F.lit(ends[1])) - F.unix_micros(F.lit(ends[0])) + 1))
    for i in range(5):  # a stream takes files in the order in which they were written
        flows.filter(part == i).coalesce(1).write.mode("append").parquet(f"{where}/in")
    busy = flows.groupBy("src_ip").count().orderBy(F.desc("count"), "src_ip").first().src_ip
    white = spark.createDataFrame([(busy,)], "ip string")
    return t, where, spark.read.parquet(f"{where}/in"), q_models.shared_model(t), white


def run(spark, job, out, **kw):
    _t, where, flows, saved, white = job
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    query = jobs.stream_model_alerts(stream, saved, f"{where}/{out}", f"{where}/{out}-check", "30 seconds", threshold=0.5, cooldown=120, whitelist=white, **kw)
    query.trigger(availableNow=True).start().awaitTermination()
    return rows(spark, f"{where}/{out}")


def rows(spark, out):
    df = spark.read.parquet(f"{out}/alerts").drop("batch", "model")
    return sorted((r.alert_id, r.severity, r.flow_count, sorted(r.attacker_ips or [])) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark, job):
    return run(spark, job, "whole")


def test_alerts_equal_the_batch_job(spark, job, whole):
    _t, _where, flows, saved, white = job
    fit, features, _ = model.load_artifacts(spark, saved)
    batch = jobs.model_alerts_from_flows(flows, fit, features, 0.5, cooldown=120, whitelist=white)
    kept = flows.join(white.withColumnRenamed("ip", "src_ip"), "src_ip", "left_anti")
    closed = kept.agg((F.unix_micros(F.max("flow_ts")) - 30_000_000) / 1_000_000).first()[0]
    want = sorted((r.alert_id, r.severity, r.flow_count, sorted(r.attacker_ips or [])) for r in batch.collect() if int(r.alert_id.split("_")[1]) <= closed)
    got = whole
    assert got == want and len(want) > 3
    listed = {ip for r in got for ip in r[3]}
    assert white.first().ip not in listed and listed
    without = jobs.model_alerts_from_flows(flows, fit, features, 0.5, cooldown=120)
    assert sorted((r.alert_id, r.flow_count) for r in without.collect()) != sorted((r.alert_id, r.flow_count) for r in batch.collect())


@pytest.mark.parametrize("moment", ["before", "after"])
def test_killed_and_restarted(spark, job, whole, monkeypatch, moment):
    """A batch that dies before or after its alerts were written is replayed: none is lost, none comes twice."""
    calls, own = [], jobs.suppress.cooldown

    def dies(*a, **kw):
        calls.append(1)
        if len(calls) == 2:
            if moment == "after":
                own(*a, **kw).write.mode("overwrite").parquet(f"{job[1]}/half")
            raise RuntimeError("killed")
        return own(*a, **kw)

    monkeypatch.setattr(jobs.suppress, "cooldown", dies)
    with pytest.raises(Exception, match="killed"):
        run(spark, job, f"twice-{moment}")
    if moment == "after":  # what a lost driver may leave behind in the batch's own folder
        last = max(int(p.split("batch=")[1]) for p in [r.f for r in spark.read.parquet(f"{job[1]}/twice-{moment}/alerts").select(
            F.regexp_extract(F.input_file_name(), "(batch=[0-9]+)", 1).alias("f")).distinct().collect()])
        spark.read.parquet(f"{job[1]}/twice-{moment}/alerts/batch={last}").withColumn("model", F.lit("older")).write.parquet(
            f"{job[1]}/twice-{moment}/alerts/batch={last + 1}")
    assert run(spark, job, f"twice-{moment}") == whole


def test_model_and_state_in_the_folders(spark, job, whole):
    alerts = spark.read.parquet(f"{job[1]}/whole/alerts")
    fit, _, _ = model.load_artifacts(spark, job[3])
    assert {r.model for r in alerts.select("model").distinct().collect()} == {fit.uid}
    last = alerts.agg(F.max("batch")).first()[0]
    passed = spark.read.parquet(f"{job[1]}/whole/passed/batch={last}")
    assert {r.severity for r in passed.collect()} == {r.severity for r in alerts.collect()}


def test_queries_share_one_fit(spark, monkeypatch):
    t = Inputs(spark, SF)
    path = q_models.shared_model(t)
    monkeypatch.setattr(q_models, "fitted", lambda *a, **k: pytest.fail("fitted again"))
    assert q_models.shared_model(Inputs(spark, SF + "/")) == path
