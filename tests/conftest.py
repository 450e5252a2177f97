import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rillwatch.session import build_session

    session = build_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE_US = 1_704_067_200_000_000


@pytest.fixture
def flows(spark):
    """Builds flows from (seconds, src_ip, dst_port, protocol, fwd, bwd, syn, ack) rows."""
    from pyspark.sql import functions as F

    def build(rows):
        df = spark.createDataFrame(
            [(i, int(BASE_US + r[0] * 1e6), *r[1:]) for i, r in enumerate(rows)],
            "flow_id long, us long, src_ip string, dst_port int, protocol int, tot_fwd_pkts long, tot_bwd_pkts long, "
            "syn_flag_cnt long, ack_flag_cnt long")
        return df.withColumn("flow_ts", F.timestamp_micros("us")).drop("us")

    return build
