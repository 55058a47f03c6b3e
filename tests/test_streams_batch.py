"""Streams give what the batch gives: repeated seconds, silent nodes, status changes in mid-stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import fleet, rollup
from fleetlens.plans.compare import rows_key
from fleetlens.plans.tables import Telemetry
from fleetlens.streaming import jobs

from .conftest import SF001

T0 = dt.datetime(2024, 1, 1, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def t(spark):
    return Telemetry(spark, SF001)


def run_stream(spark, df, name, tmp_dir):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, f"ck-{name}")).start())
    q.processAllAvailable()
    return q


@pytest.mark.parametrize("kind", ["app", "node", "gpu"])
def test_overwritten_points_dont_count_in_streams(spark, t, tmp_dir, kind):
    points = {"app": t.process_points, "node": t.node_points, "gpu": t.gpu_points}[kind]
    tags = {"app": jobs.APP_TAGS, "node": jobs.NODE_TAGS, "gpu": jobs.GPU_TAGS}[kind]
    # squeeze the seconds of each minute together, so that series have many points of one second
    points = points.withColumn("ts", F.date_trunc("minute", "ts") + F.expr("make_interval(0,0,0,0,0,0, second(ts) div 30)"))
    assert points.groupBy(*tags, "ts").count().where("count > 1").count() > 0
    src = os.path.join(tmp_dir, "points")
    points.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(points.schema).parquet(src)
    make = {"app": jobs.app_rollup_stream, "node": jobs.node_rollup_stream, "gpu": jobs.gpu_rollup_stream}[kind]
    q = run_stream(spark, make(stream, "10 minutes"), f"overwrite_{kind}", tmp_dir)
    q.stop()
    from fleetlens.operators.points import series_dedup
    series = series_dedup(points, tags, "ts", "report_id")
    want = {"app": rollup.user_app_hourly, "node": rollup.node_hourly_core, "gpu": rollup.gpu_hourly}[kind](series)
    last = points.agg(F.max("ts")).first()[0]
    want = want.where(F.col("bucket_time") < F.date_trunc("hour", F.lit(last)))
    got = spark.table(f"overwrite_{kind}").select(*want.columns)
    assert want.count() and rows_key(got.collect()) == rows_key(want.collect())


def test_two_points_of_one_second(spark, tmp_dir):
    rows = [(at(5), "n", 1, 10.0, 1.0, 1), (at(5), "n", 2, 90.0, 1.0, 1), (at(9), "n", 3, 20.0, 1.0, 1), (at(9000), "n", 4, 0.0, 0.0, 0)]
    d = spark.createDataFrame(rows, "ts timestamp, node_id string, report_id long, cpu_usage_percent double, memory_usage_percent double, memory_used_bytes long")
    src = os.path.join(tmp_dir, "p")
    d.write.parquet(src)
    q = run_stream(spark, jobs.node_rollup_stream(spark.readStream.schema(d.schema).parquet(src)), "one_second", tmp_dir)
    q.stop()
    assert [r["avg_cpu_usage_percent"] for r in spark.table("one_second").collect()] == [55.0]


BEATS = "node_id string, event_time timestamp, status string"


def test_sessions_of_alive_nodes(spark, tmp_dir):
    gaps = spark.createDataFrame([("a", 30), ("b", 10)], "node_id string, gap_seconds long")
    rows = [("a", at(s), "alive") for s in (0, 20, 50, 81, 100)] + [("b", at(s), "alive") for s in (0, 9, 30)] + [("a", at(40), "stopping"), ("c", at(3), "alive")]
    beats = spark.createDataFrame(rows, BEATS)
    want = [("a", at(0), at(50), at(80), 3), ("a", at(81), at(100), at(130), 2), ("b", at(0), at(9), at(19), 2), ("b", at(30), at(30), at(40), 1), ("c", at(3), at(3), at(63), 1)]
    assert sorted(map(tuple, fleet.liveness_sessions(beats, gaps).collect())) == want
    src = os.path.join(tmp_dir, "beats")
    beats.write.json(src)
    q = run_stream(spark, jobs.liveness_session_stream(spark.readStream.schema(BEATS).json(src), gaps, "5 seconds"), "sessions", tmp_dir)
    # nobody has lapsed for good before the watermark passes; then the silent nodes' rows come
    first = sorted(map(tuple, spark.table("sessions").collect()))
    assert first == [w for w in want if w[3] < at(95)]
    spark.createDataFrame([("d", at(500), "alive")], BEATS).write.mode("append").json(src)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sessions").collect())) == want


def test_gate_by_the_status_at_the_reports_time(spark, tmp_dir):
    changes = [("n", at(0), 1, "running"), ("n", at(100), 2, "stopped"), ("n", at(200), 3, "running"), ("m", at(50), 4, "stopped"), ("n", at(200), 5, "running")]
    reports = [(i, "n", at(s), s) for i, s in enumerate((-5, 0, 50, 99, 100, 101, 199, 200, 350, 900))] + [(50, "m", at(60), 60), (51, "x", at(60), 60)]
    r = spark.createDataFrame(reports, "report_id long, node_id string, event_time timestamp, timestamp long")
    c = spark.createDataFrame(changes, "node_id string, change_time timestamp, seq long, status string")
    want = sorted(x[0] for x in fleet.gate_at_report_time(r, c, 300).select("report_id").collect())
    assert want == [1, 2, 3, 7, 8]  # before the stop, from the restart on, while the status is fresh
    # as streams, the changes and the reports arriving in pieces
    rp, cp = os.path.join(tmp_dir, "r"), os.path.join(tmp_dir, "c")
    c.where("seq < 3").write.json(cp)
    r.where("timestamp < 150").write.json(rp)
    stream = jobs.gate_stream(spark.readStream.schema(r.schema).json(rp), spark.readStream.schema(c.schema).json(cp), 300, "10 seconds")
    q = run_stream(spark, stream, "gated", tmp_dir)
    c.where("seq >= 3").write.mode("append").json(cp)
    r.where("timestamp >= 150").write.mode("append").json(rp)
    q.processAllAvailable()
    spark.createDataFrame([(99, "z", at(5000), 0)], r.schema).write.mode("append").json(rp)
    spark.createDataFrame([("z", at(5000), 99, "stopped")], c.schema).write.mode("append").json(cp)
    q.processAllAvailable()
    q.stop()
    got = spark.table("gated")
    assert got.columns == r.columns
    assert rows_key(got.collect()) == rows_key(fleet.gate_at_report_time(r, c, 300).select(*r.columns).collect())


def test_gate_stream_of_the_fixture_equals_the_batch(spark, t, tmp_dir):
    reports = t.headers.select("report_id", "node_id", "event_time")
    changes = t.fx.status_changes.where("change_time < timestamp'2024-01-03 00:00:00'")
    rp, cp = os.path.join(tmp_dir, "r"), os.path.join(tmp_dir, "c")
    reports.write.parquet(rp)
    changes.write.parquet(cp)
    stream = jobs.gate_stream(spark.readStream.schema(reports.schema).parquet(rp), spark.readStream.schema(changes.schema).parquet(cp), 6 * 3600, "2 days")
    q = run_stream(spark, stream, "gated_fixture", tmp_dir)
    far = dt.datetime(2024, 2, 1)
    spark.createDataFrame([(-1, "z", far)], reports.schema).write.mode("append").parquet(rp)
    spark.createDataFrame([("z", far, -1, "stopped")], changes.schema).write.mode("append").parquet(cp)
    q.processAllAvailable()
    q.stop()
    want = fleet.gate_at_report_time(reports, changes, 6 * 3600)
    assert want.count() and rows_key(spark.table("gated_fixture").collect()) == rows_key(want.select(*reports.columns).collect())
