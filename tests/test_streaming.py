"""Tier 3: streaming = batch, restart without duplicates, late rows and the watermark."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import points, stages
from fleetlens.plans.compare import rows_key
from fleetlens.plans.oracle import THRESHOLD_RULES
from fleetlens.plans.tables import Telemetry
from fleetlens.sources import ingest
from fleetlens.streaming import jobs

from .conftest import SF001

CONFIG = {"collect_agent_id": "collect_agent_1", "threshold_rules": THRESHOLD_RULES,
          "extra_fields": {"report_id": "bigint"}, "received_timestamp": "timestamp"}


def write_report_files(spark, out_dir, n_files=3):
    t = Telemetry(spark, SF001)
    wire = ingest.encode_reports(t.fx.reports, extra=["report_id"])
    wire.select("value").repartition(n_files).write.mode("overwrite").text(out_dir)
    return t


def test_stream_equals_batch_and_restart(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    sink = os.path.join(tmp_dir, "out")
    ckpt = os.path.join(tmp_dir, "ckpt")
    t = write_report_files(spark, src)
    with open(os.path.join(src, "junk.txt"), "w") as f:  # one line that is not JSON
        f.write("{not json\n")
    q = jobs.points_stream(spark, ingest.read_report_stream(spark, src, 1), sink, CONFIG, ckpt)
    q.awaitTermination()
    got = spark.read.parquet(f"{sink}/process_status").drop("batch_id", "date")
    assert rows_key(got.collect()) == rows_key(t.process_points.select(*got.columns).collect())
    nodes = spark.read.parquet(f"{sink}/node_status")
    assert nodes.count() == t.node_points.count()
    # Restart on the same checkpoint with no new input: nothing is written twice.
    q2 = jobs.points_stream(spark, ingest.read_report_stream(spark, src, 1), sink, CONFIG, ckpt)
    q2.awaitTermination()
    assert spark.read.parquet(f"{sink}/process_status").count() == got.count()
    rej = spark.read.parquet(f"{sink}/rejects")
    assert rej.filter("_reject_reason = 'malformed_json'").count() == 1
    alerts = spark.read.parquet(f"{sink}/alerts")
    v = stages.validate(t.fx.reports)
    expected = v.select(stages.count_violations(v, THRESHOLD_RULES).alias("n")).agg(F.sum("n")).first()[0]
    assert alerts.count() == expected


def test_watermark_drops_late_rows(spark, tmp_dir):
    src = os.path.join(tmp_dir, "pts")
    os.makedirs(src)
    schema = "ts timestamp, node_id string, cpu_usage_percent double, memory_usage_percent double, memory_used_bytes long"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(src)
    q = (jobs.node_rollup_stream(stream, "10 minutes").writeStream.format("memory").queryName("node_roll")
         .outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, "c")).start())

    def put(name, rows):
        df = spark.createDataFrame(rows, "ts string, node_id string, cpu_usage_percent double, "
                                         "memory_usage_percent double, memory_used_bytes long")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").json(os.path.join(src, name))
        q.processAllAvailable()

    put("a", [("2024-01-01 00:10:00", "n", 10.0, 1.0, 1), ("2024-01-01 00:50:00", "n", 30.0, 1.0, 1)])
    put("b", [("2024-01-01 01:30:00", "n", 50.0, 1.0, 1)])       # watermark 01:20 closes hour 00
    put("c", [("2024-01-01 00:20:00", "n", 90.0, 1.0, 1)])       # late for hour 00: dropped
    put("d", [("2024-01-01 03:00:00", "n", 70.0, 1.0, 1)])       # closes hour 01
    q.stop()
    out = {str(r["bucket_time"])[:19]: r["avg_cpu_usage_percent"] for r in spark.table("node_roll").collect()}
    assert out == {"2024-01-01 00:00:00": 20.0, "2024-01-01 01:00:00": 50.0}


def test_rollup_hours_backfill(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    sink = os.path.join(tmp_dir, "out")
    t = write_report_files(spark, src, 1)
    jobs.points_stream(spark, ingest.read_report_stream(spark, src), sink, CONFIG, os.path.join(tmp_dir, "ck")).awaitTermination()
    hours = ["2024-01-01 03:00:00", "2024-01-01 05:00:00"]
    got = jobs.rollup_hours(spark, sink, hours)["user_app_hourly"]
    want = t.user_app_hourly().filter(F.col("bucket_time").isin([F.lit(h).cast("timestamp") for h in hours]))
    assert rows_key(got.collect()) == rows_key(want.select(*got.columns).collect())
    # exactly the listed hours, not the ones between them
    assert {str(r[0]) for r in got.select("bucket_time").distinct().collect()} == set(hours)


def test_later_batch_replaces_the_same_second(spark, tmp_dir):
    def batch(n, report_id, cpu):
        row = (dt.datetime(2024, 1, 1, 3, 0, 5), "n1", report_id, "a", "v", 5.0, 1, cpu, 1.0, 1, 2)
        jobs._write_batch({"node_status": spark.createDataFrame([row], (
            "ts timestamp, node_id string, report_id long, collect_agent_id string, collect_agent_version string, "
            "collection_window_seconds double, received_timestamp long, cpu_usage_percent double, memory_usage_percent double, "
            "memory_used_bytes long, memory_total_bytes long"))}, tmp_dir, n)
    batch(0, 900, 10.0)
    batch(1, 5, 30.0)  # later, although its report key is smaller
    t = Telemetry(spark, SF001)
    for table, df in (("gpu_status", t.gpu_points), ("process_status", t.process_points)):
        spark.createDataFrame([], df.schema).withColumns({"date": F.lit("2024-01-01").cast("date"), "batch_id": F.lit(0)}).write.mode(
            "overwrite").parquet(os.path.join(tmp_dir, table))
    got = jobs.rollup_hours(spark, tmp_dir, ["2024-01-01 03:00:00"])["node_status_hourly"].collect()
    assert [r["avg_cpu_usage_percent"] for r in got] == [30.0]


def test_checkpoint_folder_must_be_named(spark):
    from fleetlens import session

    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        session.checkpoint_dir(Bare())


def test_liveness_stream_and_publish(spark, tmp_dir):
    from fleetlens.operators import fleet
    hb_dir = os.path.join(tmp_dir, "hb")
    now = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    rows = [("a", now - dt.timedelta(seconds=5), "alive"), ("a", now - dt.timedelta(seconds=500), "alive"),
            ("b", now - dt.timedelta(seconds=500), "alive"), ("c", now, "stopping")]
    spark.createDataFrame(rows, "node_id string, event_time timestamp, status string").write.json(hb_dir)
    stream = spark.readStream.schema("node_id string, event_time timestamp, status string").json(hb_dir)
    cfg = spark.createDataFrame([("a", "20"), ("b", "20"), ("c", "20"), ("d", None)],
                                "node_id string, heartbeat_interval string")
    out = os.path.join(tmp_dir, "live")
    jobs.liveness_stream(spark, stream, out, os.path.join(tmp_dir, "ck")).awaitTermination()
    got = {r["node_id"]: r["status"] for r in jobs.current_liveness(spark, out, cfg).collect()}
    assert got == {"a": "running", "b": "stopped", "c": "stopped", "d": "stopped"}
    # a silent fleet expires with the clock alone
    later = jobs.current_liveness(spark, out, cfg, F.lit(now + dt.timedelta(hours=1))).collect()
    assert {r["status"] for r in later} == {"stopped"}
    # publish: gzip JSON files decode back to the same reports
    t = Telemetry(spark, SF001)
    pub = os.path.join(tmp_dir, "pub")
    jobs.publish_files(t.validated_reports, pub)
    assert any(f.endswith(".gz") for f in os.listdir(pub))
    back = ingest.decode_reports(spark.read.text(pub))
    assert back.count() == t.validated_reports.count()
    assert back.filter(F.col("_corrupt").isNotNull()).count() == 0


def test_gpu_rollup_stream_equals_batch(spark, tmp_dir):
    from fleetlens.operators import rollup
    t = Telemetry(spark, SF001)
    src = os.path.join(tmp_dir, "gpu")
    g = t.gpu_points.select("ts", "node_id", "gpu_index", "utilization_percent", "power_watts", "temperature_celsius")
    g.write.parquet(src)
    stream = spark.readStream.schema(g.schema).parquet(src)
    q = (jobs.gpu_rollup_stream(stream, "10 minutes").writeStream.format("memory").queryName("gpu_roll")
         .outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, "c")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("gpu_roll")
    # Every hour except the last is closed by the watermark (the data spans one day).
    last = g.agg(F.max("ts")).first()[0]
    want = rollup.gpu_hourly(t.gpu_points).filter(F.col("bucket_time") < F.date_trunc("hour", F.lit(last)))
    cols = ["bucket_time", "node_id", "avg_gpu_utilization", "max_gpu_temperature", "total_gpu_power_watts", "gpu_count"]
    assert got.count() == want.count() > 0
    assert rows_key(got.select(*cols).collect()) == rows_key(want.select(*cols).collect())
