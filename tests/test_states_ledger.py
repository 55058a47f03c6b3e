"""Partial states, the hourly job's ledger, and reads of what they store."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import rollup, states
from fleetlens.plans.compare import rows_key
from fleetlens.plans.tables import Telemetry
from fleetlens.sources import ingest
from fleetlens.streaming import jobs, ledger

from .conftest import SF001
from .test_streaming import CONFIG

LATER = dt.datetime(2030, 1, 1)


@pytest.fixture(scope="module")
def t(spark):
    return Telemetry(spark, SF001)


def same(got, want):
    assert rows_key(got.select(*want.columns).collect()) == rows_key(want.collect()) and want.count()


@pytest.mark.parametrize("mode", ["spread", "sum"])
def test_hours_and_days_from_states_equal_those_from_points(t, mode):
    app, node, gpu = (states.states(p, k) for p, k in ((t.process_series, "app"), (t.node_series, "node"), (t.gpu_series, "gpu")))
    same(states.app_values(states.merge(app, "app"), mode), rollup.user_app_hourly(t.process_series, mode))
    same(states.node_values(states.merge(node, "node")), rollup.node_hourly_core(t.node_series))
    same(states.gpu_values(states.merge(gpu, "gpu")), rollup.gpu_hourly(t.gpu_series))
    same(states.node_io_values(states.merge(app, "app"), mode), rollup.node_io_hourly(t.process_series, mode))
    day = F.date_trunc("day", "ts")
    same(states.app_values(states.merge(app, "app", "day"), mode), rollup.user_app_hourly(t.process_series, mode, bucket=day))
    same(states.node_values(states.merge(node, "node", "day")), rollup.node_hourly_core(t.node_series, bucket=day))


def test_late_points_merge_without_reading_the_hour(spark, t, tmp_dir):
    points = t.process_series
    late = F.pmod(F.xxhash64("node_id", "ts"), F.lit(3)) == 0
    states.add_states(points.where(~late), tmp_dir, "app", 0)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_dir}/app/**/*.parquet", recursive=True)}
    states.add_states(points.where(late), tmp_dir, "app", 1)
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_dir}/app/**/*.parquet", recursive=True)}
    assert len(after) > len(before) and all(after[f] == m for f, m in before.items())
    want = rollup.user_app_hourly(points)
    same(states.app_values(states.read_states(spark, tmp_dir, "app")), want)
    states.add_states(points.where(late), tmp_dir, "app", 1)  # a replayed batch changes nothing
    same(states.app_values(states.read_states(spark, tmp_dir, "app")), want)
    first = points.agg(F.min(F.to_date("ts")).cast("string")).first()[0]
    same(states.app_values(states.read_states(spark, tmp_dir, "app", "day", first, first)), rollup.user_app_hourly(
        points.where(F.to_date("ts") == first), bucket=F.date_trunc("day", "ts")))


def test_active_users_of_any_range(spark, t):
    more = t.process_series.unionByName(t.process_series.withColumn("uid", F.col("uid") + 40_000))  # a second run of ids
    b = states.user_bitmaps(more)
    for lo, hi in (("2024-01-01 00:00:00", "2024-01-01 23:00:00"), ("2024-01-01 03:00:00", "2024-01-01 03:00:00"), ("2020-01-01", "2020-01-02")):
        lo, hi = F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")
        want = more.where(F.date_trunc("hour", "ts").between(lo, hi) & (F.col("uid") >= 0)).select("uid").distinct().count()
        got = states.active_users(b, lo, hi).collect()
        assert [r["active_users"] for r in got] == [want]


def folder(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_hourly_job_rolls_touched_hours_only(spark, t, tmp_dir):
    src, sink, store, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "store", "ck"))
    hour = F.date_trunc("hour", F.timestamp_seconds("timestamp"))
    wire = ingest.encode_reports(t.fx.reports.withColumn("_h", hour), extra=["report_id"])
    late_hours = [dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 5)]
    late = t.fx.reports.where(hour.isin([F.lit(h) for h in late_hours]) & (F.col("report_id") % 2 == 0)).select("report_id")
    value = F.get_json_object("value", "$.report_id").cast("bigint")

    def feed(df):
        df.select("value").coalesce(1).write.mode("append").text(src)
        jobs.points_stream(spark, ingest.read_report_stream(spark, src), sink, CONFIG, ck).awaitTermination()

    feed(wire.withColumn("report_id", value).join(late, "report_id", "left_anti"))
    first = t.node_points.agg(F.min("ts")).first()[0].replace(minute=0, second=0, microsecond=0)
    # at hh:04 the hour before is not due yet, at hh:05 it is
    assert ledger.run_hourly(spark, sink, store, first + dt.timedelta(hours=1, minutes=4)) == []
    assert ledger.run_hourly(spark, sink, store, first + dt.timedelta(hours=1, minutes=5)) == [first]
    # the missed runs are made up at once
    done = ledger.run_hourly(spark, sink, store, LATER)
    assert first not in done and set(late_hours) <= set(done)
    before = folder(f"{store}/user_app_hourly")
    assert ledger.run_hourly(spark, sink, store, LATER) == [] and folder(f"{store}/user_app_hourly") == before
    # a late file: exactly its hours are written anew
    feed(wire.withColumn("report_id", value).join(late, "report_id", "left_semi"))
    assert ledger.run_hourly(spark, sink, store, LATER) == late_hours
    after = folder(f"{store}/user_app_hourly")
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all("hour=3/" in f or "hour=5/" in f for f in changed)
    same(spark.read.parquet(f"{store}/user_app_hourly").drop("date", "hour"), t.user_app_hourly())
    same(spark.read.parquet(f"{store}/node_status_hourly").drop("date", "hour"), t.node_status_hourly())


def test_a_run_that_died_before_its_note_is_repeated(spark, t, tmp_dir, monkeypatch):
    sink, store = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "store")
    tables = {"node_status": t.node_points, "gpu_status": t.gpu_points, "process_status": t.process_points}
    jobs._write_batch(tables, sink, 0)
    ledger.note_hours(t.node_points, sink, 0)
    real = rollup.write_rollup

    def dies(df, path, *rest):
        real(df, path, *rest)
        if path.endswith("user_app_hourly"):
            raise RuntimeError("killed")

    monkeypatch.setattr(rollup, "write_rollup", dies)
    with pytest.raises(RuntimeError):
        ledger.run_hourly(spark, sink, store, LATER)
    monkeypatch.setattr(rollup, "write_rollup", real)
    assert ledger.run_hourly(spark, sink, store, LATER)
    same(spark.read.parquet(f"{store}/user_app_hourly").drop("date", "hour"), t.user_app_hourly())
    assert ledger.run_hourly(spark, sink, store, LATER) == []


def scan_metrics(df):
    """Files and row groups' rows that the scans of a finished plan have read."""
    df.collect()
    stack, files, rows = [df._jdf.queryExecution().executedPlan()], 0, 0
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        metrics = node.metrics()
        if node.nodeName().startswith("Scan parquet"):
            files += metrics.apply("numFiles").value()
            rows += metrics.apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return files, rows


def test_a_folded_day_is_read_by_node(spark, tmp_dir):
    hours = spark.range(24 * 20).select(F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int))").alias("bucket_time"))
    df = hours.join(spark.range(100).select(F.concat(F.lit("node_"), F.col("id").cast("string")).alias("node_id")), F.lit(True)).withColumn("x", F.hour("bucket_time"))
    path = os.path.join(tmp_dir, "folded")
    rollup.fold_days(df, path, buckets=16)
    total = len(glob.glob(f"{path}/**/*.parquet", recursive=True))
    got = rollup.read_node(spark, path, "node_42", "2024-01-05", "2024-01-05", buckets=16)
    files, rows = scan_metrics(got)
    assert got.count() == 24 and sorted(r["x"] for r in got.collect()) == list(range(24))
    assert total >= 300 and files <= 0.05 * total and rows <= 0.05 * df.count()
    # folding a day again replaces that day and leaves the others' files
    before = folder(path)
    rollup.fold_days(df.where("to_date(bucket_time) = date'2024-01-07'"), path, buckets=16)
    after = folder(path)
    assert {f for f in before.keys() ^ after.keys()} and all("date=2024-01-07" in f for f in before.keys() ^ after.keys())
    assert spark.read.parquet(path).count() == df.count()
