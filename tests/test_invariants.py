"""Tier 4: invariants across code paths."""

from pyspark.sql import functions as F

from fleetlens.operators import points, stages, usage
from fleetlens.plans.compare import rows_key
from fleetlens.plans.tables import Telemetry

from .conftest import SF001


def test_nested_path_equals_flat_path(spark):
    """The streaming path (nested stages + explode) and the batch path (flat filter +
    join) give the same points."""
    t = Telemetry(spark, SF001)
    v = stages.validate(t.fx.reports)
    nested = points.process_points(points.explode_processes(v))
    assert rows_key(nested.collect()) == rows_key(t.process_points.select(*nested.columns).collect())
    n_nested = points.node_points(v).select("ts", "node_id", "report_id", "cpu_usage_percent", "memory_usage_percent")
    n_flat = t.node_points.select(*n_nested.columns)
    assert rows_key(n_nested.collect()) == rows_key(n_flat.collect())
    g_nested = points.gpu_points(v).select("ts", "node_id", "report_id", "gpu_index", "utilization_percent")
    assert rows_key(g_nested.collect()) == rows_key(t.gpu_points.select(*g_nested.columns).collect())


def test_validation_partitions_input(spark):
    t = Telemetry(spark, SF001)
    a = stages.annotate_validation(t.fx.reports)
    total = t.fx.reports.count()
    assert a.filter("_reject_reason IS NULL").count() + stages.rejects(a).count() == total


def test_insert_if_absent_idempotent(spark):
    from fleetlens.operators import rollup
    t = Telemetry(spark, SF001)
    keys = ["bucket_time", "node_id", "uid", "comm"]
    new = t.user_app_hourly()
    once = rollup.insert_if_absent(new, new.limit(0), keys)
    table = once
    twice = rollup.insert_if_absent(new, table, keys)
    assert twice.count() == 0


def test_spread_non_negative_and_shares(spark):
    t = Telemetry(spark, SF001)
    h = t.user_app_hourly()
    assert h.filter((F.col("total_cpu_time_seconds") < 0) | (F.col("total_read_bytes") < 0)).count() == 0
    apps = usage.usage_apps(h, t.fx.users, (1001, 1002, 1003), "2024-01-01", "2024-01-02")
    shares = usage.usage_share(usage.pie_by_app(apps, "cpu_seconds"), ["username"])
    for r in shares.groupBy("username").agg(F.sum("share_pct").alias("s")).collect():
        assert abs(r["s"] - 100.0) <= 0.05 * 20


def test_append_if_absent_on_stored_table(spark, tmp_dir):
    import os
    from fleetlens.operators import rollup
    t = Telemetry(spark, SF001)
    path = os.path.join(tmp_dir, "user_app_hourly")
    keys = ["bucket_time", "node_id", "uid", "comm"]
    h = t.user_app_hourly()
    rollup.append_if_absent(h, path, keys)
    n1 = spark.read.parquet(path).count()
    rollup.append_if_absent(h, path, keys)          # rerun: first write wins, nothing added
    assert spark.read.parquet(path).count() == n1 == h.count()
    rollup.write_rollup(h, os.path.join(tmp_dir, "w"))
    rollup.write_rollup(h, os.path.join(tmp_dir, "w"))  # dynamic overwrite of the same days
    assert spark.read.parquet(os.path.join(tmp_dir, "w")).count() == n1


def test_first_write_wins_values(spark, tmp_dir):
    import os
    from fleetlens.operators import rollup
    t = Telemetry(spark, SF001)
    path = os.path.join(tmp_dir, "uah")
    keys = ["bucket_time", "node_id", "uid", "comm"]
    first, second = t.user_app_hourly("sum"), t.user_app_hourly("spread")
    rollup.append_if_absent(first, path, keys)
    rollup.append_if_absent(second, path, keys)      # same keys, other values: ignored
    stored = spark.read.parquet(path).drop("date", "hour")
    assert rows_key(stored.select(*first.columns).collect()) == rows_key(first.collect())


def _day(spark, value):
    return spark.sql(f"SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS bucket_time, 'n' AS node_id, "
                     f"{value} AS v FROM range(24)")


def test_backfill_keeps_the_rest_of_the_day(spark, tmp_dir):
    from fleetlens.operators import rollup
    rollup.write_rollup(_day(spark, 1), tmp_dir)
    rollup.write_rollup(_day(spark, 2).filter("hour(bucket_time) in (8, 9)"), tmp_dir)
    got = {r["bucket_time"].hour: r["v"] for r in spark.read.parquet(tmp_dir).collect()}
    assert got == {h: 2 if h in (8, 9) else 1 for h in range(24)}


def test_stored_appends(spark, tmp_dir):
    import os

    import pytest
    from pyspark.errors import AnalysisException
    from fleetlens.operators import rollup
    keys, path = ["bucket_time", "node_id"], os.path.join(tmp_dir, "t")
    twice = _day(spark, 3).unionByName(_day(spark, 1))
    rollup.append_if_absent(twice, path, keys)  # a key given twice counts once
    assert {r["v"] for r in spark.read.parquet(path).collect()} == {1} and spark.read.parquet(path).count() == 24
    late = _day(spark, 9).filter("hour(bucket_time) = 5")
    rollup.append_if_absent(late, path, keys)
    assert spark.read.parquet(path).filter("v = 9").count() == 0
    rollup.append_if_absent(late, path, keys, overwrite=True)
    assert spark.read.parquet(path).filter("v = 9").count() == 1 and spark.read.parquet(path).count() == 24
    broken = os.path.join(tmp_dir, "broken")
    os.makedirs(broken)  # a store without a readable schema isn't "nothing stored yet"
    with pytest.raises(AnalysisException):
        rollup.append_if_absent(late, broken, keys)
