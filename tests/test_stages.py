"""Tier 1: collector-side stages, thresholds, liveness and rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, fleet, rules, stages
from fleetlens.schemas import REPORT


def proc(pid, cpu, uid, comm, rss=1):
    return (pid, cpu, uid, comm, 10, 20, 30, 40, rss, "", 0, {}, "valid")


def report(node, ts, procs, sm=None):
    return (node, ts, 5.0, procs, sm, None, None, {})


def sm(cpu=50.0, mem=50.0, gpus=()):
    return (cpu, mem, 1, 2, list(gpus))


def gpu(idx, util=10.0, temp=50.0, power=100.0):
    return (idx, "g", util, temp, power, 300.0, 10, 100)


@pytest.fixture()
def reports(spark):
    rows = [
        report("", 1, [proc(1, 1, 1000, "a")]),                                   # bad header
        report("n1", None, [proc(1, 1, 1000, "a")]),                              # bad header
        report("n2", 1, [proc(0, 1, 1000, "a"), proc(2, -1, 1000, "b"),
                         proc(3, 1, 1000, ""), proc(4, 5, 1000, "ok")], sm(cpu=100.1)),
        report("n3", 1, [proc(5, 1, 1000, "x")], sm(gpus=[gpu(0, temp=201.0)])),
        report("n4", 1, [proc(6, 1, 1000, "y")], sm(gpus=[gpu(0, power=-1.0)])),
        report("n5", 1, [proc(0, 1, 1000, "z")], sm()),                          # only bad processes
        report("n6", 1, [proc(7, 1, 1000, "w")], sm(gpus=[gpu(0), gpu(1)])),
    ]
    return spark.createDataFrame(rows, REPORT).withColumn("report_id", F.monotonically_increasing_id())


def test_validation(reports):
    a = stages.annotate_validation(reports).orderBy("report_id").collect()
    reasons = [r["_reject_reason"] for r in a]
    assert reasons == ["invalid_header", "invalid_header", None, None, None, "no_valid_processes", None]
    assert [r["_invalid"] for r in a] == [1, 1, 3, 0, 0, 1, 0]
    assert [len(r["processes"]) for r in a if r["_reject_reason"] is None] == [1, 1, 1, 1]
    sm_null = [r["system_metrics"] is None for r in a]
    assert sm_null == [True, True, True, True, True, False, False]
    acc = stages.accounting(stages.annotate_validation(reports)).first()
    assert (acc["reports_in"], acc["reports_out"], acc["invalid_count"]) == (7, 4, 6)


def test_prefix_merge(spark):
    rows = [report("n", 1, [proc(1, 10, 1000, "SMALL-1x"), proc(2, 5, 1000, "OTHER"),
                            proc(3, 7, 1000, "SMALL-2"), proc(4, 1, 1000, "SMALL-1y"), proc(5, 2, 2000, "SMALL-9")])]
    df = spark.createDataFrame(rows, REPORT)
    m = stages.prefix_merge(df, ["SMALL", "SMALL-1"]).first()["processes"]
    got = [(p["pid"], p["uid"], p["comm"], p["cpu_ontime_ns"]) for p in m]
    assert got == [(0, 1000, "SMALL-1", 11), (0, 1000, "SMALL", 7), (0, 2000, "SMALL", 2), (2, 1000, "OTHER", 5)]
    before = sum(p["cpu_ontime_ns"] for p in df.first()["processes"])
    assert sum(p[3] for p in got) == before  # invariant: the merge preserves sums


def test_field_projection(spark):
    df = spark.createDataFrame([report("n", 1, [proc(1, 10, 1000, "a")])], REPORT)
    p = stages.project_fields(df, ["pid", "comm", "nope"]).first()
    x = p["processes"][0]
    assert (x["pid"], x["comm"], x["cpu_ontime_ns"], x["uid"]) == (1, "a", 0, 0)
    assert p["metadata"]["exported_process_fields"] == "['pid', 'comm']"
    same = stages.project_fields(df, ["nope"]).first()["processes"][0]
    assert same["cpu_ontime_ns"] == 10


def test_stage_names():
    assert stages.resolve_stages(None) == stages.DEFAULT_STAGES
    assert stages.resolve_stages(["Schema-Validator", "nope", "MetricsEnricher"]) == ["schema_validator", "metrics_enricher"]
    assert stages.resolve_stages(["nope"]) == stages.DEFAULT_STAGES
    assert stages.warn_if_validation_after_merge(["prefix_aggregation", "schema_validator"])


def test_threshold_check(spark):
    metrics = spark.createDataFrame(
        [("m_eq", 90.0), ("m_hi", 91.0), ("m_lo", 4.0), ("m_both", 50.0), ("m_nomax", 1e9)],
        "metric_name string, metric_value double")
    rl = spark.createDataFrame(
        [("m_eq", 90.0, None), ("m_hi", 90.0, None), ("m_lo", None, 5.0), ("m_both", 40.0, 60.0),
         ("m_missing", 1.0, None), ("m_nomax", None, None)], "metric_name string, max_value double, min_value double")
    got = {r["metric_name"]: r["violation_type"] for r in alerts.threshold_check(metrics, rl).collect()}
    assert got == {"m_hi": "exceeded_max", "m_lo": "below_min", "m_both": "below_min"}


def test_in_row_violations_match_join(spark, reports):
    rl = [("cpu_usage_percent", 40.0, None), ("process_count", None, 2.0), ("gpu_max_temperature_celsius", 45.0, None)]
    v = stages.validate(reports)
    joined = alerts.threshold_alerts(v, spark.createDataFrame(rl, "metric_name string, max_value double, min_value double"))
    per_report = {r["report_id"]: r["n"] for r in joined.groupBy("report_id").agg(F.count("*").alias("n")).collect()}
    inrow = {r["report_id"]: r["n"] for r in v.select("report_id", stages.count_violations(v, rl).alias("n")).collect()}
    assert {k: n for k, n in inrow.items() if n} == per_report


def test_compile_thresholds(spark):
    from fleetlens.plans.catalog import alert_rules_df
    rows = [("a", "cpu > 90", "all", "cpu", ">", 90.0, "critical", True),
            ("b", "cpu >= 75", "all", "cpu", ">=", 75.0, "warning", True),
            ("c", "cpu < 10", "all", "cpu", "<", 10.0, "info", True),
            ("d", "net > 5", "all", "net", ">", 5.0, "warning", True),
            ("e", "mem > 1", "all", "mem", ">", 1.0, "info", False)]
    ar = spark.createDataFrame(rows, alert_rules_df(spark).schema)
    got = [(r["metric_name"], r["max_value"]) for r in alerts.compile_thresholds(ar).collect()]
    assert got == [("cpu_usage_percent", 75.0)]
    assert [r["name"] for r in alerts.skipped_rules(ar).collect()] == ["net > 5"]


def test_liveness(spark):
    cfg = spark.createDataFrame([("a", "20"), ("b", "20"), ("c", "20"), ("d", "20"), ("e", "bad")],
                                "node_id string, heartbeat_interval string")
    now = 1000.0
    hb = spark.createDataFrame([("a", now - 60, "alive"), ("b", now - 61, "alive"), ("c", now, "stopping"),
                                ("e", now - 60, "alive")], "node_id string, timestamp double, status string")
    got = {r["node_id"]: r["status"] for r in fleet.liveness(cfg, hb, F.lit(now).cast("timestamp")).collect()}
    assert got == {"a": "running", "b": "stopped", "c": "stopped", "d": "stopped", "e": "running"}


def test_heartbeat_parse_skips_malformed(spark):
    kv = spark.createDataFrame([("/nodes/a/heartbeat", '{"timestamp": 5, "status": "alive"}'),
                                ("/nodes/b/heartbeat", "not json"), ("/nodes/c", "{}"),
                                ("/nodes/d/other", '{"timestamp": 1}')], "key string, value string")
    got = [(r["node_id"], r["timestamp"]) for r in fleet.heartbeat_parse(kv).collect()]
    assert got == [("a", 5.0)]


def test_config_kv_pivot(spark):
    kv = spark.createDataFrame([("/config/compute_node/n1/window", "5.0"), ("/config/compute_node/n1/status", "running"),
                                ("/config/compute_node/n2", "x"), ("/other/n3/window", "1")], "key string, value string")
    got = [r.asDict() for r in fleet.config_kv_pivot(kv).collect()]
    assert got == [{"node_id": "n1", "heartbeat_interval": None, "status": "running", "target_collect_agent": None,
                    "window": "5.0"}]


def test_rule_conditions_rejected(spark):
    with pytest.raises(rules.RuleError):
        rules.filter_condition("value > 1; drop table x", "cpu")
    with pytest.raises(rules.RuleError):
        rules.derive_expression("value + secret_col", "cpu", ["cpu_ontime_ns"])
    with pytest.raises(rules.RuleError):
        rules.filter_condition("value > 1", "bogus")
    df = spark.createDataFrame([(0,), (5,), (None,)], "cpu_ontime_ns long")
    kept = rules.rule_filter(df, [{"id": "r", "name": "n", "type": "filter", "resource": "cpu",
                                   "condition": "value == 0 OR value > 4", "enabled": True}])
    assert [r[0] for r in kept.collect()] == [None]


def test_custom_stage_registry(reports):
    stages.register_stage("drop-n6", lambda df: df.withColumn(
        "_reject_reason", F.when(F.col("node_id") == "n6", F.lit("custom")).otherwise(F.col("_reject_reason"))))
    assert stages.resolve_stages(["schema_validator", "Drop-N6"]) == ["schema_validator", "dropn6"]
    out = stages.run_collect(reports, ["schema_validator", "drop_n6"])
    survivors = [r["node_id"] for r in out.filter("_reject_reason IS NULL").collect()]
    assert sorted(survivors) == ["n2", "n3", "n4"]


def test_rule_counters(spark):
    from fleetlens.plans.catalog import alert_rules_df
    ar = alert_rules_df(spark)
    c = fleet.rule_counters(ar, F.col("operator").isin(">", ">=") & F.col("resource").isin("cpu", "mem", "gpu", "disk")).first()
    assert (c["total"], c["enabled"], c["syncable"]) == (7, 6, 3)


def test_common_apps_division(spark):
    from fleetlens.operators import usage
    rows = [("a", "x", 5.0), ("b", "x", 1.0), ("a", "y", 9.0)]
    apps = spark.createDataFrame(rows, "username string, comm string, cpu_seconds double")
    assert [r["comm"] for r in usage.common_apps(apps).collect()] == ["x"]
    one = apps.filter("username = 'a'")
    assert [r["comm"] for r in usage.common_apps(one).collect()] == ["y", "x"]
    bars = {r["comm"]: r["bar_pct"] for r in usage.app_bar_share(apps).collect()}
    assert bars == {"x": 100.0}


def test_cpu_percent_from_counters(spark):
    from fleetlens.operators import host
    rows = [("n", 0, 1, 10, 0, 100), ("n", 60, 2, 10, 0, 100),      # first sample -> 0; equal totals -> 0
            ("n", 120, 3, 40, 10, 200),                               # 100 * (1 - 40 / 100) = 60
            ("n", 4000, 4, 41, 10, 203)]                              # next hour: 100 * (1 - 1 / 3) = 66.67
    df = spark.createDataFrame(rows, "node_id string, s long, seq long, idle long, iowait long, total long")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = [r["cpu_usage_percent"] for r in host.cpu_percent_from_counters(df).orderBy("seq").collect()]
    assert got == [0.0, 0.0, 60.0, 66.67]
