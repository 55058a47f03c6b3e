"""Registered queries: key -> (Spark builder, DuckDB oracle text or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole driver
tables. Time columns leave as ``timestamp_ntz`` so they compare equal to DuckDB
``TIMESTAMP`` (D-23).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..operators import alerts, charts, fleet, host, host_windows, points, rollup, rules, stages, states, usage
from ..operators.joins import literal_table
from ..sources import ingest
from ..sources.fixtures import HOST_WINDOW
from .oracle import (ALERT_RULES, APP_UIDS, COLLECT_PREFIXES, COMM_CASE, HOST_WINDOW_US, PIPELINE_RULES, PROJECTED_FIELDS, SAMPLE_RATE,
                     SYSTEM_PREFIXES, THRESHOLD_RULES, parse_float_sql)
from .oracle import RANGE_END, RANGE_START, RESOURCE_SQL, TS_UID, sql, usage_timeseries_sql
from .tables import Telemetry

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def finish(df: DataFrame) -> DataFrame:
    """Session-independent output: instants become wall-clock UTC ``timestamp_ntz``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def query(name: str, oracle: str | None):
    def deco(fn: Callable[[Telemetry], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Telemetry.get(spark, sf_dir)))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        REGISTRY[name] = (build, oracle)
        return fn
    return deco



# ------------------------------------------------------------------ points & rollups ---


@query("process_points", sql("SELECT * FROM proc_points", "proc_points"))
def q_process_points(t: Telemetry) -> DataFrame:
    """AGG-1: per report, processes grouped by mapped uid and normalised comm."""
    return t.process_points


@query("node_points", sql("SELECT * FROM node_points", "node_points"))
def q_node_points(t: Telemetry) -> DataFrame:
    """PRJ-4: one node point per valid report, null system metrics -> 0."""
    return t.without_processes.node_points


@query("gpu_points", sql("SELECT * FROM gpu_points", "gpu_points"))
def q_gpu_points(t: Telemetry) -> DataFrame:
    """PRJ-5: one point per GPU of a report with valid system metrics."""
    return t.without_processes.gpu_points


@query("user_app_hourly", sql("SELECT * FROM user_app_hourly", "user_app_hourly"))
def q_user_app_hourly(t: Telemetry) -> DataFrame:
    """AGG-9/10/11, JON-12: app rollup, spread mode (reference semantics)."""
    return t.user_app_hourly("spread")


@query("user_app_hourly_sum", sql("SELECT * FROM user_app_hourly_sum", "user_app_hourly_sum"))
def q_user_app_hourly_sum(t: Telemetry) -> DataFrame:
    """D-3 sum mode: true totals of per-window deltas."""
    return t.user_app_hourly("sum")


@query("node_status_hourly", sql("SELECT * FROM node_status_hourly", "node_status_hourly"))
def q_node_status_hourly(t: Telemetry) -> DataFrame:
    """AGG-4/5/6/8, JON-11/14: node rollup."""
    return t.node_status_hourly("spread")


@query("gpu_hourly", sql("SELECT * FROM gpu_hourly", "gpu_hourly"))
def q_gpu_hourly(t: Telemetry) -> DataFrame:
    """AGG-6: two-level GPU aggregate."""
    return rollup.gpu_hourly(t.without_processes.gpu_series)


@query("node_io_hourly", sql("""
SELECT bucket_time, node_id, read_bytes, write_bytes, net_rx_bytes, net_tx_bytes FROM node_io_hourly""", "node_io_hourly"))
def q_node_io_hourly(t: Telemetry) -> DataFrame:
    """AGG-8: node IO = sum over apps of per-app spreads."""
    return rollup.node_io_hourly(t.process_series)


@query("process_spread", sql("""
SELECT bucket_time, node_id, uid, comm, cpu_spread AS cpu_ontime_ns, read_bytes_spread AS read_bytes,
  write_bytes_spread AS write_bytes, net_rx_bytes_spread AS net_rx_bytes, net_tx_bytes_spread AS net_tx_bytes FROM app_agg""", "app_agg"))
def q_process_spread(t: Telemetry) -> DataFrame:
    """AGG-7: max - min per (hour, node, uid, comm)."""
    return rollup.process_spread(t.process_series)


# ------------------------------------------------------------------------- usage -------

@query("usage_summary", sql("""
SELECT uid, username, group_name, total_cpu_seconds, peak_mem_bytes, peak_gpu_mib, total_disk_bytes, total_net_bytes
FROM fx_users LEFT JOIN uid_totals USING (uid)""", "fx_users", "uid_totals"))
def q_usage_summary(t: Telemetry) -> DataFrame:
    """JON-1, AGG-14, TOP-3: per-user totals, idle users kept with nulls."""
    return usage.usage_summary(t.fx.users, t.user_app_hourly(), RANGE_START, RANGE_END)


def _register_timeseries(resource: str) -> None:
    @query(f"usage_timeseries_{resource}", usage_timeseries_sql(resource))
    def q(t: Telemetry) -> DataFrame:
        """AGG-15 / PRJ-7: hourly series of one resource for one uid."""
        return usage.usage_timeseries(t.user_app_hourly(), TS_UID, resource, RANGE_START, RANGE_END)


for _r in RESOURCE_SQL:
    _register_timeseries(_r)


def _apps(t: Telemetry) -> DataFrame:
    return usage.usage_apps(t.user_app_hourly(), t.fx.users, APP_UIDS, RANGE_START, RANGE_END)


@query("usage_app_timeseries", sql("SELECT * FROM usage_app_ts ORDER BY t, username, comm", "usage_app_ts"))
def q_usage_app_timeseries(t: Telemetry) -> DataFrame:
    """AGG-16, JON-2: hourly cpu per (user, app) for the selected uids."""
    return usage.usage_app_timeseries(t.user_app_hourly(), t.fx.users, APP_UIDS, "cpu", RANGE_START, RANGE_END)


@query("usage_apps", sql("SELECT * FROM usage_apps ORDER BY cpu_seconds DESC", "usage_apps"))
def q_usage_apps(t: Telemetry) -> DataFrame:
    """AGG-17, JON-2: per (user, app) breakdown of every resource."""
    return _apps(t)


@query("cluster_stats", sql("""
SELECT CAST(ROUND(CAST(AVG(avg_cpu_usage_percent) AS DECIMAL(38,12)), 1) AS DOUBLE) AS avg_cpu_pct,
  CAST(ROUND(CAST(AVG(avg_gpu_utilization) AS DECIMAL(38,12)), 1) AS DOUBLE) AS avg_gpu_pct,
  CAST(ROUND(CAST(AVG(avg_mem_usage_percent) AS DECIMAL(38,12)), 1) AS DOUBLE) AS avg_mem_pct,
  CAST(ROUND(CAST((SUM(total_disk_read_bytes) + SUM(total_disk_write_bytes)) / 1048576.0 AS DECIMAL(38,12)), 1) AS DOUBLE) AS total_disk_mb,
  CAST(ROUND(CAST(SUM(total_net_rx_bytes) / 1048576.0 AS DECIMAL(38,12)), 1) AS DOUBLE) AS net_rx_mb,
  CAST(ROUND(CAST(SUM(total_net_tx_bytes) / 1048576.0 AS DECIMAL(38,12)), 1) AS DOUBLE) AS net_tx_mb
FROM node_status_hourly WHERE bucket_time >= (SELECT MAX(bucket_time) FROM node_status_hourly) - INTERVAL 6 HOUR""",
    "node_status_hourly"))
def q_cluster_stats(t: Telemetry) -> DataFrame:
    """AGG-13, FLT-5: cluster averages over the last 6 hours as of the newest bucket."""
    return usage.cluster_stats(t.node_status_hourly(), "6h", t.newest_hour())


@query("range_filter", sql("""
SELECT * FROM node_status_hourly
WHERE bucket_time >= (SELECT MAX(bucket_time) FROM node_status_hourly) - INTERVAL 1 HOUR""", "node_status_hourly"))
def q_range_filter(t: Telemetry) -> DataFrame:
    """FLT-5: an unknown range key falls back to the default (1h) interval."""
    h = t.node_status_hourly()
    return usage.range_filter(h, "bogus", t.newest_hour(), usage.CLUSTER_RANGES, "1h")


@query("common_apps", sql("SELECT comm, n_users, cpu_seconds FROM common_apps", "common_apps"))
def q_common_apps(t: Telemetry) -> DataFrame:
    """AGG-18 / SET-4: apps every selected user ran, ranked by cpu."""
    return usage.common_apps(_apps(t))


@query("top_apps", sql("SELECT comm, n_users, cpu_seconds FROM common_apps ORDER BY cpu_seconds DESC, comm LIMIT 5", "common_apps"))
def q_top_apps(t: Telemetry) -> DataFrame:
    """TOP-2: the 'Top 5' selection of the common-apps list."""
    return usage.top_apps(_apps(t), 5)


@query("app_bar_share", sql("""
SELECT comm, cpu_seconds, greatest(2.0, 100.0 * cpu_seconds / coalesce((SELECT MAX(cpu_seconds) FROM common_apps), 1.0)) AS bar_pct
FROM common_apps""", "common_apps"))
def q_app_bar_share(t: Telemetry) -> DataFrame:
    """AGG-19: relative bar length against the top common app."""
    return usage.app_bar_share(_apps(t))


@query("apps_sorted", sql("SELECT * FROM usage_apps ORDER BY coalesce(peak_mem_mb, 0) DESC, username, comm", "usage_apps"))
def q_apps_sorted(t: Telemetry) -> DataFrame:
    """TOP-4: user-chosen sort column (peak memory), nulls as 0."""
    return usage.apps_sorted(_apps(t), "peak_mem_mb")


@query("app_search", sql("SELECT * FROM usage_apps WHERE contains(lower(comm), 'small')", "usage_apps"))
def q_app_search(t: Telemetry) -> DataFrame:
    """FLT-3: case-insensitive app-name search."""
    return usage.app_search(_apps(t), "Small")


@query("apps_selected", sql("""
SELECT * FROM usage_apps WHERE comm IN (SELECT comm FROM common_apps ORDER BY cpu_seconds DESC, comm LIMIT 5)""",
    "usage_apps", "common_apps"))
def q_apps_selected(t: Telemetry) -> DataFrame:
    """FLT-4: table rows of the selected apps (the top-5 common apps, selected by key)."""
    a = _apps(t)
    return usage.apps_selected(a, usage.top_apps(a, 5))


@query("pie_by_user", sql("""
SELECT username, SUM(coalesce(cpu_seconds, 0.0)) AS value FROM usage_apps GROUP BY username HAVING SUM(coalesce(cpu_seconds, 0.0)) > 0""",
    "usage_apps"))
def q_pie_by_user(t: Telemetry) -> DataFrame:
    """AGG-20: cpu slices by user."""
    return usage.pie_by_user(_apps(t), "cpu_seconds")


@query("pie_by_app", sql("""
SELECT username, comm AS name, coalesce(peak_mem_mb, 0.0) AS value FROM usage_apps WHERE coalesce(peak_mem_mb, 0.0) > 0
ORDER BY username, value DESC, name""", "usage_apps"))
def q_pie_by_app(t: Telemetry) -> DataFrame:
    """AGG-21: memory slices by app within each user, descending."""
    return usage.pie_by_app(_apps(t), "peak_mem_mb")


@query("usage_share", sql("""
SELECT username, name, value, CAST(ROUND(CAST(100.0 * value / SUM(value) OVER (PARTITION BY username) AS DECIMAL(38,12)), 1) AS DOUBLE) AS share_pct
FROM (SELECT username, comm AS name, coalesce(cpu_seconds, 0.0) AS value FROM usage_apps WHERE coalesce(cpu_seconds, 0.0) > 0) s""",
    "usage_apps"))
def q_usage_share(t: Telemetry) -> DataFrame:
    """AGG-22: each app's share of its user's cpu, in %."""
    return usage.usage_share(usage.pie_by_app(_apps(t), "cpu_seconds"), ["username"])


@query("chart_series", sql("SELECT t, username || ' - ' || comm AS series, username, comm, value FROM usage_app_ts", "usage_app_ts"))
def q_chart_series(t: Telemetry) -> DataFrame:
    """SHP-2 / SCL-16: by-app series named 'user - app'."""
    ts = usage.usage_app_timeseries(t.user_app_hourly(), t.fx.users, APP_UIDS, "cpu", RANGE_START, RANGE_END)
    return usage.chart_series(ts, "app")


_CHART_USERS = [f"Customer#{u - 1000:09d}" for u in APP_UIDS]


@query("chart_matrix", sql(
    "SELECT t, " + ", ".join(
        f"CAST(ROUND(CAST(coalesce(SUM(CASE WHEN username = '{n}' THEN value END), 0.0) AS DECIMAL(38,12)), 2) AS DOUBLE) AS \"{n}\""
        for n in _CHART_USERS) + " FROM usage_app_ts GROUP BY t", "usage_app_ts"))
def q_chart_matrix(t: Telemetry) -> DataFrame:
    """SHP-1 / SET-3: by-user chart matrix, one column per selected user, zero-filled."""
    ts = usage.usage_app_timeseries(t.user_app_hourly(), t.fx.users, APP_UIDS, "cpu", RANGE_START, RANGE_END)
    return usage.chart_matrix(usage.chart_series(ts, "user"), _CHART_USERS)


# ------------------------------------------------------------------------- fleet -------

def _live_config(t: Telemetry) -> DataFrame:
    return fleet.config_kv_pivot(t.fx.config_kv)


def _heartbeats(t: Telemetry) -> DataFrame:
    return fleet.heartbeat_parse(fleet.heartbeat_kv(t.fx.heartbeats))


def _live(t: Telemetry) -> DataFrame:
    as_of = t.fx.heartbeats.select(F.max("event_time")).scalar()
    return fleet.liveness(_live_config(t), _heartbeats(t), as_of)


def _latest_samples(t: Telemetry) -> DataFrame:
    return fleet.latest_samples(t.node_points).select("node_id", "ts", "cpu_usage_percent", "memory_usage_percent")


@query("config_kv_pivot", sql("SELECT * FROM live_config", "live_config"))
def q_config_kv_pivot(t: Telemetry) -> DataFrame:
    """SRC-5: live key-value config pivoted to one row per node."""
    return _live_config(t)


@query("heartbeat_parse", sql("SELECT * FROM hb_latest", "hb_latest"))
def q_heartbeat_parse(t: Telemetry) -> DataFrame:
    """SRC-6: heartbeat keys parsed from their JSON values."""
    return _heartbeats(t)


@query("node_liveness", sql("SELECT * FROM live_nodes", "live_nodes"))
def q_node_liveness(t: Telemetry) -> DataFrame:
    """STA-3 / JON-7: running or stopped from the newest heartbeat and the interval."""
    return _live(t)


@query("collection_settings_list", sql("SELECT * FROM settings_list ORDER BY name", "settings_list"))
def q_collection_settings_list(t: Telemetry) -> DataFrame:
    """JON-3: nodes with their collection settings, defaults 10 / 60."""
    return fleet.collection_settings_list(t.fx.nodes, t.fx.collection_settings)


@query("effective_settings", sql("""
SELECT n.id AS node_id, n.name, n.group_name, n.collect_agent AS default_agent, COALESCE(cs.interval_seconds, 10) AS interval_seconds,
  COALESCE(cs.window_seconds, 60) AS window_seconds, COALESCE(cs.collect_agent, n.collect_agent) AS collect_agent
FROM fx_nodes n LEFT JOIN fx_collection_settings cs ON n.id = cs.node_id""", "fx_nodes", "fx_collection_settings"))
def q_effective_settings(t: Telemetry) -> DataFrame:
    """JON-4: effective settings with the agent falling back to the node default."""
    return fleet.effective_settings(t.fx.nodes, t.fx.collection_settings)


@query("config_drift", sql("SELECT * FROM config_drift", "config_drift"))
def q_config_drift(t: Telemetry) -> DataFrame:
    """JON-8: database settings against the live config."""
    db = fleet.collection_settings_list(t.fx.nodes, t.fx.collection_settings)
    return fleet.config_drift(db, _live(t))


@query("latest_node_metrics", sql("SELECT * FROM latest_node_metrics", "latest_node_metrics"))
def q_latest_node_metrics(t: Telemetry) -> DataFrame:
    """WIN-1: newest hourly row per node."""
    return fleet.latest_node_metrics(t.node_usage_hourly())


@query("node_overview", sql("SELECT * FROM node_overview", "node_overview"))
def q_node_overview(t: Telemetry) -> DataFrame:
    """JON-6 / SCL-13: registry + live config + newest metrics."""
    return fleet.node_overview(t.fx.nodes, _live(t), fleet.latest_node_metrics(t.node_usage_hourly()))


@query("status_counts", sql("""
SELECT COUNT(*) AS total, CAST(count_if(status = 'active') AS BIGINT) AS active, CAST(count_if(status = 'down') AS BIGINT) AS down,
  CAST(count_if(status = 'idle') AS BIGINT) AS idle,
  CASE WHEN COUNT(*) = 0 THEN 'Critical' WHEN count_if(status = 'active') / COUNT(*) >= 0.9 THEN 'Healthy'
       WHEN count_if(status = 'active') / COUNT(*) >= 0.6 THEN 'Degraded' ELSE 'Critical' END AS health
FROM node_overview""", "node_overview"))
def q_status_counts(t: Telemetry) -> DataFrame:
    """AGG-23 / SCL-12: node status counts and the cluster health label."""
    return fleet.status_counts(q_node_overview(t))


@query("config_counters", sql("""
SELECT CAST(count_if(etcd_status = 'running') AS BIGINT) AS running, CAST(count_if(etcd_status = 'stopped') AS BIGINT) AS stopped,
  CAST(count_if(etcd_loaded AND NOT etcd_synced) AS BIGINT) AS out_of_sync FROM config_drift""", "config_drift"))
def q_config_counters(t: Telemetry) -> DataFrame:
    """AGG-24: running / stopped / out-of-sync settings counters."""
    return fleet.config_counters(q_config_drift(t))


@query("node_search", sql("""
SELECT * FROM node_overview WHERE status = 'down' AND (contains(lower(name), 'supplier#0000000') OR contains(ip, 'Supplier#0000000'))""",
    "node_overview"))
def q_node_search(t: Telemetry) -> DataFrame:
    """FLT-2: status equals and name (case-insensitive) or ip contains."""
    return usage.node_search(q_node_overview(t), "down", "Supplier#0000000")


@query("node_hourly", sql("""
SELECT bucket_time, avg_cpu_usage_percent, max_cpu_usage_percent, avg_mem_usage_percent, max_mem_used_bytes,
  avg_gpu_utilization, max_gpu_temperature, total_gpu_power_watts, total_disk_read_bytes, total_disk_write_bytes,
  total_net_rx_bytes, total_net_tx_bytes, is_active
FROM node_status_hourly WHERE node_id = 'node_3' AND bucket_time >= (SELECT MAX(bucket_time) FROM node_status_hourly) - INTERVAL 1 DAY
ORDER BY bucket_time""", "node_status_hourly"))
def q_node_hourly(t: Telemetry) -> DataFrame:
    """SRC-4 / FLT-5: one node's hourly rows for the last day, explicit columns, ordered."""
    return fleet.node_hourly(t.node_status_hourly(), "node_3", "1d", t.newest_hour())


@query("cluster_now", sql("""
SELECT (SELECT COUNT(*) FROM latest_samples) AS active_nodes,
  (SELECT COUNT(DISTINCT p.uid) FROM proc_points p JOIN latest_samples l ON l.node_id = p.node_id AND l.ts = p.ts WHERE p.uid >= 1000) AS active_users,
  (SELECT CAST(CAST(AVG(cpu_usage_percent) AS DECIMAL(38,9)) AS DOUBLE) FROM latest_samples) AS avg_cpu_pct,
  (SELECT CAST(CAST(AVG(memory_usage_percent) AS DECIMAL(38,9)) AS DOUBLE) FROM latest_samples) AS avg_mem_pct,
  (SELECT CAST(CAST(AVG(utilization_percent) AS DECIMAL(38,9)) AS DOUBLE) FROM latest_gpu) AS avg_gpu_util_pct,
  (SELECT CAST(CAST(AVG(memory_used_mib) AS DECIMAL(38,9)) AS DOUBLE) FROM latest_gpu) AS avg_gpu_mem_mib,
  (SELECT CAST(CAST(AVG(temperature_celsius) AS DECIMAL(38,9)) AS DOUBLE) FROM latest_gpu) AS avg_gpu_temp_c,
  (SELECT CAST(CAST(AVG(power_watts) AS DECIMAL(38,9)) AS DOUBLE) FROM latest_gpu) AS avg_gpu_power_w""",
    "latest_samples", "latest_gpu", "proc_points"))
def q_cluster_now(t: Telemetry) -> DataFrame:
    """AGG-29: aggregates over each node's newest sample."""
    return fleet.cluster_now(t.node_points, t.gpu_points, t.process_points)


@query("max_metric_node", sql("""
SELECT metric, arg_min(node_id, (-value, node_id)) AS node_id, MAX(value) AS value FROM (
  SELECT node_id, 'cpu' AS metric, cpu_usage_percent AS value FROM latest_samples
  UNION ALL SELECT node_id, 'cpu_mem', memory_usage_percent FROM latest_samples
  UNION ALL SELECT node_id, 'gpu', utilization_percent FROM latest_gpu
  UNION ALL SELECT node_id, 'gpu_mem', CAST(memory_used_mib AS DOUBLE) FROM latest_gpu
  UNION ALL SELECT node_id, 'gpu_temp', temperature_celsius FROM latest_gpu
  UNION ALL SELECT node_id, 'gpu_power', power_watts FROM latest_gpu) x
WHERE value IS NOT NULL GROUP BY metric""", "latest_samples", "latest_gpu"))
def q_max_metric_node(t: Telemetry) -> DataFrame:
    """TOP-6: node with the max newest value of each panel metric."""
    t = t.without_processes
    ls = fleet.latest_samples(t.node_points)
    return fleet.max_metric_node(ls, fleet.samples_at_latest(t.gpu_points, ls))


@query("free_nodes", sql("""
SELECT node_id, ts, cpu_usage_percent, memory_usage_percent FROM latest_samples
WHERE cpu_usage_percent < 50.0 AND memory_usage_percent < 80.0 ORDER BY cpu_usage_percent, node_id""", "latest_samples"))
def q_free_nodes(t: Telemetry) -> DataFrame:
    """TOP-7: nodes whose newest sample is under the usage bounds (cpu < 50 %, mem < 80 %)."""
    return fleet.free_nodes(fleet.latest_samples(t.without_processes.node_points), 50.0, 80.0)


@query("gate_running", sql("""
SELECT report_id, node_id, "timestamp" FROM v_headers WHERE node_id IN (SELECT node_id FROM live_config WHERE status = 'running')""",
    "v_headers", "live_config"))
def q_gate_running(t: Telemetry) -> DataFrame:
    """STA-4: only reports of nodes configured as running pass (missing -> stopped)."""
    return fleet.gate_running(t.headers.select("report_id", "node_id", "timestamp"), _live_config(t))


# How old the last status message of a node may be to count (the fixture's are hours apart).
STATUS_MAX_AGE = 6 * 3600


@query("gate_at_report_time", sql(f"""
SELECT r.report_id, r.node_id, r.event_time FROM v_headers r
ASOF JOIN (SELECT node_id, event_time, arg_max(status, event_id) AS status FROM fx_heartbeats GROUP BY ALL) c
  ON c.node_id = r.node_id AND r.event_time >= c.event_time
WHERE c.status = 'alive' AND epoch_us(r.event_time) - epoch_us(c.event_time) <= {STATUS_MAX_AGE * 1_000_000}""", "v_headers", "fx_heartbeats"))
def q_gate_at_report_time(t: Telemetry) -> DataFrame:
    """STA-4: reports of nodes that were running when they sent them."""
    return fleet.gate_at_report_time(t.headers.select("report_id", "node_id", "event_time"), t.fx.status_changes, STATUS_MAX_AGE)


@query("liveness_sessions", sql(f"""
SELECT node_id, MIN(event_time) AS alive_from, MAX(event_time) AS last_heartbeat,
  make_timestamp(epoch_us(MAX(event_time)) + any_value(gap)) AS lapsed_at, COUNT(*) AS n_heartbeats
FROM (SELECT *, SUM(CASE WHEN prev IS NULL OR epoch_us(event_time) - epoch_us(prev) > gap THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS s
      FROM (SELECT h.node_id, h.event_time, LAG(h.event_time) OVER (PARTITION BY h.node_id ORDER BY h.event_time) AS prev,
              CAST(CASE WHEN c.node_id IS NULL THEN 60 ELSE coalesce({parse_float_sql("coalesce(c.heartbeat_interval, '20')")} * 3, 60) END AS BIGINT) * 1000000 AS gap
            FROM fx_heartbeats h LEFT JOIN live_config c ON c.node_id = h.node_id WHERE h.status = 'alive') a) b
GROUP BY node_id, s""", "fx_heartbeats", "live_config"))
def q_liveness_sessions(t: Telemetry) -> DataFrame:
    """STA-3 as sessions: when each node was alive, and when each stretch lapsed."""
    return fleet.liveness_sessions(t.fx.heartbeats, fleet.heartbeat_gap(_live_config(t)))


# ------------------------------------------------------------------------ alerts -------

def threshold_rules_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, THRESHOLD_RULES, "metric_name string, max_value double, min_value double")


def alert_rules_df(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, ALERT_RULES, "id string, name string, node_group string, resource string, operator string, "
                            "threshold double, severity string, enabled boolean")


def _validated_reports(t: Telemetry) -> DataFrame:
    return t.validated_reports


@query("node_metrics", sql("SELECT * FROM node_metrics", "node_metrics"))
def q_node_metrics(t: Telemetry) -> DataFrame:
    """AGG-3: per-report metric map (long form) on validated nested reports."""
    m = stages.node_metrics(_validated_reports(t))
    return m.select("report_id", "node_id", "timestamp", "metric_name", "metric_value", "is_int")


def _threshold_alerts(t: Telemetry) -> DataFrame:
    return alerts.threshold_alerts(_validated_reports(t), threshold_rules_df(t.spark))


@query("threshold_alerts", sql("SELECT * FROM threshold_alerts", "threshold_alerts"))
def q_threshold_alerts(t: Telemetry) -> DataFrame:
    """STR-3 / JON-10: threshold violations per report (below_min wins)."""
    return _threshold_alerts(t).select("report_id", "node_id", "timestamp", "metric_name", "metric_value", "is_int",
                                       "threshold_max", "threshold_min", "violation_type")


@query("alert_records", sql("SELECT * FROM alert_records", "alert_records"))
def q_alert_records(t: Telemetry) -> DataFrame:
    """SNK-6 / SCL-15: violations shaped as alert messages."""
    return alerts.alert_records(_threshold_alerts(t), "collect_agent_1")


@query("group_alerts", sql("SELECT * FROM group_alerts", "group_alerts"))
def q_group_alerts(t: Telemetry) -> DataFrame:
    """STR-4 / JON-13: operator-exact alert rules per node group on hourly node values."""
    return alerts.group_alerts(t.node_status_hourly(), t.fx.nodes, alert_rules_df(t.spark))


@query("alert_episodes", sql("""
SELECT rule_id || ':' || node_id || ':' || strftime(MIN(created_at), '%Y%m%d%H') AS id, rule_id, node_id, MAX(severity) AS severity, MAX(message) AS message,
  MIN(created_at) AS started_at, MAX(created_at) + INTERVAL 1 HOUR AS ended_at, COUNT(*) AS n_hours,
  CASE WHEN any_value(operator) IN ('>', '>=') THEN MAX(value) ELSE MIN(value) END AS worst_value
FROM (SELECT g.*, r.operator, epoch(g.created_at) // 3600 - row_number() OVER (PARTITION BY g.rule_id, g.node_id ORDER BY g.created_at) AS run
      FROM group_alerts g JOIN alert_rules r ON r.id = g.rule_id) x
GROUP BY rule_id, node_id, run""", "group_alerts", "alert_rules"))
def q_alert_episodes(t: Telemetry) -> DataFrame:
    """STR-4: unbroken runs of breached hours per rule and node."""
    rules = alert_rules_df(t.spark)
    return alerts.alert_episodes(alerts.group_alerts(t.node_status_hourly(), t.fx.nodes, rules), rules)


@query("notifications_feed", sql("""
SELECT n.* EXCLUDE (s), nd.name AS node_name,
  CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
       WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age
FROM (SELECT *, CAST(floor(((SELECT epoch_us(MAX(created_at)) FROM fx_notifications) - epoch_us(created_at)) / 1000000) AS BIGINT) AS s
      FROM fx_notifications) n
LEFT JOIN fx_nodes nd ON n.node_id = nd.id ORDER BY n.created_at DESC, n.id DESC""", "fx_notifications", "fx_nodes"))
def q_notifications_feed(t: Telemetry) -> DataFrame:
    """JON-5 / SCL-11: notifications with node name and age label."""
    n = t.fx.notifications
    return alerts.notifications_feed(n, t.fx.nodes, n.select(F.max("created_at")).scalar())


@query("unread_notifications", sql("SELECT * FROM fx_notifications WHERE NOT acknowledged", "fx_notifications"))
def q_unread_notifications(t: Telemetry) -> DataFrame:
    """FLT-8: unacknowledged notifications."""
    return alerts.unread(t.fx.notifications)


@query("audit_recent", sql("SELECT * FROM fx_audit_logs ORDER BY created_at DESC, id DESC LIMIT 100", "fx_audit_logs"))
def q_audit_recent(t: Telemetry) -> DataFrame:
    """TOP-5: newest 100 audit rows."""
    return alerts.audit_recent(t.fx.audit_logs, 100)


# ---------------------------------------------------------------- collect stages -------

def _collect(t: Telemetry) -> DataFrame:
    run = t.__dict__.get("_collect_run")
    if run is None:
        run = t.__dict__["_collect_run"] = stages.run_collect(
            t.fx.reports, None, None, COLLECT_PREFIXES, "collect_agent_1", THRESHOLD_RULES, F.col("timestamp"))
    return run


@query("valid_reports", sql("""
SELECT r.report_id, r.node_id, r."timestamp", CAST(c.n AS INTEGER) AS n_processes, r.sm_ok AS has_system_metrics
FROM v_reports r JOIN (SELECT report_id, COUNT(*) AS n FROM v_procs GROUP BY report_id) c ON c.report_id = r.report_id""",
    "v_reports", "v_procs"))
def q_valid_reports(t: Telemetry) -> DataFrame:
    """VAL-1 / VAL-4: reports that survive validation (nested path)."""
    v = t.validated_reports
    return v.select("report_id", "node_id", "timestamp", F.size("processes").alias("n_processes"),
                    F.col("system_metrics").isNotNull().alias("has_system_metrics"))


@query("valid_system_metrics", sql("SELECT report_id, sm_valid AS system_metrics_valid FROM sm_all WHERE has_system_metrics", "sm_all"))
def q_valid_system_metrics(t: Telemetry) -> DataFrame:
    """VAL-2: whether each report's system metrics pass the range checks."""
    a = stages.annotate_validation(t.fx.reports.filter(F.col("system_metrics").isNotNull()))
    return a.select("report_id", F.col("system_metrics").isNotNull().alias("system_metrics_valid"))


@query("valid_processes", sql("SELECT report_id, pos, pid, cpu_ontime_ns, uid, comm FROM v_procs", "v_procs"))
def q_valid_processes(t: Telemetry) -> DataFrame:
    """VAL-3: processes passing pid / cpu / comm checks (flat path)."""
    return t.valid_processes.select("report_id", "pos", "pid", "cpu_ontime_ns", "uid", "comm")


@query("rejects", sql("""
SELECT h.report_id, h.node_id, 'no_valid_processes' AS _reject_reason, CAST(coalesce(c.n, 0) AS BIGINT) AS invalid_processes
FROM v_headers h LEFT JOIN proc_counts c ON c.report_id = h.report_id
WHERE h.report_id NOT IN (SELECT report_id FROM v_procs)
UNION ALL
SELECT r.report_id, r.node_id, 'invalid_header', CAST(c.n AS BIGINT) FROM fx_reports r JOIN proc_counts c ON c.report_id = r.report_id
WHERE NOT coalesce(r.node_id <> '' AND r."timestamp" IS NOT NULL, FALSE)""", "v_headers", "proc_counts", "v_procs", "fx_reports"))
def q_rejects(t: Telemetry) -> DataFrame:
    """STR-2: reports dropped by validation, with the reason and rejected process count."""
    r = stages.rejects(stages.annotate_validation(t.fx.reports))
    return r.select("report_id", "node_id", "_reject_reason", F.col("_invalid").alias("invalid_processes"))


@query("field_projection", sql(f"""
SELECT report_id, vpos AS pos, pid, cpu_ontime_ns, CAST(0 AS BIGINT) AS uid, comm, CAST(0 AS BIGINT) AS read_bytes,
  CAST(0 AS BIGINT) AS write_bytes, CAST(0 AS BIGINT) AS net_rx_bytes, CAST(0 AS BIGINT) AS net_tx_bytes,
  CAST(0 AS BIGINT) AS avg_rss_bytes, '' AS process_name, CAST(0 AS BIGINT) AS gpu_used_memory_mib,
  '[''pid'', ''comm'', ''cpu_ontime_ns'']' AS exported_process_fields
FROM v_procs_pos""", "v_procs_pos"))
def q_field_projection(t: Telemetry) -> DataFrame:
    """PRJ-1: allow-listed process fields kept, others zeroed; unknown names ignored."""
    p = stages.project_fields(t.validated_reports, PROJECTED_FIELDS)
    x = p.select("report_id", F.col("metadata")["exported_process_fields"].alias("exported_process_fields"),
                 F.posexplode("processes").alias("pos0", "p"))
    return x.select("report_id", (F.col("pos0") + 1).cast("bigint").alias("pos"), *[F.col(f"p.{n}") for n in stages.PROCESS_FIELD_NAMES],
                    "exported_process_fields")


@query("prefix_aggregation", sql("SELECT * FROM prefix_merged", "prefix_merged"))
def q_prefix_aggregation(t: Telemetry) -> DataFrame:
    """AGG-2 / WIN-5 / SET-1: longest-prefix merge inside each report."""
    m = stages.prefix_merge(t.validated_reports, COLLECT_PREFIXES)
    x = m.select("report_id", F.posexplode("processes").alias("pos0", "p"))
    return x.select("report_id", (F.col("pos0") + 1).alias("pos"), "p.pid", "p.uid", "p.comm", "p.process_name",
                    *[F.col(f"p.{c}") for c in stages.SUMMED_FIELDS])


@query("enrich_reports", sql("""
SELECT report_id, node_id, 'collect_agent_1' AS collect_agent_id, "timestamp" AS received_timestamp,
  'enriched' AS processing_stage, '1.0.0' AS collect_agent_version FROM v_reports""", "v_reports"))
def q_enrich_reports(t: Telemetry) -> DataFrame:
    """PRJ-3: agent id, receive time, stage and version stamped on each report."""
    e = stages.enrich(t.validated_reports, "collect_agent_1", F.col("timestamp"))
    return e.select("report_id", "node_id", "collect_agent_id", "received_timestamp",
                    F.col("metadata")["processing_stage"].alias("processing_stage"),
                    F.col("metadata")["collect_agent_version"].alias("collect_agent_version"))


@query("top_processes", sql("""
SELECT report_id, node_id, rank, pid, comm, cpu_ontime_ns FROM (
  SELECT report_id, node_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY cpu_ontime_ns DESC, vpos) AS INTEGER) AS rank,
    pid, comm, cpu_ontime_ns FROM v_procs_pos) x WHERE rank <= 5""", "v_procs_pos"))
def q_top_processes(t: Telemetry) -> DataFrame:
    """TOP-1: top 5 processes by cpu time per report."""
    return stages.top_processes(t.validated_reports, 5)


@query("collect_end_to_end", sql("SELECT * FROM collect_out", "collect_out"))
def q_collect_end_to_end(t: Telemetry) -> DataFrame:
    """STR-1: default stage order (validate, project, prefix-merge, enrich, threshold) on
    nested reports; one summary row per surviving report."""
    r = _collect(t).filter(F.col("_reject_reason").isNull())
    cpu = F.aggregate("processes", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p["cpu_ontime_ns"], F.lit(0)))
    return r.select("report_id", "node_id", "timestamp", F.size("processes").alias("n_processes"), cpu.alias("cpu_total_ns"),
                    "collect_agent_id", F.col("metadata")["processing_stage"].alias("processing_stage"),
                    F.col("_alerts").alias("n_alerts"))


@query("collect_accounting", sql("""
SELECT (SELECT COUNT(*) FROM fx_reports) AS reports_in, (SELECT COUNT(*) FROM v_reports) AS reports_out,
  CAST((SELECT COUNT(*) FROM fx_processes) - (SELECT COUNT(*) FROM v_procs) AS BIGINT) AS invalid_count,
  CAST(0 AS BIGINT) AS filtered_count, CAST((SELECT SUM(n_alerts) FROM collect_out) AS BIGINT) AS alerts_triggered,
  (SELECT COUNT(*) FROM sm_all WHERE has_system_metrics AND NOT sm_valid) AS system_metrics_nulled""",
    "fx_reports", "v_reports", "fx_processes", "v_procs", "collect_out", "sm_all"))
def q_collect_accounting(t: Telemetry) -> DataFrame:
    """AGG-26: filtered / invalid / alert totals over the whole run."""
    return stages.accounting(_collect(t))


@query("ingest_counters", sql("""
SELECT node_id, COUNT(*) AS reports_received, CAST(SUM(n) AS BIGINT) AS processes_received FROM proc_counts GROUP BY node_id""",
    "proc_counts"))
def q_ingest_counters(t: Telemetry) -> DataFrame:
    """AGG-27: reports and processes received per node stream."""
    r = t.fx.reports
    return r.groupBy("node_id").agg(F.count(F.lit(1)).alias("reports_received"),
                                    F.sum(F.size("processes")).cast("bigint").alias("processes_received"))


@query("decode_reports", sql("""
SELECT report_id, node_id, "timestamp", CAST(n AS INTEGER) AS n_processes, cpu AS cpu_total_ns, has_system_metrics
FROM proc_counts JOIN (SELECT report_id, "timestamp", has_system_metrics FROM fx_reports) r USING (report_id)""",
    "proc_counts", "fx_reports"))
def q_decode_reports(t: Telemetry) -> DataFrame:
    """SRC-2: reports round-tripped through their JSON wire form and decoded with the
    loose wire schema (numbers may arrive as text)."""
    wire = ingest.encode_reports(t.fx.reports, extra=["report_id"])
    d = ingest.decode_reports(wire, extra={"report_id": "bigint"})
    cpu = F.aggregate("processes", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p["cpu_ontime_ns"], F.lit(0)))
    return d.select("report_id", "node_id", "timestamp", F.size("processes").alias("n_processes"), cpu.alias("cpu_total_ns"),
                    F.col("system_metrics").isNotNull().alias("has_system_metrics"))


def _wire_figures(wire: DataFrame) -> DataFrame:
    """What the JSON values hold, read back from their text (number formats differ between
    engines, so the texts themselves aren't compared)."""
    def keys(text: Column) -> Column:
        return F.array_join(F.array_sort(F.json_object_keys(text)), ",")
    procs = F.from_json(F.get_json_object("value", "$.processes"), "array<struct<pid:bigint,cpu_ontime_ns:bigint>>")
    return wire.select(
        "key", F.get_json_object("value", "$.timestamp").cast("bigint").alias("timestamp"), keys(F.col("value")).alias("keys"),
        keys(F.get_json_object("value", "$.processes[0]")).alias("process_keys"), F.size(procs).cast("bigint").alias("n_processes"),
        F.get(procs, 0)["pid"].alias("first_pid"),
        F.aggregate(procs, F.lit(0).cast("bigint"), lambda a, p: a + p["cpu_ontime_ns"]).alias("cpu_ontime_ns"))


def _wire_sql(process_keys: list[str]) -> str:
    keys = ["collection_window_seconds", "metadata", "node_id", "processes", "timestamp"]
    return sql(f"""
SELECT any_value(r.node_id) AS key, any_value(r."timestamp") AS "timestamp",
  CASE WHEN any_value(r.sm_ok) THEN '{",".join(sorted([*keys, "system_metrics"]))}' ELSE '{",".join(keys)}' END AS keys,
  '{",".join(sorted(process_keys))}' AS process_keys, count(*) AS n_processes, arg_min(p.pid, p.pos) AS first_pid,
  CAST(sum(p.cpu_ontime_ns) AS BIGINT) AS cpu_ontime_ns
FROM v_reports r JOIN v_procs p ON p.report_id = r.report_id GROUP BY r.report_id""", "v_reports", "v_procs")


@query("publish_json", _wire_sql([*stages.PROCESS_FIELD_NAMES, "metadata"]))
def q_publish_json(t: Telemetry) -> DataFrame:
    """SNK-1: Kafka-shaped (key, value) rows; null system metrics omitted from the JSON."""
    return _wire_figures(ingest.encode_reports(t.validated_reports))


@query("publish_projected", _wire_sql(stages.normalize_fields(PROJECTED_FIELDS)))
def q_publish_projected(t: Telemetry) -> DataFrame:
    """PRJ-2: exported JSON holds only the process keys that the report's metadata lists."""
    p = stages.project_fields(t.validated_reports, PROJECTED_FIELDS)
    return _wire_figures(ingest.encode_reports(p))


@query("sampler", sql(f"""
SELECT report_id, node_id, "timestamp" FROM v_reports
WHERE CAST(('0x' || substr(md5(node_id || '|' || CAST("timestamp" AS VARCHAR)), 1, 8)) AS BIGINT) % 10000 < {int(SAMPLE_RATE * 10000)}""",
    "v_reports"))
def q_sampler(t: Telemetry) -> DataFrame:
    """UDF-1: deterministic md5-bucket sample of reports (rate 0.25)."""
    return stages.sample(t.validated_reports, SAMPLE_RATE).select("report_id", "node_id", "timestamp")


@query("system_process_filter", sql("""
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY pos) AS BIGINT) AS pos, pid, comm FROM v_procs
WHERE NOT (starts_with(comm, 'ECONOMY') OR starts_with(comm, 'PROMO'))""", "v_procs"))
def q_system_process_filter(t: Telemetry) -> DataFrame:
    """FLT-9: processes whose name starts with a listed prefix are dropped."""
    f = stages.system_process_filter(t.validated_reports, SYSTEM_PREFIXES)
    x = f.select("report_id", F.posexplode("processes").alias("pos0", "p"))
    return x.select("report_id", (F.col("pos0") + 1).cast("bigint").alias("pos"), "p.pid", "p.comm")


@query("window_aggregator", sql("""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, node_id, uid, comm, CAST(SUM(cpu_ontime_ns) AS BIGINT) AS cpu_ontime_ns,
  CAST(SUM(read_bytes + write_bytes) AS BIGINT) AS disk_bytes, CAST(SUM(net_rx_bytes + net_tx_bytes) AS BIGINT) AS net_bytes,
  CAST(MAX(avg_rss_bytes) AS BIGINT) AS max_rss_bytes, CAST(SUM(process_count) AS BIGINT) AS process_count
FROM proc_points GROUP BY 1, 2, 3, 4""", "proc_points"))
def q_window_aggregator(t: Telemetry) -> DataFrame:
    """UDF-2: tumbling 5-minute aggregate per (node, uid, comm)."""
    return rollup.window_aggregate(t.process_points, "5 minutes")


# ------------------------------------------------------------------- host samples ------

@query("oncpu_from_switches", sql("SELECT * FROM oncpu", "oncpu"))
def q_oncpu_from_switches(t: Telemetry) -> DataFrame:
    """WIN-4 / HST-1: on-CPU time per pid from the context-switch trace (lag attribution)."""
    return host.oncpu_from_switches(t.fx.switches, "lag")


@query("process_lifecycle", sql("""
SELECT * FROM lifecycle""", "lifecycle"))
def q_process_lifecycle(t: Telemetry) -> DataFrame:
    """HST-2: state of each pid after its last fork."""
    return host.process_lifecycle(t.fx.sched_events)


@query("disk_bytes", sql("SELECT * FROM disk_bytes", "disk_bytes"))
def q_disk_bytes(t: Telemetry) -> DataFrame:
    """HST-3: disk bytes per pid from syscall returns."""
    return host.disk_bytes(t.fx.syscalls)


@query("net_bytes", sql("SELECT * FROM net_bytes", "net_bytes"))
def q_net_bytes(t: Telemetry) -> DataFrame:
    """HST-4: network bytes per pid from syscall returns."""
    return host.net_bytes(t.fx.syscalls)


@query("avg_rss", sql("SELECT * FROM avg_rss", "avg_rss"))
def q_avg_rss(t: Telemetry) -> DataFrame:
    """HST-5: mean RSS per pid, all-zero pids dropped."""
    return host.avg_rss(t.fx.rss_samples)


@query("cpu_percent_from_counters", sql("""
SELECT node_id, ts, seq, CASE WHEN pt IS NULL THEN 0.0 WHEN total - pt = 0 THEN 0.0
  ELSE CAST(ROUND(CAST(100.0 * (1.0 - (idle2 - pi) / (total - pt)) AS DECIMAL(38,12)), 2) AS DOUBLE) END AS cpu_usage_percent
FROM (SELECT node_id, ts, event_id AS seq, idle2, total, LAG(idle2) OVER w AS pi, LAG(total) OVER w AS pt
      FROM (SELECT *, event_id * 37 + CAST(floor(value) AS BIGINT) + event_id * 3 AS idle2, event_id * 100 + 1000 AS total FROM host_events) c
      WINDOW w AS (PARTITION BY node_id ORDER BY ts, event_id)) x""", "host_events"))
def q_cpu_percent_from_counters(t: Telemetry) -> DataFrame:
    """WIN-3 / HST-6: CPU% from cumulative idle / total counters."""
    return host.cpu_percent_from_counters(t.fx.cpu_counters)


@query("memory_percent", sql("""
SELECT node_id, ts, event_id AS seq, total - available AS memory_used_bytes,
  CASE WHEN total = 0 THEN 0.0 ELSE CAST(ROUND(CAST(100.0 * (total - available) / total AS DECIMAL(38,10)), 2) AS DOUBLE) END AS memory_usage_percent
FROM (SELECT node_id, ts, event_id, (user_id % 7) * 1048576 AS total, CAST(floor(value) AS BIGINT) * 4096 AS available FROM host_events) x""",
    "host_events"))
def q_memory_percent(t: Telemetry) -> DataFrame:
    """SCL-8 / HST-6: used memory and percent, total 0 -> 0."""
    return host.memory_usage(t.fx.mem_counters)


@query("gpu_csv_parse", sql("""
SELECT report_id, CAST(trim(p[1]) AS INTEGER) AS gpu_index, trim(p[2]) AS gpu_name,
  coalesce(TRY_CAST(trim(p[3]) AS DOUBLE), 0.0) AS utilization_percent, coalesce(TRY_CAST(trim(p[4]) AS DOUBLE), 0.0) AS temperature_celsius,
  coalesce(TRY_CAST(trim(p[5]) AS DOUBLE), 0.0) AS power_watts, coalesce(TRY_CAST(trim(p[6]) AS DOUBLE), 0.0) AS power_limit_watts,
  coalesce(TRY_CAST(TRY_CAST(trim(p[7]) AS DOUBLE) AS BIGINT), 0) AS memory_used_mib,
  coalesce(TRY_CAST(TRY_CAST(trim(p[8]) AS DOUBLE) AS BIGINT), 0) AS memory_total_mib
FROM (SELECT report_id, string_split(line, ',') AS p FROM (
        SELECT report_id, concat_ws(', ', CAST(gpu_index AS VARCHAR), 'GPU-' || CAST(report_id % 4 AS VARCHAR),
          CAST(CAST(utilization_percent AS BIGINT) AS VARCHAR), CAST(CAST(temperature_celsius AS BIGINT) AS VARCHAR),
          CAST(CAST(power_watts AS BIGINT) AS VARCHAR), 'N/A', CAST(memory_used_mib AS VARCHAR), '24576') AS line FROM fx_gpus
        UNION ALL SELECT event_id, props FROM events) l) x
WHERE len(p) >= 8 AND TRY_CAST(trim(p[1]) AS INTEGER) IS NOT NULL""", "fx_gpus"))
def q_gpu_csv_parse(t: Telemetry) -> DataFrame:
    """SCL-19 / HST-7: GPU CSV text -> typed rows; short or bad lines dropped, N/A -> 0."""
    return host.gpu_csv_parse(t.fx.gpu_csv_lines)


@query("gpu_proc_csv_parse", sql("SELECT * FROM gpu_proc", "gpu_proc"))
def q_gpu_proc_csv_parse(t: Telemetry) -> DataFrame:
    """SCL-20 / HST-7: GPU compute-app CSV with header aliases and 'MiB' stripped."""
    return host.gpu_proc_csv_parse(t.fx.gpu_proc_lines)


@query("merge_process_samples", sql("""
SELECT c.node_id, c.pid, CAST(coalesce(c.cpu_ontime_ns, 0) AS BIGINT) AS cpu_ontime_ns, CAST(coalesce(c.uid, -1) AS BIGINT) AS uid,
  coalesce(c.comm, '') AS comm, CAST(coalesce(d.read_bytes, 0) AS BIGINT) AS read_bytes, CAST(coalesce(d.write_bytes, 0) AS BIGINT) AS write_bytes,
  CAST(coalesce(n.net_rx_bytes, 0) AS BIGINT) AS net_rx_bytes, CAST(coalesce(n.net_tx_bytes, 0) AS BIGINT) AS net_tx_bytes,
  CAST(coalesce(r.avg_rss_bytes, 0) AS BIGINT) AS avg_rss_bytes, CAST(coalesce(g.used_memory_mib, 0) AS BIGINT) AS gpu_used_memory_mib,
  CAST(coalesce(y.ppid, 0) AS BIGINT) AS ppid, coalesce(g.process_name, '') AS process_name, coalesce(y.exited, FALSE) AS exited
FROM oncpu c LEFT JOIN lifecycle y ON y.node_id = c.node_id AND y.pid = c.pid LEFT JOIN disk_bytes d ON d.node_id = c.node_id AND d.pid = c.pid LEFT JOIN net_bytes n ON n.node_id = c.node_id AND n.pid = c.pid
LEFT JOIN avg_rss r ON r.node_id = c.node_id AND r.pid = c.pid
LEFT JOIN (SELECT node_id, pid, arg_max(used_memory_mib, line_no) AS used_memory_mib, arg_max(process_name, line_no) AS process_name
           FROM gpu_proc GROUP BY 1, 2) g ON g.node_id = c.node_id AND g.pid = c.pid""", "lifecycle", "oncpu", "disk_bytes", "net_bytes", "avg_rss", "gpu_proc"))
def q_merge_process_samples(t: Telemetry) -> DataFrame:
    """JON-9 / HST-8: per-pid merge of cpu, disk, net, RSS and GPU samples (cpu drives)."""
    fx = t.fx
    gpu = host.gpu_proc_csv_parse(fx.gpu_proc_lines)
    gpu = gpu.groupBy("node_id", "pid").agg(F.max_by("used_memory_mib", "line_no").alias("used_memory_mib"),
                                            F.max_by("process_name", "line_no").alias("process_name"))
    return host.merge_process_samples(host.oncpu_from_switches(fx.switches), host.disk_bytes(fx.syscalls),
                                      host.net_bytes(fx.syscalls), host.avg_rss(fx.rss_samples), gpu,
                                      host.process_lifecycle(fx.sched_events))


@query("active_exited_union", sql("""
SELECT node_id, pid, CAST(SUM(cpu_ontime_ns) AS BIGINT) AS cpu_ontime_ns, arg_min(uid, exited) AS uid, arg_min(comm, exited) AS comm,
  bool_and(exited) AS exited
FROM (SELECT node_id, pid, cpu_ontime_ns, uid, comm, FALSE AS exited FROM oncpu
      UNION ALL
      SELECT node_id, pid, SUM(CAST(floor(value * 1000) AS BIGINT)) * 1000, arg_max(user_id, (ts, event_id)), arg_max(event_type, (ts, event_id)), TRUE
      FROM host_events WHERE event_type = 'error' GROUP BY node_id, pid) u
GROUP BY 1, 2""", "oncpu", "host_events"))
def q_active_exited_union(t: Telemetry) -> DataFrame:
    """SET-2: active and exited per-pid rows merged; exited only if not active."""
    return host.active_exited_union(host.oncpu_from_switches(t.fx.switches), t.fx.exited_processes)


@query("oncpu_by_window", sql("SELECT * FROM oncpu_window", "oncpu_window"))
def q_oncpu_by_window(t: Telemetry) -> DataFrame:
    """HST-1 / WIN-4 per collection window: runs on a CPU split at window borders."""
    return host_windows.oncpu_by_window(t.fx.switches, HOST_WINDOW)


@query("process_lives", sql("SELECT * FROM lives", "lives"))
def q_process_lives(t: Telemetry) -> DataFrame:
    """HST-2: every life of a pid, from fork to exit."""
    return host_windows.process_lives(t.fx.sched_events)


@query("usage_by_life", sql("""
SELECT coalesce(u.node_id, l.node_id) AS node_id, coalesce(u.pid, l.pid) AS pid, coalesce(u.life_start, l.life_start) AS life_start,
  coalesce(u.life_seq, l.life_seq) AS life_seq, l.ppid, l.comm, l.life_end, coalesce(l.exited, FALSE) AS exited,
  CAST(coalesce(u.cpu, 0) AS BIGINT) AS cpu_ontime_ns, CAST(coalesce(u.rb, 0) AS BIGINT) AS read_bytes, CAST(coalesce(u.wb, 0) AS BIGINT) AS write_bytes,
  CAST(coalesce(u.rx, 0) AS BIGINT) AS net_rx_bytes, CAST(coalesce(u.tx, 0) AS BIGINT) AS net_tx_bytes, CAST(coalesce(u.rss, 0) AS BIGINT) AS avg_rss_bytes
FROM (
  SELECT node_id, pid, life_start, life_seq, SUM(cpu) AS cpu, SUM(CASE WHEN name IN ('read', 'pread64') THEN ret END) AS rb,
    SUM(CASE WHEN name IN ('write', 'pwrite64') THEN ret END) AS wb, SUM(CASE WHEN name IN ('recvfrom', 'recvmsg') THEN ret END) AS rx,
    SUM(CASE WHEN name IN ('sendto', 'sendmsg') THEN ret END) AS tx, SUM(rss) // COUNT(rss) AS rss
  FROM (
    SELECT x.*, CASE WHEN l.life_end IS NULL OR x.ts <= l.life_end THEN l.life_start END AS life_start,
      CASE WHEN l.life_end IS NULL OR x.ts <= l.life_end THEN l.life_seq END AS life_seq
    FROM (SELECT node_id, pid, make_timestamp(s) AS ts, (e - s) * 1000 AS cpu, NULL AS name, NULL AS ret, NULL AS rss FROM cpu_runs
          UNION ALL SELECT node_id, pid, ts, NULL, name, ret, NULL FROM syscalls WHERE ret > 0 AND pid <> 0
          UNION ALL SELECT node_id, pid, ts, NULL, NULL, NULL, CAST(floor(value) AS BIGINT) * 1024 FROM host_events WHERE pid <> 0) x
    ASOF LEFT JOIN lives l ON l.node_id = x.node_id AND l.pid = x.pid AND x.ts >= l.life_start) y
  GROUP BY ALL) u
FULL JOIN (SELECT * FROM lives WHERE pid <> 0) l ON u.node_id = l.node_id AND u.pid = l.pid AND u.life_start = l.life_start AND u.life_seq = l.life_seq""",
    "cpu_runs", "syscalls", "host_events", "lives"))
def q_usage_by_life(t: Telemetry) -> DataFrame:
    """HST-1..5 per life: CPU time, syscall bytes and RSS credited to the life they fall in."""
    return host_windows.usage_by_life(t.fx.switches, t.fx.syscalls, t.fx.rss_samples, t.fx.sched_events)


def window_samples(t: Telemetry) -> DataFrame:
    fx, w = t.fx, HOST_WINDOW
    gpu = host_windows.gpu_by_window(host.gpu_proc_csv_parse(fx.gpu_proc_lines))
    return host_windows.merge_window_samples(
        host_windows.oncpu_by_window(fx.switches, w), host_windows.io_by_window(fx.syscalls, w), host_windows.rss_by_window(fx.rss_samples, w),
        gpu, host_windows.process_lives(fx.sched_events), w)


@query("merge_window_samples", sql("SELECT * FROM window_merge", "window_merge"))
def q_merge_window_samples(t: Telemetry) -> DataFrame:
    """JON-9 / HST-8 per collection window: the processes of each node's report."""
    return window_samples(t)


@query("window_reports", sql(f"""
SELECT t.*, c.cpu_usage_percent, m.memory_used_bytes
FROM (SELECT node_id, window_start, COUNT(*) AS n_processes, CAST(SUM(cpu_ontime_ns) AS BIGINT) AS cpu_ontime_ns,
        CAST(SUM(read_bytes) AS BIGINT) AS read_bytes, CAST(SUM(write_bytes) AS BIGINT) AS write_bytes,
        CAST(SUM(net_rx_bytes) AS BIGINT) AS net_rx_bytes, CAST(SUM(net_tx_bytes) AS BIGINT) AS net_tx_bytes,
        COUNT(*) FILTER (exited) AS n_exited FROM window_merge GROUP BY ALL) t
LEFT JOIN (SELECT node_id, make_timestamp(epoch_us(ts) // {HOST_WINDOW_US} * {HOST_WINDOW_US}) AS window_start,
             CAST(SUM(CAST(pct AS DECIMAL(18,2))) AS DOUBLE) / COUNT(pct) AS cpu_usage_percent
           FROM (SELECT node_id, ts, CASE WHEN pt IS NULL THEN 0.0 WHEN total - pt = 0 THEN 0.0
                   ELSE CAST(ROUND(CAST(100.0 * (1.0 - (idle2 - pi) / (total - pt)) AS DECIMAL(38,12)), 2) AS DOUBLE) END AS pct
                 FROM (SELECT node_id, ts, idle2, total, LAG(idle2) OVER w AS pi, LAG(total) OVER w AS pt
                       FROM (SELECT *, event_id * 37 + CAST(floor(value) AS BIGINT) + event_id * 3 AS idle2, event_id * 100 + 1000 AS total FROM host_events) c
                       WINDOW w AS (PARTITION BY node_id ORDER BY ts, event_id)) x) y GROUP BY ALL) c
  ON c.node_id = t.node_id AND c.window_start = t.window_start
LEFT JOIN (SELECT node_id, make_timestamp(epoch_us(ts) // {HOST_WINDOW_US} * {HOST_WINDOW_US}) AS window_start,
             MAX((user_id % 7) * 1048576 - CAST(floor(value) AS BIGINT) * 4096) AS memory_used_bytes FROM host_events GROUP BY ALL) m
  ON m.node_id = t.node_id AND m.window_start = t.window_start""", "window_merge", "host_events"))
def q_window_reports(t: Telemetry) -> DataFrame:
    """HST-8: one report per node and collection window, made from traces."""
    fx = t.fx
    return host_windows.window_reports(window_samples(t), host.cpu_percent_from_counters(fx.cpu_counters), host.memory_usage(fx.mem_counters), HOST_WINDOW)


# ------------------------------------------------- stored states and stored rollups -----

@query("app_daily_from_states", sql("""
SELECT date_trunc('day', ts) AS bucket_time, node_id, uid, comm,
  CASE WHEN max(cpu_ontime_ns) > min(cpu_ontime_ns) THEN (max(cpu_ontime_ns) - min(cpu_ontime_ns)) / 1e9 ELSE 0.0 END AS total_cpu_time_seconds,
  CAST(max(avg_rss_bytes) AS BIGINT) AS avg_rss_memory_bytes, CAST(max(avg_rss_bytes) AS BIGINT) AS max_rss_memory_bytes,
  CAST(max(gpu_used_memory_mib) AS BIGINT) AS max_gpu_memory_mib,
  CAST(CASE WHEN max(cpu_ontime_ns) > min(cpu_ontime_ns) THEN max(read_bytes) - min(read_bytes) ELSE 0 END AS BIGINT) AS total_read_bytes,
  CAST(CASE WHEN max(cpu_ontime_ns) > min(cpu_ontime_ns) THEN max(write_bytes) - min(write_bytes) ELSE 0 END AS BIGINT) AS total_write_bytes,
  CAST(CASE WHEN max(cpu_ontime_ns) > min(cpu_ontime_ns) THEN max(net_rx_bytes) - min(net_rx_bytes) ELSE 0 END AS BIGINT) AS total_net_rx_bytes,
  CAST(CASE WHEN max(cpu_ontime_ns) > min(cpu_ontime_ns) THEN max(net_tx_bytes) - min(net_tx_bytes) ELSE 0 END AS BIGINT) AS total_net_tx_bytes,
  CAST(max(process_count) AS BIGINT) AS process_count
FROM proc_series GROUP BY ALL""", "proc_series"))
def q_app_daily_from_states(t: Telemetry) -> DataFrame:
    """AGG-9/10/11 by day, merged from hourly partial states."""
    return states.app_values(states.merge(states.states(t.process_series, "app"), "app", "day"))


@query("node_daily_from_states", sql("""
SELECT date_trunc('day', ts) AS bucket_time, node_id, CAST(CAST(AVG(cpu_usage_percent) AS DECIMAL(38,9)) AS DOUBLE) AS avg_cpu_usage_percent,
  MAX(cpu_usage_percent) AS max_cpu_usage_percent, CAST(CAST(AVG(memory_usage_percent) AS DECIMAL(38,9)) AS DOUBLE) AS avg_mem_usage_percent,
  MAX(memory_used_bytes) AS max_mem_used_bytes FROM node_series GROUP BY ALL""", "node_series"))
def q_node_daily_from_states(t: Telemetry) -> DataFrame:
    """AGG-4/5 by day, merged from hourly partial states."""
    return states.node_values(states.merge(states.states(t.without_processes.node_series, "node"), "node", "day"))


@query("active_users_by_range", sql(f"""
SELECT COUNT(DISTINCT uid) AS active_users FROM proc_series
WHERE uid >= 0 AND date_trunc('hour', ts) BETWEEN TIMESTAMP '{RANGE_START}' AND TIMESTAMP '{RANGE_END}'""", "proc_series"))
def q_active_users_by_range(t: Telemetry) -> DataFrame:
    """AGG-18 / AGG-29: exact distinct users of a range of hours, from hourly bitmaps."""
    bitmaps = states.user_bitmaps(t.process_series)
    return states.active_users(bitmaps, F.lit(RANGE_START).cast("timestamp"), F.lit(RANGE_END).cast("timestamp"))


@query("stored_cluster_stats", REGISTRY["cluster_stats"][1])
def q_stored_cluster_stats(t: Telemetry) -> DataFrame:
    """AGG-13 on the stored node rollup."""
    return usage.cluster_stats(t.stored("node_status_hourly"), "6h")


@query("stored_usage_summary", REGISTRY["usage_summary"][1])
def q_stored_usage_summary(t: Telemetry) -> DataFrame:
    """JON-1, AGG-14 on the stored app rollup."""
    return usage.usage_summary(t.fx.users, t.stored("user_app_hourly"), RANGE_START, RANGE_END)


@query("stored_latest_node_metrics", REGISTRY["latest_node_metrics"][1])
def q_stored_latest_node_metrics(t: Telemetry) -> DataFrame:
    """WIN-1 on the stored node rollup."""
    return fleet.latest_node_metrics(t.stored("node_status_hourly"))


# ------------------------------------------------------------------ pipeline rules -----

@query("rule_filter", sql("""
SELECT * FROM proc_points WHERE NOT (coalesce(cpu_ontime_ns = 0, FALSE) OR coalesce(avg_rss_bytes < 2000000 OR avg_rss_bytes > 400000000, FALSE))""",
    "proc_points"))
def q_rule_filter(t: Telemetry) -> DataFrame:
    """FLT-6: enabled filter rules drop matching process points."""
    return rules.rule_filter(t.process_points, PIPELINE_RULES)


@query("rule_derive", sql("""
SELECT *, cpu_ontime_ns / 1000000000 AS cpu_seconds, ((read_bytes + write_bytes) + net_rx_bytes) / 1048576 AS io_mb FROM proc_points""",
    "proc_points"))
def q_rule_derive(t: Telemetry) -> DataFrame:
    """FLT-7: enabled derive rules add computed columns."""
    return rules.rule_derive(t.process_points, PIPELINE_RULES)


@query("rule_aggregate", sql("""
SELECT 'p5' AS rule_id, node_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CAST(MAX(avg_rss_bytes) AS DOUBLE) AS value
FROM proc_points GROUP BY 2, 3
UNION ALL
SELECT 'p6', node_id, time_bucket(INTERVAL 1 HOUR, ts), CAST(SUM(cpu_ontime_ns) AS DOUBLE) / COUNT(cpu_ontime_ns) FROM proc_points GROUP BY 2, 3""", "proc_points"))
def q_rule_aggregate(t: Telemetry) -> DataFrame:
    """AGG-28: enabled aggregate rules per (node, hour)."""
    return rules.rule_aggregate(t.process_points, PIPELINE_RULES, "1 hour")


# ----------------------------------------------------------------- scalar helpers ------

@query("safe_casts", sql("""
SELECT report_id, kind, text,
  coalesce(CASE WHEN regexp_full_match(trim(text), '[+-]?[0-9]+') THEN TRY_CAST(trim(text) AS BIGINT) END,
           TRY_CAST(trunc(TRY_CAST(text AS DOUBLE)) AS BIGINT), 0) AS as_int,
  coalesce(TRY_CAST(text AS DOUBLE), 0.0) AS as_float
FROM (SELECT l_orderkey AS report_id, 'quantity' AS kind, CAST(l_quantity AS VARCHAR) AS text FROM lineitem
      UNION ALL SELECT l_orderkey, 'linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
      UNION ALL SELECT l_orderkey, 'flag', l_returnflag FROM lineitem
      UNION ALL SELECT l_orderkey, 'price', CAST(l_extendedprice AS VARCHAR) FROM lineitem) x"""))
def q_safe_casts(t: Telemetry) -> DataFrame:
    """SCL-1 / SCL-2: loose text -> int / float with defaults (D-19)."""
    li = t.fx.table("lineitem")
    k = F.col("l_orderkey").alias("report_id")
    kinds = {"quantity": "l_quantity", "linenumber": "l_linenumber", "flag": "l_returnflag", "price": "l_extendedprice"}
    texts = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).cast("string").alias("text")) for n, c in kinds.items()])
    x = li.select(k, F.inline(texts))
    return x.select("report_id", "kind", "text", scalars.safe_int("text", 0).alias("as_int"),
                    scalars.safe_float("text", 0.0).alias("as_float"))


@query("map_uid", sql("""
SELECT report_id, pos, uid, CAST(CASE WHEN uid = 0 THEN 0 WHEN uid > 0 AND uid < 1000 THEN 1 ELSE uid END AS BIGINT) AS mapped_uid
FROM fx_processes""", "fx_processes"))
def q_map_uid(t: Telemetry) -> DataFrame:
    """SCL-3: uid mapping (root 0, system users 1, others kept)."""
    p = t.fx.processes_flat
    return p.select("report_id", "pos", "uid", scalars.map_uid("uid").alias("mapped_uid"))


@query("normalize_comm", sql(f"SELECT report_id, pos, comm, {COMM_CASE} AS normalized_comm FROM fx_processes", "fx_processes"))
def q_normalize_comm(t: Telemetry) -> DataFrame:
    """SCL-4: empty -> 'unknown', first listed prefix wins, else unchanged."""
    p = t.fx.processes_flat
    return p.select("report_id", "pos", "comm", scalars.normalize_comm("comm").alias("normalized_comm"))


@query("longest_prefix", sql("""
SELECT report_id, pos, comm,
  CASE WHEN starts_with(comm, 'STANDARD') THEN 'STANDARD' WHEN starts_with(comm, 'SMALL-1') THEN 'SMALL-1'
       WHEN starts_with(comm, 'SMALL') THEN 'SMALL' END AS longest_prefix,
  CASE WHEN starts_with(comm, 'SMALL') THEN 'SMALL' WHEN starts_with(comm, 'SMALL-1') THEN 'SMALL-1'
       WHEN starts_with(comm, 'STANDARD') THEN 'STANDARD' END AS first_prefix
FROM fx_processes""", "fx_processes"))
def q_longest_prefix(t: Telemetry) -> DataFrame:
    """SCL-5: longest matching prefix (ties -> earlier) next to first-match."""
    p = t.fx.processes_flat
    pre = ["SMALL", "SMALL-1", "STANDARD"]
    return p.select("report_id", "pos", "comm", scalars.longest_prefix("comm", pre).alias("longest_prefix"),
                    scalars.first_prefix("comm", pre).alias("first_prefix"))


@query("local_bucket", sql("""
SELECT bucket_time, node_id, bucket_time + INTERVAL 7 HOUR AS local_bucket FROM node_status_hourly""", "node_status_hourly"))
def q_local_bucket(t: Telemetry) -> DataFrame:
    """SCL-9: bucket label in the site's zone (Asia/Ho_Chi_Minh)."""
    h = t.node_status_hourly()
    return h.select("bucket_time", "node_id", scalars.local_bucket("bucket_time").alias("local_bucket"))


@query("chart_labels", sql(f"""
SELECT t, strftime(t, '%H:%M') AS label, strftime(t, '%d/%m %H:00') AS label_week, strftime(t, '%d/%m') AS label_long,
  strftime(t, '%H:%M') AS node_label
FROM (SELECT date_trunc('hour', h.bucket_time) AS t FROM user_app_hourly h WHERE h.uid = {TS_UID}
        AND h.bucket_time >= TIMESTAMP '{RANGE_START}' AND h.bucket_time <= TIMESTAMP '{RANGE_END}' GROUP BY 1) x""",
    "user_app_hourly"))
def q_chart_labels(t: Telemetry) -> DataFrame:
    """SCL-10: axis labels chosen by the span (18 h here: HH:MM), with the other forms."""
    ts = usage.usage_timeseries(t.user_app_hourly(), TS_UID, "cpu", RANGE_START, RANGE_END)
    return charts.chart_labels(ts, RANGE_START, RANGE_END)


@query("node_chart_fields", sql("""
SELECT bucket_time, node_id, """ + ", ".join(
    f"CAST(ROUND(CAST({n} / {float(d)} AS DECIMAL(38,12)), {k}) AS DOUBLE) AS {n}" for n, d, k in points.CHART_FIELDS)
    + " FROM node_status_hourly", "node_status_hourly"))
def q_node_chart_fields(t: Telemetry) -> DataFrame:
    """PRJ-6 / SHP-3: node chart values (bytes -> MB, 2 decimals; others 1 decimal)."""
    return points.chart_fields(t.node_status_hourly())


@query("cluster_health", sql("""
SELECT COUNT(*) AS total, CAST(count_if(status = 'active') AS BIGINT) AS active,
  CASE WHEN COUNT(*) = 0 THEN 'Critical' WHEN count_if(status = 'active') / COUNT(*) >= 0.9 THEN 'Healthy'
       WHEN count_if(status = 'active') / COUNT(*) >= 0.6 THEN 'Degraded' ELSE 'Critical' END AS health
FROM node_overview""", "node_overview"))
def q_cluster_health(t: Telemetry) -> DataFrame:
    """SCL-12: health label from the share of active nodes."""
    return fleet.status_counts(q_node_overview(t)).select("total", "active", "health")


@query("field_pivot", sql("SELECT report_id, ts, node_id, cpu_usage_percent, memory_usage_percent FROM node_points", "node_points"))
def q_field_pivot(t: Telemetry) -> DataFrame:
    """AGG-12: long (row key, field, value) points pivoted back to one column per field."""
    n = t.node_points
    long = n.select("report_id", "ts", "node_id", "cpu_usage_percent", "memory_usage_percent").unpivot(
        ["report_id", "ts", "node_id"], ["cpu_usage_percent", "memory_usage_percent"], "_field", "_value")
    return rollup.field_pivot(long, ["report_id", "ts", "node_id"], ["cpu_usage_percent", "memory_usage_percent"])


@query("series_dedup", sql("""
SELECT ts, node_id, collect_agent_id, collect_agent_version, collection_window_seconds, received_timestamp, cpu_usage_percent,
  memory_usage_percent, memory_used_bytes, memory_total_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY node_id, collect_agent_id, collect_agent_version, ts ORDER BY report_id DESC) AS rn
      FROM node_points) x WHERE rn = 1""", "node_points"))
def q_series_dedup(t: Telemetry) -> DataFrame:
    """SNK-3: same series and second -> the later write (higher ingest order) wins."""
    return t.node_series.drop("report_id")


@query("insert_if_absent", sql("""
SELECT * FROM user_app_hourly_sum WHERE bucket_time < TIMESTAMP '2024-01-01 12:00:00'
UNION ALL
SELECT n.* FROM user_app_hourly n WHERE NOT EXISTS (
  SELECT 1 FROM user_app_hourly_sum e WHERE e.bucket_time < TIMESTAMP '2024-01-01 12:00:00' AND e.bucket_time = n.bucket_time
    AND e.node_id = n.node_id AND e.uid = n.uid AND e.comm = n.comm)""", "user_app_hourly_sum", "user_app_hourly"))
def q_insert_if_absent(t: Telemetry) -> DataFrame:
    """SNK-4: a rerun over a table that already holds the morning (written earlier in sum
    mode) only adds the missing keys: first write wins."""
    existing = t.user_app_hourly("sum").filter(F.col("bucket_time") < F.lit("2024-01-01 12:00:00").cast("timestamp"))
    keys = ["bucket_time", "node_id", "uid", "comm"]
    return existing.unionByName(rollup.insert_if_absent(t.user_app_hourly("spread"), existing, keys))


@query("upsert_settings", sql(f"""
SELECT node_id, CAST({parse_float_sql('heartbeat_interval')} AS INTEGER) AS interval_seconds,
  CAST({parse_float_sql('"window"')} AS INTEGER) AS window_seconds, target_collect_agent AS collect_agent
FROM live_config WHERE {parse_float_sql('"window"')} IS NOT NULL
UNION ALL
SELECT s.node_id, CAST(s.interval_seconds AS INTEGER), CAST(s.window_seconds AS INTEGER), s.collect_agent FROM fx_collection_settings s
WHERE s.node_id NOT IN (SELECT node_id FROM live_config WHERE {parse_float_sql('"window"')} IS NOT NULL)""",
    "live_config", "fx_collection_settings"))
def q_upsert_settings(t: Telemetry) -> DataFrame:
    """SNK-5: settings synced from the live config (key match -> all columns replaced)."""
    live = _live_config(t)
    upd = live.filter(fleet.parse_float(F.col("window")).isNotNull()).select(
        "node_id", fleet.parse_float(F.col("heartbeat_interval")).cast("int").alias("interval_seconds"),
        fleet.parse_float(F.col("window")).cast("int").alias("window_seconds"),
        F.col("target_collect_agent").alias("collect_agent"))
    cur = t.fx.collection_settings.select("node_id", F.col("interval_seconds").cast("int"),
                                          F.col("window_seconds").cast("int"), "collect_agent")
    return rollup.upsert(upd, cur, ["node_id"])


# ------------------------------------------------------------ admin rules and agents ---

_METRICS = ", ".join(f"('{r}', '{m}')" for r, m in alerts.RESOURCE_TO_METRIC.items())
_PUSHABLE = "enabled AND operator IN ('>', '>=')"


@query("compile_thresholds", sql(f"""
SELECT metric_name, min(threshold) AS max_value, CAST(NULL AS DOUBLE) AS min_value
FROM fx_alert_rules JOIN (VALUES {_METRICS}) m(resource, metric_name) USING (resource) WHERE {_PUSHABLE} GROUP BY metric_name""",
    "fx_alert_rules"))
def q_compile_thresholds(t: Telemetry) -> DataFrame:
    """AGG-25: the most restrictive threshold per agent metric."""
    return alerts.compile_thresholds(t.fx.alert_rules)


@query("skipped_rules", sql(f"""
SELECT name FROM fx_alert_rules WHERE {_PUSHABLE} AND resource NOT IN (SELECT resource FROM (VALUES {_METRICS}) m(resource, metric_name))""",
    "fx_alert_rules"))
def q_skipped_rules(t: Telemetry) -> DataFrame:
    """AGG-25: enabled upper-bound rules that no agent metric can carry."""
    return alerts.skipped_rules(t.fx.alert_rules)


@query("rule_counters", sql(f"""
SELECT count(*) AS total, CAST(count_if(enabled) AS BIGINT) AS enabled, CAST(count_if({_PUSHABLE}) AS BIGINT) AS syncable FROM fx_alert_rules""",
    "fx_alert_rules"))
def q_rule_counters(t: Telemetry) -> DataFrame:
    """AGG-24: total, enabled and pushable alert rules."""
    return fleet.rule_counters(t.fx.alert_rules, F.col("operator").isin(">", ">="))


@query("agent_list", sql("""
SELECT split_part(key, '/', 4) AS agent_id, max(value) FILTER (split_part(key, '/', 5) = 'kafka_topic') AS kafka_topic,
  max(value) FILTER (split_part(key, '/', 5) = 'window') AS "window"
FROM fx_config_kv WHERE key LIKE '/config/collect_agent/%' GROUP BY 1""", "fx_config_kv"))
def q_agent_list(t: Telemetry) -> DataFrame:
    """SRC-5: collect agents with their configuration."""
    return fleet.agent_list(t.fx.config_kv)
