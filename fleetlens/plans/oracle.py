"""DuckDB oracle texts: each registered query restated in plain SQL over the driver tables.

The fixture views and the derived telemetry tables are named CTEs; ``sql(body, *needs)``
prepends the ones a query uses (with their dependencies, in order).
"""

from __future__ import annotations

# The fixture mapping (FIXTURES.md section 3), restated as CTE bodies.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body.strip(), deps)


COMM_CASE = """CASE WHEN comm IS NULL OR comm = '' THEN 'unknown'
  WHEN starts_with(comm, 'StreamT') THEN 'StreamT' WHEN starts_with(comm, 'IPC') THEN 'IPC'
  WHEN starts_with(comm, 'FSBroker') THEN 'FSBroker' WHEN starts_with(comm, 'gvfsd') THEN 'gvfsd'
  WHEN starts_with(comm, 'gsd') THEN 'gsd' WHEN starts_with(comm, 'kworker') THEN 'kworker'
  WHEN starts_with(comm, 'glfs') THEN 'glfs' WHEN starts_with(comm, 'gnome') THEN 'gnome'
  WHEN starts_with(comm, 'ibus') THEN 'ibus' WHEN starts_with(comm, 'ksoftirqd') THEN 'ksoftirqd'
  WHEN starts_with(comm, 'swapper') THEN 'swapper' ELSE comm END"""

cte("fx_reports", """
SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE 'node_' || CAST(o_orderkey % 6 AS VARCHAR) END AS node_id,
  TIMESTAMP '2024-01-01 00:00:00' + (o_custkey % 24) * INTERVAL '1' HOUR + (o_orderkey % 60) * INTERVAL '1' MINUTE AS event_time,
  CAST(1704067200 + (o_custkey % 24) * 3600 + (o_orderkey % 60) * 60 AS BIGINT) AS "timestamp",
  CAST(5 AS DOUBLE) AS collection_window_seconds,
  o_orderstatus <> 'P' AS has_system_metrics,
  CAST(o_orderkey % 1010 AS DOUBLE) / 10 AS cpu_usage_percent,
  CAST((o_orderkey * 3) % 1005 AS DOUBLE) / 10 AS memory_usage_percent,
  (o_orderkey % 64) * 1073741824 AS memory_used_bytes, 64 * CAST(1073741824 AS BIGINT) AS memory_total_bytes,
  o_custkey % 3 AS gpu_count
FROM orders""")

cte("fx_processes", """
SELECT l.l_orderkey AS report_id, CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity) AS BIGINT) AS pos,
  CASE WHEN l.l_quantity <= 1 THEN 0 ELSE (l.l_orderkey % 10000) * 100 + row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity) END AS pid,
  CAST(l.l_quantity AS BIGINT) * 1000000000 AS cpu_ontime_ns,
  CASE WHEN l.l_suppkey % 10 = 0 THEN 0 WHEN l.l_suppkey % 10 = 1 THEN 100 + l.l_suppkey % 50 ELSE 1000 + l.l_partkey % 20 END AS uid,
  CASE WHEN l.l_discount = 0 THEN '' WHEN l.l_partkey % 11 = 0 THEN 'kworker/' || CAST(p.p_size % 4 AS VARCHAR) ELSE p.p_type || '-' || CAST(p.p_size % 4 AS VARCHAR) END AS comm,
  CAST(floor(l.l_extendedprice) AS BIGINT) * 4096 AS read_bytes, l.l_partkey * 1024 AS write_bytes,
  l.l_suppkey * 2048 AS net_rx_bytes, CAST(l.l_linenumber AS BIGINT) * 512 AS net_tx_bytes,
  CAST(floor(l.l_extendedprice) AS BIGINT) * 1024 AS avg_rss_bytes, (l.l_partkey % 8) * 256 AS gpu_used_memory_mib
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""")

cte("fx_gpus", """
SELECT r.report_id, r.node_id, r.event_time, g.gpu_index, CAST((r.report_id * 7 + g.gpu_index * 31) % 103 AS DOUBLE) AS utilization_percent,
  CAST(30 + (r.report_id + g.gpu_index * 13) % 60 AS DOUBLE) AS temperature_celsius, CAST(50 + (r.report_id * 3 + g.gpu_index) % 300 AS DOUBLE) AS power_watts,
  (r.report_id + g.gpu_index) % 24576 AS memory_used_mib
FROM fx_reports r JOIN (SELECT 0 AS gpu_index UNION ALL SELECT 1 AS gpu_index) g ON g.gpu_index < r.gpu_count WHERE r.has_system_metrics""",
    "fx_reports")

cte("fx_nodes", """
SELECT 'node_' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, '10.0.' || CAST(s_nationkey AS VARCHAR) || '.' || CAST(s_suppkey % 256 AS VARCHAR) AS ip,
  n_name AS group_name, 'agent_' || CAST(n_regionkey AS VARCHAR) AS collect_agent FROM supplier JOIN nation ON n_nationkey = s_nationkey""")

cte("fx_users", "SELECT 1000 + c_custkey AS uid, c_name AS username, c_mktsegment AS group_name FROM customer")

cte("fx_heartbeats", """
SELECT event_id, 'node_' || CAST(user_id % 12 AS VARCHAR) AS node_id, ts AS event_time,
  CASE WHEN event_type = 'click' THEN 'stopping' ELSE 'alive' END AS status FROM events WHERE event_type IN ('view','click')""")

cte("fx_notifications", """
SELECT event_id AS id, CASE WHEN value >= 100 THEN 'critical' WHEN value >= 40 THEN 'warning' ELSE 'info' END AS severity,
  'node_' || CAST(user_id % 12 AS VARCHAR) AS node_id, event_id % 3 = 0 AS acknowledged, ts AS created_at FROM events WHERE event_type = 'error'""")

cte("fx_audit_logs", """
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'UPDATE' WHEN event_id % 3 = 1 THEN 'CREATE' ELSE 'ROLLOUT' END AS action,
  'user_' || CAST(user_id AS VARCHAR) AS actor, ts AS created_at FROM events WHERE event_type = 'signup'""")

cte("fx_collection_settings", """
SELECT 'node_' || CAST(s_suppkey AS VARCHAR) AS node_id, CAST(5 + (s_suppkey % 3) * 5 AS INTEGER) AS interval_seconds,
  CAST(30 + (s_suppkey % 4) * 30 AS INTEGER) AS window_seconds,
  'agent_' || CAST(s_suppkey % 5 AS VARCHAR) AS collect_agent FROM supplier WHERE s_suppkey % 2 = 0""")

cte("fx_config_kv", """
SELECT '/config/compute_node/node_' || CAST(s_suppkey AS VARCHAR) || '/window' AS key, CAST(30 + (s_suppkey % 5) * 30 AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT '/config/compute_node/node_' || CAST(s_suppkey AS VARCHAR) || '/heartbeat_interval' AS key, CASE WHEN s_suppkey % 7 = 0 THEN 'bad' ELSE CAST(5 + (s_suppkey % 3) * 5 AS VARCHAR) END AS value FROM supplier WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT '/config/compute_node/node_' || CAST(s_suppkey AS VARCHAR) || '/status' AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'running' ELSE 'stopped' END AS value FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT '/config/compute_node/node_' || CAST(s_suppkey AS VARCHAR) || '/target_collect_agent' AS key,
    'agent_' || CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 ELSE (s_suppkey + 1) % 5 END AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 5 <> 1
  UNION ALL SELECT '/config/collect_agent/agent_' || CAST(r_regionkey AS VARCHAR) || '/kafka_topic', 'topic_' || CAST(r_regionkey AS VARCHAR) FROM region
  UNION ALL SELECT '/config/collect_agent/agent_' || CAST(r_regionkey AS VARCHAR) || '/window', CAST(r_regionkey * 30 AS VARCHAR) FROM region""")

cte("fx_alert_rules", """
SELECT 'rule_' || CAST(p_partkey AS VARCHAR) AS id, p_type AS name, (['cpu', 'mem', 'gpu', 'disk', 'net', 'fan'])[p_partkey % 6 + 1] AS resource,
  (['>', '>=', '<', '<='])[p_size % 4 + 1] AS operator, CAST(p_size + p_partkey % 7 AS DOUBLE) AS threshold, p_partkey % 3 <> 0 AS enabled
FROM part""")

cte("host_events", """
SELECT event_id, 'node_' || CAST(user_id % 6 AS VARCHAR) AS node_id, CAST(user_id % 4 AS INTEGER) AS cpu,
  event_id % 50 AS pid, ts, event_type, value, user_id, CAST(floor(value) AS BIGINT) - 5 AS ret FROM events""")

# ---- derived telemetry -------------------------------------------------------------
cte("v_headers", "SELECT * FROM fx_reports WHERE node_id <> '' AND \"timestamp\" IS NOT NULL", "fx_reports")

cte("v_procs", """
SELECT p.*, h.node_id, date_trunc('second', h.event_time) AS ts FROM fx_processes p JOIN v_headers h ON h.report_id = p.report_id
WHERE p.pid > 0 AND p.cpu_ontime_ns >= 0 AND length(p.comm) > 0""", "fx_processes", "v_headers")

cte("proc_points", f"""
SELECT ts, node_id, report_id, uid, comm, CAST(SUM(cpu_ontime_ns) AS BIGINT) AS cpu_ontime_ns, CAST(SUM(read_bytes) AS BIGINT) AS read_bytes,
  CAST(SUM(write_bytes) AS BIGINT) AS write_bytes, CAST(SUM(net_rx_bytes) AS BIGINT) AS net_rx_bytes,
  CAST(SUM(net_tx_bytes) AS BIGINT) AS net_tx_bytes, CAST(SUM(gpu_used_memory_mib) AS BIGINT) AS gpu_used_memory_mib,
  CAST(SUM(avg_rss_bytes) AS BIGINT) AS avg_rss_bytes, COUNT(*) AS process_count
FROM (SELECT report_id, node_id, ts, CAST(CASE WHEN uid = 0 THEN 0 WHEN uid > 0 AND uid < 1000 THEN 1 ELSE uid END AS BIGINT) AS uid,
        {COMM_CASE} AS comm, cpu_ontime_ns, read_bytes, write_bytes, net_rx_bytes, net_tx_bytes, gpu_used_memory_mib, avg_rss_bytes
      FROM v_procs) x
GROUP BY report_id, node_id, ts, uid, comm""", "v_procs")

cte("v_reports", """
SELECT r.*, coalesce(r.has_system_metrics AND r.cpu_usage_percent BETWEEN 0 AND 100 AND r.memory_usage_percent BETWEEN 0 AND 100
    AND r.memory_used_bytes >= 0 AND r.memory_total_bytes >= 0 AND coalesce(g.gpus_ok, TRUE), FALSE) AS sm_ok
FROM v_headers r
LEFT JOIN (SELECT report_id, bool_and(coalesce(utilization_percent BETWEEN 0 AND 100 AND temperature_celsius BETWEEN -50 AND 200 AND power_watts >= 0, FALSE)) AS gpus_ok
           FROM fx_gpus GROUP BY report_id) g ON g.report_id = r.report_id
WHERE r.report_id IN (SELECT report_id FROM v_procs)""", "v_headers", "fx_gpus", "v_procs")

cte("node_points", """
SELECT date_trunc('second', event_time) AS ts, node_id, report_id, 'collect_agent_1' AS collect_agent_id, '1.0.0' AS collect_agent_version,
  collection_window_seconds, "timestamp" AS received_timestamp,
  CASE WHEN sm_ok THEN cpu_usage_percent ELSE 0.0 END AS cpu_usage_percent,
  CASE WHEN sm_ok THEN memory_usage_percent ELSE 0.0 END AS memory_usage_percent,
  CAST(CASE WHEN sm_ok THEN memory_used_bytes ELSE 0 END AS BIGINT) AS memory_used_bytes,
  CAST(CASE WHEN sm_ok THEN memory_total_bytes ELSE 0 END AS BIGINT) AS memory_total_bytes
FROM v_reports""", "v_reports")

cte("gpu_points", """
SELECT date_trunc('second', event_time) AS ts, node_id, report_id, CAST(gpu_index AS VARCHAR) AS gpu_index, 'unknown' AS gpu_name,
  utilization_percent, temperature_celsius, power_watts, CAST(0.0 AS DOUBLE) AS power_limit_watts, CAST(memory_used_mib AS BIGINT) AS memory_used_mib,
  CAST(0 AS BIGINT) AS memory_total_mib
FROM fx_gpus WHERE report_id IN (SELECT report_id FROM v_reports WHERE sm_ok)""", "fx_gpus", "v_reports")

def _series(name: str, points: str, tags: str) -> None:
    """SNK-3: per series and second, the point of the latest report."""
    cte(name, f"SELECT * FROM {points} QUALIFY row_number() OVER (PARTITION BY {tags}, ts ORDER BY report_id DESC) = 1", points)


_series("node_series", "node_points", "node_id, collect_agent_id, collect_agent_version")
_series("gpu_series", "gpu_points", "node_id, gpu_index, gpu_name")
_series("proc_series", "proc_points", "node_id, uid, comm")

cte("app_agg", """
SELECT date_trunc('hour', ts) AS bucket_time, node_id, uid, comm,
  MAX(cpu_ontime_ns) - MIN(cpu_ontime_ns) AS cpu_spread, SUM(cpu_ontime_ns) AS cpu_sum,
  MAX(read_bytes) - MIN(read_bytes) AS read_bytes_spread, SUM(read_bytes) AS read_bytes_sum,
  MAX(write_bytes) - MIN(write_bytes) AS write_bytes_spread, SUM(write_bytes) AS write_bytes_sum,
  MAX(net_rx_bytes) - MIN(net_rx_bytes) AS net_rx_bytes_spread, SUM(net_rx_bytes) AS net_rx_bytes_sum,
  MAX(net_tx_bytes) - MIN(net_tx_bytes) AS net_tx_bytes_spread, SUM(net_tx_bytes) AS net_tx_bytes_sum,
  MAX(avg_rss_bytes) AS max_rss, SUM(avg_rss_bytes) AS rss_sum, COUNT(avg_rss_bytes) AS rss_n,
  MAX(process_count) AS max_procs, MAX(gpu_used_memory_mib) AS max_gpu_mib
FROM proc_series GROUP BY 1, 2, 3, 4""", "proc_series")

cte("user_app_hourly", """
SELECT bucket_time, node_id, uid, comm,
  CASE WHEN cpu_spread > 0 THEN cpu_spread / 1e9 ELSE 0.0 END AS total_cpu_time_seconds,
  CAST(max_rss AS BIGINT) AS avg_rss_memory_bytes, CAST(max_rss AS BIGINT) AS max_rss_memory_bytes,
  CAST(max_gpu_mib AS BIGINT) AS max_gpu_memory_mib,
  CAST(CASE WHEN cpu_spread > 0 THEN read_bytes_spread ELSE 0 END AS BIGINT) AS total_read_bytes,
  CAST(CASE WHEN cpu_spread > 0 THEN write_bytes_spread ELSE 0 END AS BIGINT) AS total_write_bytes,
  CAST(CASE WHEN cpu_spread > 0 THEN net_rx_bytes_spread ELSE 0 END AS BIGINT) AS total_net_rx_bytes,
  CAST(CASE WHEN cpu_spread > 0 THEN net_tx_bytes_spread ELSE 0 END AS BIGINT) AS total_net_tx_bytes,
  CAST(max_procs AS BIGINT) AS process_count
FROM app_agg""", "app_agg")

cte("user_app_hourly_sum", """
SELECT bucket_time, node_id, uid, comm, cpu_sum / 1e9 AS total_cpu_time_seconds,
  CAST(rss_sum // rss_n AS BIGINT) AS avg_rss_memory_bytes, CAST(max_rss AS BIGINT) AS max_rss_memory_bytes,
  CAST(max_gpu_mib AS BIGINT) AS max_gpu_memory_mib,
  CAST(read_bytes_sum AS BIGINT) AS total_read_bytes, CAST(write_bytes_sum AS BIGINT) AS total_write_bytes,
  CAST(net_rx_bytes_sum AS BIGINT) AS total_net_rx_bytes, CAST(net_tx_bytes_sum AS BIGINT) AS total_net_tx_bytes,
  CAST(max_procs AS BIGINT) AS process_count
FROM app_agg""", "app_agg")

cte("node_core", """
SELECT date_trunc('hour', ts) AS bucket_time, node_id, CAST(CAST(AVG(cpu_usage_percent) AS DECIMAL(38,9)) AS DOUBLE) AS avg_cpu_usage_percent,
  MAX(cpu_usage_percent) AS max_cpu_usage_percent, CAST(CAST(AVG(memory_usage_percent) AS DECIMAL(38,9)) AS DOUBLE) AS avg_mem_usage_percent,
  MAX(memory_used_bytes) AS max_mem_used_bytes
FROM node_series GROUP BY 1, 2""", "node_series")

cte("gpu_hourly", """
SELECT bucket_time, node_id, CAST(CAST(AVG(coalesce(u, 0.0)) AS DECIMAL(38,9)) AS DOUBLE) AS avg_gpu_utilization,
  CAST(CAST(greatest(MAX(coalesce(t, 0.0)), 0.0) AS DECIMAL(38,9)) AS DOUBLE) AS max_gpu_temperature,
  CAST(CAST(AVG(coalesce(p, 0.0)) AS DECIMAL(38,9)) AS DOUBLE) AS total_gpu_power_watts, COUNT(*) AS gpu_count
FROM (SELECT date_trunc('hour', ts) AS bucket_time, node_id, gpu_index, AVG(utilization_percent) AS u, AVG(power_watts) AS p,
        AVG(temperature_celsius) AS t FROM gpu_series GROUP BY 1, 2, 3) x
GROUP BY 1, 2""", "gpu_series")

cte("node_io_hourly", """
SELECT bucket_time, node_id, CAST(SUM(read_bytes_spread) AS BIGINT) AS read_bytes, CAST(SUM(write_bytes_spread) AS BIGINT) AS write_bytes,
  CAST(SUM(net_rx_bytes_spread) AS BIGINT) AS net_rx_bytes, CAST(SUM(net_tx_bytes_spread) AS BIGINT) AS net_tx_bytes
FROM app_agg GROUP BY 1, 2""", "app_agg")

cte("node_status_hourly", """
SELECT coalesce(c.bucket_time, g.bucket_time) AS bucket_time, coalesce(c.node_id, g.node_id) AS node_id,
  coalesce(c.avg_cpu_usage_percent, 0.0) AS avg_cpu_usage_percent, coalesce(c.max_cpu_usage_percent, 0.0) AS max_cpu_usage_percent,
  coalesce(c.avg_mem_usage_percent, 0.0) AS avg_mem_usage_percent, CAST(coalesce(c.max_mem_used_bytes, 0) AS BIGINT) AS max_mem_used_bytes,
  coalesce(g.avg_gpu_utilization, 0.0) AS avg_gpu_utilization, coalesce(g.max_gpu_temperature, 0.0) AS max_gpu_temperature,
  coalesce(g.total_gpu_power_watts, 0.0) AS total_gpu_power_watts,
  CAST(coalesce(io.read_bytes, 0) AS BIGINT) AS total_disk_read_bytes, CAST(coalesce(io.write_bytes, 0) AS BIGINT) AS total_disk_write_bytes,
  CAST(coalesce(io.net_rx_bytes, 0) AS BIGINT) AS total_net_rx_bytes, CAST(coalesce(io.net_tx_bytes, 0) AS BIGINT) AS total_net_tx_bytes,
  TRUE AS is_active
FROM node_core c FULL OUTER JOIN gpu_hourly g ON g.bucket_time = c.bucket_time AND g.node_id = c.node_id
LEFT JOIN node_io_hourly io ON io.bucket_time = coalesce(c.bucket_time, g.bucket_time) AND io.node_id = coalesce(c.node_id, g.node_id)""",
    "node_core", "gpu_hourly", "node_io_hourly")


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in CTES[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *needs: str) -> str:
    """``WITH <needed CTEs in dependency order> <body>``."""
    if not needs:
        return body.strip()
    parts = [f"{n} AS (\n{CTES[n][0]}\n)" for n in _order(needs)]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


# ---- query parameters shared by the Spark builders and the oracle texts -------------
# Feature parameters of the API routes (a closed usage range, the uids the
# analytics page selects); they select what the feature selects, not a sample.
RANGE_START, RANGE_END = "2024-01-01 02:00:00", "2024-01-01 20:00:00"
TS_UID = 1001
APP_UIDS = (1001, 1002, 1003, 1005, 1008)
_UIDS_SQL = ", ".join(str(u) for u in APP_UIDS)
_RANGE_SQL = f"h.bucket_time >= TIMESTAMP '{RANGE_START}' AND h.bucket_time <= TIMESTAMP '{RANGE_END}'"

# One row per usage bucket inside the range, with the five resources as plain numbers.
cte("usage_rows", f"""
SELECT bucket_time AS t, uid, comm, process_count AS procs, total_cpu_time_seconds AS cpu, max_rss_memory_bytes AS mem,
  max_gpu_memory_mib AS gpu, total_read_bytes + total_write_bytes AS disk, total_net_rx_bytes + total_net_tx_bytes AS net
FROM user_app_hourly h WHERE {_RANGE_SQL}""", "user_app_hourly")

RESOURCE_SQL = {
    "cpu": "sum(cpu)",
    "mem": "CAST(max(mem) AS DOUBLE) / 1048576.0",
    "gpu": "CAST(max(gpu) AS DOUBLE)",
    "disk": "CAST(sum(disk) AS DOUBLE) / 1048576.0",
    "net": "CAST(sum(net) AS DOUBLE) / 1048576.0",
}

cte("uid_totals", """
SELECT uid, sum(cpu) AS total_cpu_seconds, max(mem) AS peak_mem_bytes, max(gpu) AS peak_gpu_mib,
  CAST(sum(disk) AS BIGINT) AS total_disk_bytes, CAST(sum(net) AS BIGINT) AS total_net_bytes
FROM usage_rows GROUP BY uid""", "usage_rows")

cte("picked_rows", f"""
SELECT usage_rows.*, username FROM fx_users JOIN usage_rows USING (uid) WHERE uid IN ({_UIDS_SQL})""", "usage_rows", "fx_users")

cte("usage_apps", f"""
SELECT username, comm, {RESOURCE_SQL['cpu']} AS cpu_seconds, {RESOURCE_SQL['mem']} AS peak_mem_mb, max(gpu) AS peak_gpu_mib,
  {RESOURCE_SQL['disk']} AS disk_io_mb, {RESOURCE_SQL['net']} AS net_io_mb, CAST(sum(procs) AS BIGINT) AS total_processes
FROM picked_rows GROUP BY username, comm""", "picked_rows")

cte("usage_app_ts", f"""
SELECT t, username, comm, {RESOURCE_SQL['cpu']} AS value FROM picked_rows GROUP BY t, uid, username, comm""", "picked_rows")

cte("app_totals", """
SELECT comm, COUNT(DISTINCT username) AS n_users, SUM(cpu_seconds) AS cpu_seconds
FROM usage_apps WHERE comm IS NOT NULL AND comm <> '' GROUP BY comm""", "usage_apps")

cte("common_apps", """
SELECT comm, n_users, cpu_seconds FROM app_totals
WHERE (SELECT COUNT(DISTINCT username) FROM usage_apps) <= 1 OR n_users = (SELECT COUNT(DISTINCT username) FROM usage_apps)""",
    "app_totals", "usage_apps")


def usage_timeseries_sql(resource: str) -> str:
    return sql(f"SELECT t, {RESOURCE_SQL[resource]} AS value FROM usage_rows WHERE uid = {TS_UID} GROUP BY t", "usage_rows")

# ---- fleet state --------------------------------------------------------------------
LEADING_NUMBER = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'"


def parse_float_sql(x: str) -> str:
    return f"TRY_CAST(regexp_extract(trim({x}), {LEADING_NUMBER}, 0) AS DOUBLE)"


cte("kv_split", """
SELECT substr(rel, 1, s - 1) AS node_id, substr(rel, s + 1) AS field, value
FROM (SELECT substr(key, 22) AS rel, instr(substr(key, 22), '/') AS s, value FROM fx_config_kv
      WHERE starts_with(key, '/config/compute_node/')) x
WHERE s > 0""", "fx_config_kv")

cte("live_config", """
SELECT node_id, MAX(CASE WHEN field = 'heartbeat_interval' THEN value END) AS heartbeat_interval,
  MAX(CASE WHEN field = 'status' THEN value END) AS status,
  MAX(CASE WHEN field = 'target_collect_agent' THEN value END) AS target_collect_agent,
  MAX(CASE WHEN field = 'window' THEN value END) AS "window"
FROM kv_split GROUP BY node_id""", "kv_split")

cte("hb_latest", """
SELECT node_id, epoch_us(MAX(event_time)) / 1e6 AS "timestamp", arg_max(status, event_time) AS status,
  arg_max(status, event_time) = 'alive' AS collection_active
FROM fx_heartbeats GROUP BY node_id""", "fx_heartbeats")

cte("live_nodes", f"""
SELECT c.node_id, c.heartbeat_interval, c.target_collect_agent, c."window",
  CASE WHEN coalesce(h.status = 'alive' AND (floor((SELECT epoch_us(MAX(event_time)) FROM fx_heartbeats) / 1e6) - h."timestamp")
       <= coalesce({parse_float_sql("coalesce(c.heartbeat_interval, '20')")} * 3, 60.0), FALSE) THEN 'running' ELSE 'stopped' END AS status
FROM live_config c LEFT JOIN hb_latest h ON h.node_id = c.node_id""", "live_config", "hb_latest", "fx_heartbeats")

cte("settings_list", """
SELECT n.id, n.name, n.ip, n.group_name, n.collect_agent, COALESCE(cs.interval_seconds, 10) AS interval_seconds,
  COALESCE(cs.window_seconds, 60) AS window_seconds
FROM fx_nodes n LEFT JOIN fx_collection_settings cs ON n.id = cs.node_id""", "fx_nodes", "fx_collection_settings")

cte("latest_node_metrics", """
SELECT node_id, MAX(bucket_time) AS bucket_time, arg_max(avg_cpu_usage_percent, bucket_time) AS cpu,
  arg_max(avg_gpu_utilization, bucket_time) AS gpu, arg_max(avg_mem_usage_percent, bucket_time) AS mem
FROM node_status_hourly GROUP BY node_id""", "node_status_hourly")

cte("config_drift", f"""
SELECT d.id AS node_id, d.name AS node_name, d.group_name AS "group", d.interval_seconds, d.window_seconds, d.collect_agent,
  coalesce(l.status, 'unknown') AS etcd_status, l.node_id IS NOT NULL AS etcd_loaded,
  CASE WHEN l.node_id IS NULL THEN FALSE ELSE
    (CASE WHEN l."window" IS NULL THEN TRUE ELSE coalesce({parse_float_sql('l."window"')} = d.window_seconds, FALSE) END)
    AND (CASE WHEN l.heartbeat_interval IS NULL THEN TRUE ELSE coalesce({parse_float_sql('l.heartbeat_interval')} = d.interval_seconds, FALSE) END)
    AND (CASE WHEN l.target_collect_agent IS NULL THEN TRUE ELSE coalesce(l.target_collect_agent = d.collect_agent, FALSE) END) END AS etcd_synced
FROM settings_list d LEFT JOIN live_nodes l ON l.node_id = d.id""", "settings_list", "live_nodes")

cte("node_overview", """
SELECT n.id, n.name, n.ip, n.group_name AS "group",
  CASE coalesce(l.status, 'unknown') WHEN 'running' THEN 'active' WHEN 'stopped' THEN 'down' ELSE 'idle' END AS status,
  coalesce(l.status, 'unknown') AS etcd_status, l.node_id IS NOT NULL AS etcd_loaded,
  coalesce(l.target_collect_agent, 'UNKNOWN') AS collect_agent, l."window" AS "window", l.heartbeat_interval AS heartbeat,
  m.cpu, m.gpu, m.mem
FROM fx_nodes n LEFT JOIN live_nodes l ON l.node_id = n.id LEFT JOIN latest_node_metrics m ON m.node_id = n.id""",
    "fx_nodes", "live_nodes", "latest_node_metrics")

cte("latest_samples", """
SELECT node_id, MAX(ts) AS ts, arg_max(report_id, (ts, report_id)) AS report_id,
  arg_max(cpu_usage_percent, (ts, report_id)) AS cpu_usage_percent,
  arg_max(memory_usage_percent, (ts, report_id)) AS memory_usage_percent
FROM node_points GROUP BY node_id""", "node_points")

cte("latest_gpu", """
SELECT g.* FROM gpu_points g JOIN latest_samples l ON l.report_id = g.report_id""", "gpu_points", "latest_samples")

# ---- alerts -------------------------------------------------------------------------
# The agent's threshold rules (metric, max, min) and the admin alert rules
# (id, name, node_group, resource, operator, threshold, severity, enabled).
THRESHOLD_RULES = [
    ("cpu_usage_percent", 75.0, None),
    ("memory_usage_percent", 95.0, 5.0),
    ("process_count", None, 2.0),
    ("gpu_max_temperature_celsius", 85.0, None),
    ("gpu_utilization_percent", 99.0, None),
    ("disk_usage_percent", 90.0, None),
]
ALERT_RULES = [
    ("r1", "cpu high", "all", "cpu", ">", 90.0, "critical", True),
    ("r2", "cpu warn", "all", "cpu", ">=", 60.0, "warning", True),
    ("r3", "cpu idle", "all", "cpu", "<", 40.0, "info", True),
    ("r4", "net burst", "all", "net", ">", 5.0, "warning", True),
    ("r5", "mem any", "all", "mem", ">", 1.0, "info", False),
    ("r6", "gpu hot", "NATION_14", "gpu", ">=", 45.0, "warning", True),
    ("r7", "mem low", "NATION_6", "mem", "<=", 45.0, "info", True),
]


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(cols)})"


cte("threshold_rules", values_sql(THRESHOLD_RULES, ["metric_name", "max_value", "min_value"]))
cte("alert_rules", values_sql(ALERT_RULES, ["id", "name", "node_group", "resource", "operator", "threshold", "severity", "enabled"]))

PROC_METRICS = [("cpu_total_ns", "cpu_ontime_ns"), ("memory_total_bytes", "avg_rss_bytes"),
                ("disk_read_bytes", "read_bytes"), ("disk_write_bytes", "write_bytes"),
                ("network_rx_bytes", "net_rx_bytes"), ("network_tx_bytes", "net_tx_bytes")]
_nm = [f"SELECT report_id, '{n}' AS metric_name, CAST(SUM({c}) AS DOUBLE) AS metric_value, TRUE AS is_int FROM v_procs GROUP BY report_id"
       for n, c in PROC_METRICS]
_nm.append("SELECT report_id, 'process_count', CAST(COUNT(*) AS DOUBLE), TRUE FROM v_procs GROUP BY report_id")
_nm += [f"SELECT report_id, '{n}', CAST({c} AS DOUBLE), {b} FROM v_reports WHERE sm_ok" for n, c, b in [
    ("cpu_usage_percent", "cpu_usage_percent", "FALSE"), ("memory_usage_percent", "memory_usage_percent", "FALSE"),
    ("system_memory_used_bytes", "memory_used_bytes", "TRUE"), ("system_memory_total_bytes", "memory_total_bytes", "TRUE")]]
_nm += [f"SELECT report_id, 'gpu_' || CAST(gpu_index AS VARCHAR) || '_{n}', CAST({c} AS DOUBLE), {b} FROM sm_gpus" for n, c, b in [
    ("utilization_percent", "utilization_percent", "FALSE"), ("temperature_celsius", "temperature_celsius", "FALSE"),
    ("power_watts", "power_watts", "FALSE"), ("memory_used_mib", "memory_used_mib", "TRUE"), ("memory_total_mib", "NULL", "TRUE")]]
_nm += [f"SELECT report_id, '{n}', CAST({a} AS DOUBLE), {b} FROM sm_gpus GROUP BY report_id" for n, a, b in [
    ("gpu_max_utilization_percent", "MAX(utilization_percent)", "FALSE"),
    ("gpu_max_temperature_celsius", "MAX(temperature_celsius)", "FALSE"), ("gpu_max_power_watts", "MAX(power_watts)", "FALSE"),
    ("gpu_total_memory_used_mib", "SUM(memory_used_mib)", "TRUE"), ("gpu_count", "COUNT(*)", "TRUE"),
    ("gpu_utilization_percent", "MAX(utilization_percent)", "FALSE")]]

cte("sm_gpus", "SELECT * FROM fx_gpus WHERE report_id IN (SELECT report_id FROM v_reports WHERE sm_ok)", "fx_gpus", "v_reports")
cte("node_metrics", "SELECT r.report_id, r.node_id, r.\"timestamp\", m.metric_name, m.metric_value, m.is_int FROM ("
    + "\nUNION ALL ".join(_nm) + ") m JOIN v_reports r ON r.report_id = m.report_id", "v_procs", "v_reports", "sm_gpus")

cte("threshold_alerts", """
SELECT * FROM (
  SELECT m.report_id, m.node_id, m."timestamp", m.metric_name, m.metric_value, m.is_int, t.max_value AS threshold_max,
    t.min_value AS threshold_min,
    CASE WHEN t.min_value IS NOT NULL AND m.metric_value < t.min_value THEN 'below_min'
         WHEN t.max_value IS NOT NULL AND m.metric_value > t.max_value THEN 'exceeded_max' END AS violation_type
  FROM node_metrics m JOIN threshold_rules t ON t.metric_name = m.metric_name) x
WHERE violation_type IS NOT NULL""", "node_metrics", "threshold_rules")


def _num_text_sql(x: str, is_int: str | None = None) -> str:
    if is_int is not None:
        return f"CASE WHEN {x} IS NULL THEN 'None' WHEN {is_int} THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    return f"CASE WHEN {x} IS NULL THEN 'None' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


cte("alert_records", f"""
SELECT node_id, 'collect_agent_1' AS collect_agent_id, metric_name AS alert_type,
  CASE WHEN violation_type = 'exceeded_max' THEN 'critical' ELSE 'warning' END AS severity,
  'Threshold violation: ' || metric_name || ' value ' || {_num_text_sql('metric_value', 'is_int')} || ' ' || violation_type
    || ' (max: ' || {_num_text_sql('threshold_max')} || ', min: ' || {_num_text_sql('threshold_min')} || ')' AS message,
  CAST("timestamp" AS BIGINT) AS "timestamp",
  MAP {{'metric_value': {_num_text_sql('metric_value', 'is_int')}, 'threshold_max': {_num_text_sql('threshold_max')},
       'threshold_min': {_num_text_sql('threshold_min')}, 'violation_type': violation_type}} AS metadata
FROM threshold_alerts""", "threshold_alerts")

cte("group_alerts", """
SELECT r.id || ':' || v.node_id || ':' || strftime(v.bucket_time, '%Y%m%d%H') AS id, r.id AS rule_id, r.severity,
  r.name || ': ' || v.resource || ' ' || r.operator || ' ' || CAST(r.threshold AS VARCHAR) AS message, v.node_id, v.value,
  FALSE AS acknowledged, v.bucket_time AS created_at
FROM (SELECT bucket_time, node_id, 'cpu' AS resource, avg_cpu_usage_percent AS value FROM node_status_hourly
      UNION ALL SELECT bucket_time, node_id, 'mem', avg_mem_usage_percent FROM node_status_hourly
      UNION ALL SELECT bucket_time, node_id, 'gpu', avg_gpu_utilization FROM node_status_hourly
      UNION ALL SELECT bucket_time, node_id, 'disk', CAST(total_disk_read_bytes + total_disk_write_bytes AS DOUBLE) / 1048576.0 FROM node_status_hourly
      UNION ALL SELECT bucket_time, node_id, 'net', CAST(total_net_rx_bytes + total_net_tx_bytes AS DOUBLE) / 1048576.0 FROM node_status_hourly) v
LEFT JOIN fx_nodes n ON n.id = v.node_id
JOIN alert_rules r ON r.resource = v.resource AND r.enabled
WHERE (r.node_group = 'all' OR r.node_group = n.group_name)
  AND coalesce(CASE r.operator WHEN '>' THEN v.value > r.threshold WHEN '>=' THEN v.value >= r.threshold
                WHEN '<' THEN v.value < r.threshold WHEN '<=' THEN v.value <= r.threshold ELSE FALSE END, FALSE)""",
    "node_status_hourly", "fx_nodes", "alert_rules")

# ---- collector-side stages -----------------------------------------------------------
COLLECT_PREFIXES = ["SMALL", "SMALL-1"]
PROJECTED_FIELDS = ["pid", "comm", "cpu_ontime_ns", "bogus"]
SYSTEM_PREFIXES = ["ECONOMY", "PROMO"]
SAMPLE_RATE = 0.25

cte("sm_all", """
SELECT r.*, coalesce(r.has_system_metrics AND r.cpu_usage_percent BETWEEN 0 AND 100 AND r.memory_usage_percent BETWEEN 0 AND 100
    AND r.memory_used_bytes >= 0 AND r.memory_total_bytes >= 0 AND coalesce(g.gpus_ok, TRUE), FALSE) AS sm_valid
FROM fx_reports r
LEFT JOIN (SELECT report_id, bool_and(coalesce(utilization_percent BETWEEN 0 AND 100 AND temperature_celsius BETWEEN -50 AND 200 AND power_watts >= 0, FALSE)) AS gpus_ok
           FROM fx_gpus GROUP BY report_id) g ON g.report_id = r.report_id""", "fx_reports", "fx_gpus")

cte("v_procs_pos", "SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS vpos FROM v_procs", "v_procs")

cte("pfx_tagged", """
SELECT *, CASE WHEN starts_with(comm, 'SMALL-1') THEN 'SMALL-1' WHEN starts_with(comm, 'SMALL') THEN 'SMALL' END AS pfx
FROM v_procs_pos""", "v_procs_pos")

_SUMS = ["cpu_ontime_ns", "read_bytes", "write_bytes", "net_rx_bytes", "net_tx_bytes", "avg_rss_bytes", "gpu_used_memory_mib"]
cte("prefix_merged", f"""
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY grp, ord) AS INTEGER) AS pos, pid, uid, comm, process_name,
  {", ".join(_SUMS)}
FROM (SELECT report_id, 0 AS grp, MIN(vpos) AS ord, CAST(0 AS BIGINT) AS pid, uid, pfx AS comm, '' AS process_name,
        {", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in _SUMS)}
      FROM pfx_tagged WHERE pfx IS NOT NULL GROUP BY report_id, uid, pfx
      UNION ALL
      SELECT report_id, 1, vpos, pid, uid, comm, '', {", ".join(_SUMS)} FROM pfx_tagged WHERE pfx IS NULL) u""", "pfx_tagged")

# Violations per surviving report under THRESHOLD_RULES, with the merged process count.
cte("collect_out", """
SELECT r.report_id, r.node_id, r."timestamp", CAST(c.n AS INTEGER) AS n_processes, c.cpu AS cpu_total_ns,
  'collect_agent_1' AS collect_agent_id, 'enriched' AS processing_stage,
  CAST((CASE WHEN r.sm_ok AND r.cpu_usage_percent > 75 THEN 1 ELSE 0 END)
     + (CASE WHEN r.sm_ok AND (r.memory_usage_percent < 5 OR r.memory_usage_percent > 95) THEN 1 ELSE 0 END)
     + (CASE WHEN c.n < 2 THEN 1 ELSE 0 END)
     + (CASE WHEN g.mt > 85 THEN 1 ELSE 0 END)
     + (CASE WHEN g.mu > 99 THEN 1 ELSE 0 END) AS BIGINT) AS n_alerts
FROM v_reports r
JOIN (SELECT report_id, COUNT(*) AS n, CAST(SUM(cpu_ontime_ns) AS BIGINT) AS cpu FROM prefix_merged GROUP BY report_id) c ON c.report_id = r.report_id
LEFT JOIN (SELECT report_id, MAX(temperature_celsius) AS mt, MAX(utilization_percent) AS mu FROM sm_gpus GROUP BY report_id) g
  ON g.report_id = r.report_id""", "v_reports", "prefix_merged", "sm_gpus")

cte("proc_counts", """
SELECT r.report_id, r.node_id, COUNT(p.report_id) AS n, CAST(coalesce(SUM(p.cpu_ontime_ns), 0) AS BIGINT) AS cpu
FROM fx_reports r LEFT JOIN fx_processes p ON p.report_id = r.report_id GROUP BY r.report_id, r.node_id""",
    "fx_reports", "fx_processes")

# ---- host samples -------------------------------------------------------------------
cte("switches", "SELECT node_id, cpu, ts, event_id AS seq, pid, user_id AS uid, event_type AS comm FROM host_events", "host_events")
# HST-2 from the event trace: a fork starts generation g of its pid; the last generation counts,
# up to its first exit.
cte("sched", """
SELECT node_id, pid, ts, event_id AS seq, user_id % 50 AS ppid, 'proc_' || CAST(user_id % 7 AS VARCHAR) AS comm,
  CASE event_type WHEN 'signup' THEN 'fork' WHEN 'purchase' THEN 'exec' WHEN 'error' THEN 'exit' ELSE 'switch' END AS type FROM host_events""",
    "host_events")
cte("lifecycle", """
SELECT node_id, pid, max(ppid) FILTER (type = 'fork') AS ppid,
  coalesce(arg_max(comm, (ts, seq)) FILTER (type = 'exec' AND ended = 0), max(comm) FILTER (type = 'fork')) AS comm, max(ended) > 0 AS exited
FROM (SELECT *, count(*) FILTER (type = 'exit') OVER (PARTITION BY node_id, pid ORDER BY ts, seq) AS ended
      FROM (SELECT * FROM (SELECT *, count(*) FILTER (type = 'fork') OVER (PARTITION BY node_id, pid ORDER BY ts, seq) AS g FROM sched) a
            QUALIFY g > 0 AND g = max(g) OVER (PARTITION BY node_id, pid)) b) c
GROUP BY node_id, pid""", "sched")

cte("oncpu", """
SELECT s.node_id, s.pid, s.cpu_ontime_ns, i.uid, i.comm FROM (
  SELECT node_id, prev_pid AS pid, CAST(SUM(d) AS BIGINT) AS cpu_ontime_ns FROM (
    SELECT node_id, LAG(pid) OVER w AS prev_pid, (epoch_us(ts) - LAG(epoch_us(ts)) OVER w) * 1000 AS d
    FROM switches WINDOW w AS (PARTITION BY node_id, cpu ORDER BY ts, seq)) x
  WHERE d IS NOT NULL AND prev_pid <> 0 GROUP BY 1, 2) s
LEFT JOIN (SELECT node_id, pid, arg_max(uid, (ts, seq)) AS uid, arg_max(comm, (ts, seq)) AS comm FROM switches GROUP BY 1, 2) i
  ON i.node_id = s.node_id AND i.pid = s.pid""", "switches")
cte("syscalls", """
SELECT node_id, ts, pid, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'recvfrom'
  WHEN 'signup' THEN 'sendto' ELSE 'pwrite64' END AS name, ret FROM host_events""", "host_events")
cte("disk_bytes", """
SELECT * FROM (SELECT node_id, pid, CAST(SUM(CASE WHEN name IN ('read', 'pread64') THEN ret ELSE 0 END) AS BIGINT) AS read_bytes,
  CAST(SUM(CASE WHEN name IN ('write', 'pwrite64') THEN ret ELSE 0 END) AS BIGINT) AS write_bytes
FROM syscalls WHERE ret > 0 AND pid <> 0 GROUP BY 1, 2) x WHERE read_bytes > 0 OR write_bytes > 0""", "syscalls")
cte("net_bytes", """
SELECT * FROM (SELECT node_id, pid, CAST(SUM(CASE WHEN name IN ('recvfrom', 'recvmsg') THEN ret ELSE 0 END) AS BIGINT) AS net_rx_bytes,
  CAST(SUM(CASE WHEN name IN ('sendto', 'sendmsg') THEN ret ELSE 0 END) AS BIGINT) AS net_tx_bytes
FROM syscalls WHERE ret > 0 AND pid <> 0 GROUP BY 1, 2) x WHERE net_rx_bytes > 0 OR net_tx_bytes > 0""", "syscalls")
cte("avg_rss", """
SELECT node_id, pid, CAST(SUM(rss) // COUNT(rss) AS BIGINT) AS avg_rss_bytes FROM (
  SELECT node_id, pid, CAST(floor(value) AS BIGINT) * 1024 AS rss FROM host_events) x
GROUP BY 1, 2 HAVING SUM(rss) > 0""", "host_events")
HOST_WINDOW_US = 600_000_000
cte("gpu_files", f"""
SELECT *, make_timestamp(epoch_us(ts) // {HOST_WINDOW_US} * {HOST_WINDOW_US}) AS window_start,
  (CAST(substr(node_id, 6) AS BIGINT) + epoch_us(ts) // {HOST_WINDOW_US}) % 4 AS v FROM host_events""", "host_events")
cte("gpu_proc_lines", """
SELECT DISTINCT node_id, window_start, CAST(0 AS BIGINT) AS line_no, CASE v WHEN 0 THEN 'pid, process_name, used_gpu_memory [MiB]'
  WHEN 1 THEN 'pid, process_name, used_memory' WHEN 2 THEN 'used_memory [MiB], pid, process_name' ELSE 'pid, name, memory' END AS line FROM gpu_files
UNION ALL
SELECT node_id, window_start, event_id + 1, CASE WHEN v = 2 THEN mem || ', ' || CAST(pid AS VARCHAR) || ', ' || event_type
  ELSE CAST(pid AS VARCHAR) || ', ' || event_type || ', ' || mem END
FROM (SELECT *, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' MiB' AS mem FROM gpu_files) f""", "gpu_files")
cte("gpu_proc", """
SELECT l.node_id, l.window_start, l.line_no, TRY_CAST(p[h.pi + 1] AS BIGINT) AS pid, p[h.ni + 1] AS process_name,
  TRY_CAST(TRY_CAST(trim(replace(replace(p[h.mi + 1], 'MiB', ''), 'Mib', '')) AS DOUBLE) AS BIGINT) AS used_memory_mib
FROM (SELECT node_id, window_start, line_no, list_transform(string_split(line, ','), lambda x: trim(x)) AS p FROM gpu_proc_lines WHERE line_no > 0) l
JOIN (SELECT node_id, window_start, CASE WHEN pi < 0 OR ni < 0 OR mi < 0 THEN 0 ELSE pi END AS pi, CASE WHEN pi < 0 OR ni < 0 OR mi < 0 THEN 1 ELSE ni END AS ni,
        CASE WHEN pi < 0 OR ni < 0 OR mi < 0 THEN 2 ELSE mi END AS mi
      FROM (SELECT node_id, window_start, coalesce(list_position(h, 'pid') - 1, -1) AS pi, coalesce(list_position(h, 'process_name') - 1, -1) AS ni,
              coalesce(list_position(h, 'used_memory') - 1, list_position(h, 'used_gpu_memory [MiB]') - 1,
                       list_position(h, 'used_gpu_memory') - 1, list_position(h, 'used_memory [MiB]') - 1, -1) AS mi
            FROM (SELECT node_id, window_start, list_transform(string_split(line, ','), lambda x: trim(x)) AS h FROM gpu_proc_lines WHERE line_no = 0) a) b) h
  ON h.node_id = l.node_id AND h.window_start = l.window_start
WHERE len(p) > greatest(h.pi, h.ni, h.mi) AND TRY_CAST(p[h.pi + 1] AS BIGINT) IS NOT NULL
  AND TRY_CAST(TRY_CAST(trim(replace(replace(p[h.mi + 1], 'MiB', ''), 'Mib', '')) AS DOUBLE) AS BIGINT) IS NOT NULL""", "gpu_proc_lines")

# Runs on a CPU, split at window borders, and the lives of a pid.
cte("cpu_runs", """
SELECT node_id, cpu, pid, uid, comm, seq, s, e FROM (
  SELECT node_id, cpu, LAG(pid) OVER w AS pid, LAG(uid) OVER w AS uid, LAG(comm) OVER w AS comm, LAG(seq) OVER w AS seq,
    LAG(epoch_us(ts)) OVER w AS s, epoch_us(ts) AS e
  FROM switches WINDOW w AS (PARTITION BY node_id, cpu ORDER BY ts, seq)) x
WHERE s IS NOT NULL AND pid <> 0""", "switches")
cte("oncpu_window", f"""
SELECT node_id, make_timestamp(w * {HOST_WINDOW_US}) AS window_start, pid,
  CAST(SUM(least(e, (w + 1) * {HOST_WINDOW_US}) - greatest(s, w * {HOST_WINDOW_US})) * 1000 AS BIGINT) AS cpu_ontime_ns,
  arg_max(uid, (s, seq)) AS uid, arg_max(comm, (s, seq)) AS comm
FROM (SELECT *, unnest(range(s // {HOST_WINDOW_US}, (e - 1) // {HOST_WINDOW_US} + 1)) AS w FROM cpu_runs WHERE e > s) x
GROUP BY node_id, w, pid""", "cpu_runs")
cte("lives", """
SELECT node_id, pid, life_start, life_seq, ppid, comm,
  coalesce(exit_ts, LEAD(life_start) OVER (PARTITION BY node_id, pid ORDER BY life_start, life_seq)) AS life_end, exit_ts IS NOT NULL AS exited
FROM (
  SELECT node_id, pid, g, max(ts) FILTER (type = 'fork') AS life_start, max(seq) FILTER (type = 'fork') AS life_seq, max(ppid) FILTER (type = 'fork') AS ppid,
    coalesce(arg_max(comm, (ts, seq)) FILTER (type = 'exec' AND ended = 0), max(comm) FILTER (type = 'fork')) AS comm, min(ts) FILTER (type = 'exit') AS exit_ts
  FROM (SELECT *, count(*) FILTER (type = 'exit') OVER (PARTITION BY node_id, pid, g ORDER BY ts, seq) AS ended
        FROM (SELECT *, count(*) FILTER (type = 'fork') OVER (PARTITION BY node_id, pid ORDER BY ts, seq) AS g FROM sched) a WHERE g > 0) b
  GROUP BY node_id, pid, g) c""", "sched")
cte("window_merge", f"""
SELECT c.node_id, c.window_start, c.pid, c.cpu_ontime_ns, CAST(coalesce(c.uid, -1) AS BIGINT) AS uid, coalesce(c.comm, '') AS comm,
  coalesce(i.read_bytes, 0) AS read_bytes, coalesce(i.write_bytes, 0) AS write_bytes, coalesce(i.net_rx_bytes, 0) AS net_rx_bytes,
  coalesce(i.net_tx_bytes, 0) AS net_tx_bytes, coalesce(r.avg_rss_bytes, 0) AS avg_rss_bytes, coalesce(g.used_memory_mib, 0) AS gpu_used_memory_mib,
  CAST(coalesce(l.ppid, 0) AS BIGINT) AS ppid, coalesce(g.process_name, '') AS process_name,
  coalesce(l.exited AND l.life_end >= c.window_start AND l.life_end <= c.last, FALSE) AS exited
FROM (SELECT *, window_start + to_microseconds({HOST_WINDOW_US - 1}) AS last FROM oncpu_window) c
LEFT JOIN (SELECT node_id, make_timestamp(epoch_us(ts) // {HOST_WINDOW_US} * {HOST_WINDOW_US}) AS window_start, pid,
    CAST(SUM(CASE WHEN name IN ('read', 'pread64') THEN ret ELSE 0 END) AS BIGINT) AS read_bytes,
    CAST(SUM(CASE WHEN name IN ('write', 'pwrite64') THEN ret ELSE 0 END) AS BIGINT) AS write_bytes,
    CAST(SUM(CASE WHEN name IN ('recvfrom', 'recvmsg') THEN ret ELSE 0 END) AS BIGINT) AS net_rx_bytes,
    CAST(SUM(CASE WHEN name IN ('sendto', 'sendmsg') THEN ret ELSE 0 END) AS BIGINT) AS net_tx_bytes
  FROM syscalls WHERE ret > 0 GROUP BY ALL) i ON i.node_id = c.node_id AND i.window_start = c.window_start AND i.pid = c.pid
LEFT JOIN (SELECT node_id, make_timestamp(epoch_us(ts) // {HOST_WINDOW_US} * {HOST_WINDOW_US}) AS window_start, pid,
    CAST(SUM(CAST(floor(value) AS BIGINT) * 1024) // COUNT(*) AS BIGINT) AS avg_rss_bytes
  FROM host_events GROUP BY ALL HAVING SUM(CAST(floor(value) AS BIGINT)) > 0) r ON r.node_id = c.node_id AND r.window_start = c.window_start AND r.pid = c.pid
LEFT JOIN (SELECT node_id, window_start, pid, arg_max(used_memory_mib, line_no) AS used_memory_mib, arg_max(process_name, line_no) AS process_name
  FROM gpu_proc GROUP BY ALL) g ON g.node_id = c.node_id AND g.window_start = c.window_start AND g.pid = c.pid
ASOF LEFT JOIN lives l ON l.node_id = c.node_id AND l.pid = c.pid AND c.last >= l.life_start""",
    "oncpu_window", "syscalls", "host_events", "gpu_proc", "lives")

# ---- pipeline rules -----------------------------------------------------------------
# Admin pipeline rules (id, name, type, resource, condition, enabled).
PIPELINE_RULES = [
    {"id": "p1", "name": "drop_zero_cpu", "type": "filter", "resource": "cpu", "condition": "value == 0", "enabled": True},
    {"id": "p2", "name": "drop_small_rss", "type": "filter", "resource": "mem",
     "condition": "value < 2000000 or value > 400000000", "enabled": True},
    {"id": "p3", "name": "cpu_seconds", "type": "derive", "resource": "cpu", "condition": "value / 1000000000", "enabled": True},
    {"id": "p4", "name": "io_mb", "type": "derive", "resource": "disk", "condition": "(value + net_rx_bytes) / 1048576",
     "enabled": True},
    {"id": "p5", "name": "peak_rss", "type": "aggregate", "resource": "mem", "condition": "max", "enabled": True},
    {"id": "p6", "name": "mean_cpu", "type": "aggregate", "resource": "cpu", "condition": "avg", "enabled": True},
    {"id": "p7", "name": "disabled_drop", "type": "filter", "resource": "net", "condition": "value > 0", "enabled": False},
]
