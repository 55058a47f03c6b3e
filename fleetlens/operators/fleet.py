"""Fleet state: live config, heartbeats, liveness, settings, drift, node overview
(SURVEY SRC-5/6, JON-3..8, WIN-1, STA-3/4, AGG-23/24/29, TOP-6/7, SCL-12/13).

The live key-value space is read as a two-column table ``(key, value)``. Per-node state is
reduced with grouped aggregates (``max_by``) rather than windows, so partial aggregation
bounds the work of a node that sends most of the heartbeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cluster_health, stable, status_map
from .joins import checked_broadcast
from .windows import asof

# Key prefixes and the known per-node config fields.
NODE_PREFIX = "/config/compute_node/"
HEARTBEAT_PREFIX = "/nodes/"
AGENT_PREFIX = "/config/collect_agent/"
AGENT_FIELDS = ["kafka_topic", "window"]
NODE_FIELDS = ["heartbeat_interval", "status", "target_collect_agent", "window"]
DEFAULT_HEARTBEAT_INTERVAL = "20"
FALLBACK_THRESHOLD_S = 60.0
DEFAULT_INTERVAL_S, DEFAULT_WINDOW_S = 10, 60

HEARTBEAT_SCHEMA = "timestamp DOUBLE, status STRING, collection_active BOOLEAN"
_LEADING_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def parse_float(text: Column) -> Column:
    """Leading-number parse of config text ("10.0" -> 10.0, "12abc" -> 12.0, "bad" -> null)."""
    return F.regexp_extract(F.trim(text), _LEADING_NUMBER, 0).try_cast("double")


def split_key(kv: DataFrame, prefix: str) -> DataFrame:
    """(key, value) -> (id, field, value) for keys under ``prefix``; keys without a second
    '/' are skipped."""
    rel = F.substring(F.col("key"), len(prefix) + 1, 1 << 30)
    slash = F.instr(rel, "/")
    x = kv.filter(F.col("key").startswith(prefix)).select(rel.alias("_rel"), slash.alias("_s"), "value")
    x = x.filter(F.col("_s") > 0)
    return x.select(F.expr("substring(_rel, 1, _s - 1)").alias("node_id"),
                    F.expr("substring(_rel, _s + 1)").alias("field"), "value")


def config_kv_pivot(kv: DataFrame, fields: Sequence[str] = NODE_FIELDS) -> DataFrame:
    """SRC-5: one row per node id with a column per known field (explicit pivot list)."""
    s = split_key(kv, NODE_PREFIX)
    return s.groupBy("node_id").pivot("field", list(fields)).agg(F.max("value"))


def agent_list(kv: DataFrame, fields: Sequence[str] = AGENT_FIELDS) -> DataFrame:
    """SRC-5, collect agents: one row per agent id with a column per listed field. The ids
    are also the targets of a push to every agent."""
    s = split_key(kv, AGENT_PREFIX).withColumnRenamed("node_id", "agent_id")
    return s.groupBy("agent_id").pivot("field", list(fields)).agg(F.max("value"))


def heartbeat_kv(heartbeats: DataFrame) -> DataFrame:
    """The live store keeps one heartbeat value per node: the newest event, as JSON text."""
    last = heartbeats.groupBy("node_id").agg(F.max_by(F.struct("event_time", "status"), "event_time").alias("h"))
    value = F.to_json(F.struct(
        F.col("h.event_time").cast("double").alias("timestamp"), F.col("h.status").alias("status"),
        (F.col("h.status") == "alive").alias("collection_active")))
    return last.select(F.concat(F.lit(HEARTBEAT_PREFIX), "node_id", F.lit("/heartbeat")).alias("key"), value.alias("value"))


def heartbeat_parse(kv: DataFrame) -> DataFrame:
    """SRC-6: keep ``/nodes/{id}/heartbeat`` keys, parse the JSON value; malformed or
    non-object values are dropped."""
    s = split_key(kv, HEARTBEAT_PREFIX).filter(F.col("field") == "heartbeat")
    p = s.select("node_id", F.from_json("value", HEARTBEAT_SCHEMA, {"mode": "PERMISSIVE"}).alias("hb"), "value")
    ok = F.col("hb").isNotNull() & F.trim(F.col("value")).startswith("{")
    return p.filter(ok).select("node_id", "hb.timestamp", "hb.status", "hb.collection_active")


def liveness(node_config: DataFrame, heartbeats: DataFrame, as_of: Column) -> DataFrame:
    """STA-3 + JON-7: running when the heartbeat says alive and is at most 3 x interval
    old (interval default 20 s; not a number -> 60 s threshold), else stopped.

    ``node_config``: pivoted live config; ``heartbeats``: parsed (node_id, timestamp, status).
    ``as_of``: the clock, an explicit parameter."""
    interval = parse_float(F.coalesce(F.col("heartbeat_interval"), F.lit(DEFAULT_HEARTBEAT_INTERVAL)))
    threshold = F.coalesce(interval * 3, F.lit(FALLBACK_THRESHOLD_S))
    now_s = F.floor(as_of.cast("double"))
    hb = heartbeats.select("node_id", F.col("timestamp").alias("hb_ts"), F.col("status").alias("hb_status"))
    j = node_config.drop("status").join(hb, "node_id", "left")
    alive = F.coalesce((F.col("hb_status") == "alive") & ((now_s - F.col("hb_ts")) <= threshold), F.lit(False))
    return j.select(*[c for c in node_config.columns if c != "status"],
                    F.when(alive, F.lit("running")).otherwise(F.lit("stopped")).alias("status"))


def latest_by_key(df: DataFrame, key: str | Sequence[str], order: str, cols: Sequence[str],
                  tiebreak: str | None = None) -> DataFrame:
    """WIN-1: the newest row per key as a grouped ``max_by`` (no sort, partial aggregation).
    ``tiebreak`` (e.g. the ingest order) decides between rows with the same time."""
    keys = [key] if isinstance(key, str) else list(key)
    by = F.struct(order, tiebreak) if tiebreak else F.col(order)
    g = df.groupBy(*keys).agg(F.max_by(F.struct(order, *cols), by).alias("_l"))
    return g.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in [order, *cols]])


def latest_node_metrics(node_hourly: DataFrame) -> DataFrame:
    """WIN-1: per node the newest hourly row: cpu, gpu, mem."""
    h = node_hourly.select("node_id", "bucket_time", F.col("avg_cpu_usage_percent").alias("cpu"),
                           F.col("avg_gpu_utilization").alias("gpu"), F.col("avg_mem_usage_percent").alias("mem"))
    return latest_by_key(h, "node_id", "bucket_time", ["cpu", "gpu", "mem"])


def collection_settings_list(nodes: DataFrame, settings: DataFrame) -> DataFrame:
    """JON-3: every registered node with its settings, defaults 10 s / 60 s."""
    s = settings.select("node_id", "interval_seconds", "window_seconds")
    j = nodes.join(s, nodes.id == s.node_id, "left")
    return j.select("id", "name", "ip", "group_name", "collect_agent",
                    F.coalesce("interval_seconds", F.lit(DEFAULT_INTERVAL_S)).alias("interval_seconds"),
                    F.coalesce("window_seconds", F.lit(DEFAULT_WINDOW_S)).alias("window_seconds")).orderBy("name")


def effective_settings(nodes: DataFrame, settings: DataFrame) -> DataFrame:
    """JON-4: as JON-3, and the agent falls back to the node's default agent."""
    s = settings.select("node_id", "interval_seconds", "window_seconds", F.col("collect_agent").alias("cs_agent"))
    j = nodes.join(s, nodes.id == s.node_id, "left")
    return j.select(F.col("id").alias("node_id"), "name", "group_name", F.col("collect_agent").alias("default_agent"),
                    F.coalesce("interval_seconds", F.lit(DEFAULT_INTERVAL_S)).alias("interval_seconds"),
                    F.coalesce("window_seconds", F.lit(DEFAULT_WINDOW_S)).alias("window_seconds"),
                    F.coalesce("cs_agent", "collect_agent").alias("collect_agent"))


def config_drift(db_rows: DataFrame, live: DataFrame) -> DataFrame:
    """JON-8: database settings against live config; a missing live field counts as a
    match, a node missing from the live store is not synced."""
    lv = live.select("node_id", F.col("window").alias("lv_window"),
                     F.col("heartbeat_interval").alias("lv_interval"),
                     F.col("target_collect_agent").alias("lv_agent"), F.col("status").alias("lv_status"),
                     F.lit(True).alias("_loaded"))
    j = db_rows.join(lv, db_rows.id == lv.node_id, "left")

    def match(live_col: str, db_val: Column) -> Column:
        return F.when(F.col(live_col).isNull(), F.lit(True)).otherwise(F.coalesce(parse_float(F.col(live_col)) == db_val, F.lit(False)))

    agent_ok = F.when(F.col("lv_agent").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("lv_agent") == F.col("collect_agent"), F.lit(False)))
    synced = match("lv_window", F.col("window_seconds")) & match("lv_interval", F.col("interval_seconds")) & agent_ok
    loaded = F.coalesce("_loaded", F.lit(False))
    return j.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"), F.col("group_name").alias("group"),
                    "interval_seconds", "window_seconds", "collect_agent",
                    F.coalesce("lv_status", F.lit("unknown")).alias("etcd_status"),
                    loaded.alias("etcd_loaded"),
                    F.when(loaded, synced).otherwise(F.lit(False)).alias("etcd_synced"))


def node_overview(nodes: DataFrame, live: DataFrame, latest: DataFrame) -> DataFrame:
    """JON-6 + SCL-13: registry drives; live config and newest metrics are looked up."""
    lv = live.select("node_id", F.col("status").alias("etcd_status_"), F.col("target_collect_agent").alias("agent_"),
                     F.col("window").alias("window"), F.col("heartbeat_interval").alias("heartbeat"),
                     F.lit(True).alias("_loaded"))
    m = latest.select(F.col("node_id").alias("m_node"), "cpu", "gpu", "mem")
    j = nodes.join(lv, nodes.id == lv.node_id, "left").join(m, F.col("id") == F.col("m_node"), "left")
    es = F.coalesce("etcd_status_", F.lit("unknown"))
    return j.select("id", "name", "ip", F.col("group_name").alias("group"), status_map(es).alias("status"),
                    es.alias("etcd_status"), F.coalesce("_loaded", F.lit(False)).alias("etcd_loaded"),
                    F.coalesce("agent_", F.lit("UNKNOWN")).alias("collect_agent"), "window", "heartbeat",
                    "cpu", "gpu", "mem")


def status_counts(overview: DataFrame) -> DataFrame:
    """AGG-23 + SCL-12: total / active / down / idle and the health label."""
    c = overview.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(F.col("status") == "active").alias("active"),
                     F.count_if(F.col("status") == "down").alias("down"),
                     F.count_if(F.col("status") == "idle").alias("idle"))
    return c.withColumn("health", cluster_health(F.col("active"), F.col("total")))


def config_counters(drift: DataFrame) -> DataFrame:
    """AGG-24 (settings part): running, stopped and out-of-sync nodes."""
    return drift.agg(F.count_if(F.col("etcd_status") == "running").alias("running"),
                     F.count_if(F.col("etcd_status") == "stopped").alias("stopped"),
                     F.count_if(F.col("etcd_loaded") & ~F.col("etcd_synced")).alias("out_of_sync"))


def rule_counters(rules: DataFrame, syncable: Column | None = None) -> DataFrame:
    """AGG-24 (rules part): enabled rules and, for alert rules, pushable ones."""
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("enabled")).alias("enabled")]
    if syncable is not None:
        aggs.append(F.count_if(F.col("enabled") & syncable).alias("syncable"))
    return rules.agg(*aggs)


def latest_samples(node_points: DataFrame) -> DataFrame:
    """Each node's newest raw sample (the dashboards' "current" values); between points of
    the same second the later write (higher ``report_id``) wins, as in series overwrite."""
    cols = [c for c in node_points.columns if c not in ("node_id", "ts")]
    tb = "report_id" if "report_id" in node_points.columns else None
    return latest_by_key(node_points, "node_id", "ts", cols, tb)


def cluster_now(node_points: DataFrame, gpu_points: DataFrame, proc_points: DataFrame) -> DataFrame:
    """AGG-29: aggregates over each node's newest sample: active nodes, active users, mean
    cpu / mem / GPU util / GPU memory / GPU temperature / GPU power."""
    ln = latest_samples(node_points)
    # GPU rows of each node's newest report; process rows at each node's newest second.
    g = samples_at_latest(gpu_points, ln)
    p = proc_points.join(ln.select("node_id", "ts"), ["node_id", "ts"], "left_semi")
    n = ln.agg(F.count(F.lit(1)).alias("active_nodes"), stable(F.avg("cpu_usage_percent")).alias("avg_cpu_pct"),
               stable(F.avg("memory_usage_percent")).alias("avg_mem_pct"))
    gg = g.agg(stable(F.avg("utilization_percent")).alias("avg_gpu_util_pct"),
               stable(F.avg("memory_used_mib")).alias("avg_gpu_mem_mib"),
               stable(F.avg("temperature_celsius")).alias("avg_gpu_temp_c"),
               stable(F.avg("power_watts")).alias("avg_gpu_power_w"))
    pp = p.filter(F.col("uid") >= 1000).agg(F.countDistinct("uid").alias("active_users"))
    # one row each: stacked and folded into one, no scalar subqueries over the same rows
    rows = n.unionByName(gg, allowMissingColumns=True).unionByName(pp, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("active_nodes", "active_users", "avg_cpu_pct", "avg_mem_pct", "avg_gpu_util_pct",
                                                  "avg_gpu_mem_mib", "avg_gpu_temp_c", "avg_gpu_power_w")])


# Metric choices for the max-metric panels (panel -> source, column).
MAX_METRICS = {
    "cpu": ("node", "cpu_usage_percent"),
    "cpu_mem": ("node", "memory_usage_percent"),
    "gpu": ("gpu", "utilization_percent"),
    "gpu_mem": ("gpu", "memory_used_mib"),
    "gpu_temp": ("gpu", "temperature_celsius"),
    "gpu_power": ("gpu", "power_watts"),
}


def samples_at_latest(points: DataFrame, latest_node: DataFrame) -> DataFrame:
    """Rows of a point table from each node's newest report."""
    if "report_id" in points.columns and "report_id" in latest_node.columns:
        return points.join(latest_node.select("report_id"), "report_id", "left_semi")
    return points.join(latest_node.select("node_id", "ts"), ["node_id", "ts"], "left_semi")


def max_metric_node(latest_node: DataFrame, latest_gpu: DataFrame) -> DataFrame:
    """TOP-6: per panel metric, the node with the max newest value (ties -> smallest node
    id). Long form by unpivot, then one grouped min over (-value, node_id): no sort."""
    def long(d: DataFrame, src: str) -> DataFrame:
        m = [(k, c) for k, (s_, c) in MAX_METRICS.items() if s_ == src]
        w = d.select("node_id", *[F.col(c).cast("double").alias(k) for k, c in m])
        return w.unpivot("node_id", [k for k, _ in m], "metric", "value")
    x = long(latest_node, "node").unionByName(long(latest_gpu, "gpu")).filter(F.col("value").isNotNull())
    best = x.groupBy("metric").agg(F.min(F.struct(F.negative("value").alias("nv"), F.col("node_id"))).alias("_b"))
    return best.select("metric", F.col("_b.node_id").alias("node_id"), F.negative("_b.nv").alias("value"))


def free_nodes(latest_node: DataFrame, cpu_below: float = 10.0, mem_below: float = 50.0) -> DataFrame:
    """TOP-7: nodes whose newest sample is under both usage bounds, least busy first."""
    f = latest_node.filter((F.col("cpu_usage_percent") < cpu_below) & (F.col("memory_usage_percent") < mem_below))
    return f.select("node_id", "ts", "cpu_usage_percent", "memory_usage_percent").orderBy("cpu_usage_percent", "node_id")


def gate_running(reports: DataFrame, live: DataFrame) -> DataFrame:
    """STA-4: keep reports of nodes whose configured status is running (missing ->
    stopped). Stream-static join against the small live-config table."""
    running = live.filter(F.col("status") == "running").select("node_id")
    return reports.join(checked_broadcast(running), "node_id", "left_semi")


def gate_at_report_time(reports: DataFrame, changes: DataFrame, max_age_seconds: int, time: str = "event_time") -> DataFrame:
    """STA-4 by the status at the report's time: a report passes when the last status change of its
    node ``(node_id, change_time, seq, status)`` at or before it says running and is at most
    ``max_age_seconds`` old (agents repeat their status); without one the node counts as stopped.
    ``streaming.jobs.gate_stream`` is the same on streams."""
    j = asof(reports, changes, ["node_id"], F.col(time), F.col("change_time"), "seq", ["change_time", "status"], "_last")
    young = F.unix_micros(F.col(time)) - F.unix_micros("_last.change_time") <= max_age_seconds * 1_000_000
    return j.where((F.col("_last.status") == "running") & young).select(*reports.columns)


def heartbeat_gap(node_config: DataFrame) -> DataFrame:
    """(node_id, gap_seconds): how long a node may be silent, as in ``liveness``: 3 x interval."""
    interval = parse_float(F.coalesce(F.col("heartbeat_interval"), F.lit(DEFAULT_HEARTBEAT_INTERVAL)))
    return node_config.select("node_id", F.coalesce(interval * 3, F.lit(FALLBACK_THRESHOLD_S)).cast("bigint").alias("gap_seconds"))


def liveness_sessions(heartbeats: DataFrame, gaps: DataFrame, default_gap_seconds: int = 60) -> DataFrame:
    """STA-3 as sessions: each stretch in which a node's "alive" heartbeats follow one another within
    its gap: ``(node_id, alive_from, last_heartbeat, lapsed_at, n_heartbeats)``; it lapses one gap
    after its last heartbeat. A heartbeat exactly one gap after the last one still belongs to the
    stretch. ``gaps`` has (node_id, gap_seconds), one row per registered node; other nodes
    have the default gap.

    The same function runs on a stream with a watermark on ``event_time`` (append mode): a stretch
    is a row once the watermark has passed its lapse, and the state holds open stretches only."""
    alive = heartbeats.where("status = 'alive'").select("node_id", "event_time")
    h = alive.join(checked_broadcast(gaps), "node_id", "left")
    # one microsecond more, as a session is open at its end
    gap = F.coalesce("gap_seconds", F.lit(default_gap_seconds)) * 1_000_000 + 1
    width = F.concat(gap.cast("string"), F.lit(" microseconds"))
    g = h.groupBy("node_id", F.session_window("event_time", width).alias("w")).agg(F.max("event_time").alias("last_heartbeat"), F.count("*").alias("n_heartbeats"))
    lapse = F.timestamp_micros(F.unix_micros("w.end") - 1)
    return g.select("node_id", F.col("w.start").alias("alive_from"), "last_heartbeat", lapse.alias("lapsed_at"), "n_heartbeats")


def node_hourly(node_hourly_df: DataFrame, node_id: str, range_key: str | None = "1d", as_of=None,
                start=None, end=None) -> DataFrame:
    """SRC-4 + FLT-5: one node's hourly rows with the explicit column list, ascending.
    ``range_key="custom"`` with start/end gives a closed range; unknown keys -> 1 day."""
    from .usage import NODE_RANGES, between_closed, latest_time, range_filter
    h = node_hourly_df.filter(F.col("node_id") == node_id)
    if range_key == "custom" and start is not None and end is not None:
        h = between_closed(h, start, end)
    else:
        h = range_filter(h, range_key, latest_time(node_hourly_df) if as_of is None else as_of, NODE_RANGES, "1d")
    return h.select(*NODE_HOURLY_COLUMNS).orderBy("bucket_time")


# The node-hourly column list.
NODE_HOURLY_COLUMNS = ["bucket_time", "avg_cpu_usage_percent", "max_cpu_usage_percent", "avg_mem_usage_percent",
                       "max_mem_used_bytes", "avg_gpu_utilization", "max_gpu_temperature", "total_gpu_power_watts",
                       "total_disk_read_bytes", "total_disk_write_bytes", "total_net_rx_bytes", "total_net_tx_bytes",
                       "is_active"]
